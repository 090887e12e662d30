"""N-gram Jaccard join: a count-vector R-tree over hashed word shingles.

A text's set are its distinct five-word shingles (the whole word sequence if it is shorter).
Shingles are hashed into groups; the counts per group are a point. The overlap of two sets is at most
the sum of their coordinate minima, so an R-tree whose nodes hold coordinate-wise maxima prunes every
subtree that can't hold a partner, and surviving pairs are verified on the sets themselves.

On a cluster the search is cut into tasks without losing a link:

1. Equal sets get one identity (a 64-bit sum over mixed shingle hashes), so copies cost nothing.
2. A first pass posts each set's ``posted(n)`` smallest hashes in packed arrays and counts how many of them another set
   posts too. A set that links shares at least ``least_shared(n)`` but for a probability below 1e-15, which is of the order
   of the 64-bit hashes' own. Sets below that link with nothing and leave. Hashes that many sets of a task hold are salted.
3. The rest are clustered around two seed shingles each, in salted blocks of bounded size: verified trees
   join most near copies.
4. Shingles that ``HOT`` sets or more hold go last in the order, the more frequent the later; the first ``sketch_length`` shingles
   under this order are posted again with each set's cluster. A pair is looked for only in the list of its first common
   shingle, and only if clusters, sizes and places there allow a link; an R-tree over each list's points, whose groups grow
   with the sets, keeps the sets that still have a possible partner. So rows grow with postings, not with pairs.
5. Sets that such candidates connect are brought together with their hashes, searched by an R-tree once more and verified
   where they meet; only edges that unite two clusters leave the task.

Null and empty texts have the empty set and link with nothing. Repeated rows are copies. Rows that share an id but not the text are
sets of their own: each row has its own text's links, size and component. Ties don't
matter: the smallest id names a component. Rows without an id give rows too; a text that only such rows hold links with
nothing and has no component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import U64, Bloom, Scratch, UnionFind, bucket_count, by_key, components, key_runs, mix64, slices, text_bytes, word_hashes

SHINGLE = 5
GROUPS = 64
BLOCK = 256  # sets of one seed shingle that are clustered together
PAIR_BLOCK = 2048  # points of one R-tree
POSTED = 64  # hashes that a set posts in the first pass, at most
MISS = 1e-18  # probability that two linked sets' sketches have nothing in common
HOT = 64  # sets from which on a shingle counts as frequent, at least
HEAVY_ENTRIES = 2_000_000  # most shingles that the list of frequent ones may hold
HOT_LIST = 100_000  # sets of one shingle that a task lists together
FLUSH_HOT = 256  # postings of one hash among 2**18 from which on they are salted
JOB = 1 << 22  # shingles of one block of candidates

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = [U64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(SHINGLE)]

_POST = np.dtype([("k", "<u4"), ("s", "<u8")])
_ITEM = np.dtype([("k", "<u4"), ("s", "<i8"), ("c", "<i8"), ("n", "<u4"), ("i", "<u4"), ("f", "<u1")])
_CLASS = 58  # bits of a sketch's key below its frequency class
_COUNT = np.dtype([("k", "<u4"), ("n", "<u4")])


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each text (bytes from starts[i] to starts[i+1]) the sorted 64-bit hashes of its shingles."""
    n_docs = len(starts) - 1
    none = np.zeros(0, U64)
    if n_docs == 0 or len(data) == 0:
        return [none] * n_docs
    words, doc_at = word_hashes(data, starts, ~_SPACE)
    if len(words) == 0:
        return [none] * n_docs
    with np.errstate(over="ignore"):
        grams = words.copy()
        for j in range(1, SHINGLE):
            grams[: len(words) - j] += words[j:] * _STEP[j]
        grams = mix64(grams, 1)
        out = []
        for i in range(n_docs):
            a, b = doc_at[i], doc_at[i + 1]
            if b - a >= SHINGLE:
                x = np.sort(grams[a : b - SHINGLE + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                x = U64(b - a)
                for j in range(b - a):
                    x = x + words[a + j] * _STEP[j]
                out.append(mix64(np.array([x], U64), 2))
            else:
                out.append(none)
    return out


def set_id(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = mix64(hashes, 5).sum(dtype=U64) + U64(len(hashes)) * _BASE
    return int(x.astype(np.int64))


def prefix_length(n: int) -> int:
    """How many first shingles of n must meet a partner's: any partner has at least ceil(3n/4) of them."""
    return n - -(-3 * n // 4) + 1 if n else 0


def posted(n: int) -> int:
    """How many smallest hashes a set of n posts in the first pass."""
    return min(prefix_length(n), POSTED)


@lru_cache(200_000)
def least_shared(n: int, miss: float = 1e-15) -> int:
    """Of a set's posted hashes those that a partner posts too, but for a probability of ``miss``.

    With a partner its union has u <= 4n/3 shingles, of which d <= u/4 aren't common. Both sets post what is common among the
    union's s smallest hashes, where s is the shorter of the two postings: a hypergeometric number of s - d or more.
    """
    if n == 0:
        return 0
    s, most = posted(-(-3 * n // 4)), 4 * n // 3
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def sure(u: int) -> int:
        d, below, m = u // 4, 0.0, max(0, s - u // 4)
        while m < s:  # m common ones and s - m others
            below += math.exp(choose(u - d, m) + choose(d, s - m) - choose(u, s))
            if below > miss:
                break
            m += 1
        return m

    return max(1, min(sure(u) for u in range(max(n, most - 3), most + 1)))


def sketch_length(n: int, rare: int) -> int:
    """How many first shingles a set of n posts, of which ``rare`` aren't frequent.

    The first prefix_length(n) always meet a partner's. Of long sets fewer do: the rare shingles of a union come first and
    in random order, at most n/3 of them aren't common, so its first s have nothing in common with a
    probability below (n / 3 / rare) ** s. Sets that need more than half of their prefix post all of it, so that the
    postings of partners are never shorter than the s of either.
    """
    p = prefix_length(n)
    if 3 * rare <= n:
        return p
    s = math.ceil(math.log(MISS) / math.log(n / (3 * rare)))
    return p if p <= 2 * s else s


def links(overlap: int, a: int, b: int) -> bool:
    """Jaccard of at least 3/4, in whole numbers."""
    return 7 * overlap >= 3 * (a + b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def point(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles per group: the coordinates of a set."""
    return np.bincount((mix64(hashes, 7) % U64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


class CountRTree:
    """Points packed bottom-up, ordered by size and then by their two heaviest coordinates.

    A node keeps the coordinate-wise maximum and the smallest size below it: together they bound the
    overlap, and so the Jaccard similarity, of a query with anything below.
    """

    FAN = 16

    def __init__(self, points: np.ndarray):
        sizes = points.sum(1).astype(np.int64)
        spread = np.argsort(points.var(0))[-2:] if len(points) else [0, 0]
        self.order = np.lexsort((points[:, spread[0]], points[:, spread[1]], sizes))
        self.points, self.sizes = points[self.order].astype(np.int64), sizes[self.order]
        self.levels = []
        high, low, most = self.points, self.sizes, self.sizes
        while len(high) > self.FAN:
            cut = np.arange(0, len(high), self.FAN)
            high = np.maximum.reduceat(high, cut, axis=0)
            low = np.minimum.reduceat(low, cut)
            most = np.maximum.reduceat(most, cut)
            self.levels.append((high, low, most))

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes whose bound allows a link with the query, and the bounds; best bounds first."""
        size = int(query.sum())
        query = query.astype(np.int64)
        found = None
        for high, low, most in reversed(self.levels):
            if found is None:
                found = np.arange(len(high))
            bound = np.minimum(high[found], query).sum(1)
            found = found[(7 * bound >= 3 * (size + low[found])) & (4 * most[found] >= 3 * size)]
            width = len(self.points) if high is self.levels[0][0] else None
            found = (found[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            below = len(self.points) if width is not None else len(self.levels[self._depth(high) - 1][0])
            found = found[found < below]
        if found is None:
            found = np.arange(len(self.points))
        bound = np.minimum(self.points[found], query).sum(1)
        fits = 7 * bound >= 3 * (size + self.sizes[found])
        found, bound = found[fits], bound[fits]
        best = np.argsort(-(bound / np.maximum(1, size + self.sizes[found] - bound)), kind="stable")
        return self.order[found[best]], bound[best]

    def _depth(self, high: np.ndarray) -> int:
        return next(i for i, x in enumerate(self.levels) if x[0] is high)


def cluster(sets: list[np.ndarray], comps: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified tree edges (indexes) among the sets of one block: one for each union, none missing.

    Sets of equal ``comps`` are united already.
    """
    groups = groups_for(sum(map(len, sets)) // len(sets))
    points = np.stack([point(x, groups) for x in sets])
    tree, union, edges = CountRTree(points), UnionFind(len(sets)), []
    first: dict[int, int] = {}
    for i, c in enumerate(comps or ()):
        union.join(first.setdefault(c, i), i)
    for i, x in enumerate(sets):
        for j in tree.search(points[i])[0]:
            if j != i and union.root(i) != union.root(int(j)) and links(overlap(x, sets[j]), len(x), len(sets[j])):
                union.join(i, int(j))
                edges.append((i, int(j)))
    return edges


def _flush(rows: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    rows, buckets = rows[order], buckets[order]
    cut = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(rows) else np.zeros(0, int)
    ends = np.append(cut[1:], len(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[cut].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
        ["bucket", "posts"],
    )


def _packed(parts: Iterator[tuple[np.ndarray, ...]], n_buckets: int, most: int = 1 << 18, split: bool = False):
    """Arrow rows (bucket, packed postings), a bounded number at a time, from shingle keys, postings without k, and salts if any.

    A salt of s puts a posting into the s-th further range of buckets. With ``split``, keys that stand out among the postings
    at hand get a common salt of their own: FLUSH_HOT of them meet each other there.
    """
    shift, held, size, flushes, task = U64(64 - (n_buckets - 1).bit_length()), [], 0, 0, TaskContext.get()

    def out():
        keys = np.concatenate([x[0] for x in held])
        rows = np.concatenate([x[1] for x in held])
        rows["k"] = keys.astype(np.uint32)
        b = (keys >> shift).astype(np.int64)
        if len(held[0]) > 2:
            b += n_buckets * np.concatenate([x[2] for x in held])
        elif split:
            order = np.argsort(keys, kind="stable")
            new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
            often = np.empty(len(keys), bool)
            group = np.cumsum(new) - 1
            often[order] = (np.bincount(group) >= FLUSH_HOT)[group]
            b[often] += n_buckets * (1 + (task.partitionId() * 13 + flushes) % 64)
        return _flush(rows, b)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield out()
            held, size, flushes = [], 0, flushes + 1
    if size:
        yield out()


def _key(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes, 3)


def _bucket_rows(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    for (bucket,), rows in key_runs(batches, 1):
        yield bucket, np.frombuffer(b"".join(r[0] for r in rows), dtype)


def _in_order(posts: np.ndarray) -> np.ndarray:
    """Postings by shingle and set, repeated ones once."""
    order = np.argsort((posts["k"].astype(U64) << U64(32)) | (posts["s"] & U64(0xFFFFFFFF)))
    posts = posts[order]
    new = np.ones(len(posts), bool)
    new[1:] = (posts["k"][1:] != posts["k"][:-1]) | (posts["s"][1:] != posts["s"][:-1])
    return posts[new]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_bytes(batch.column(1))
        sizes, ids = [], []
        for i, j in slices(starts):
            for x in shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]):
                sizes.append(len(x))
                ids.append(set_id(x) if len(x) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "n", "sid"])


def _prefix_posts(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            seen: set[int] = set()
            for batch in batches:
                data, starts = text_bytes(batch.column(0))
                for i, j in slices(starts):
                    for x in shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]):
                        if len(x) and (s := set_id(x)) not in seen:
                            seen.add(s)
                            keys = np.sort(_key(x))[: posted(len(x))]
                            # the bucket is the top of the key, so the order must come from other bits
                            keys = mix64(keys, 4)
                            rows = np.zeros(len(keys), _POST)
                            rows["s"] = U64(s & 0xFFFFFFFFFFFFFFFF)
                            yield keys, rows
                    if len(seen) > 100_000:  # copies that come later are found by the reducer
                        seen.clear()

        yield from _packed(parts(), n_buckets, split=True)

    return run


def _meetings(n_buckets: int):
    """Sets that share postings with another set: how many, the rarest such shingle and the one of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, posts in _bucket_rows(batches, _POST):
            posts = _in_order(posts)
            new = np.concatenate(([True], posts["k"][1:] != posts["k"][:-1]))
            group = np.cumsum(new) - 1
            df = np.bincount(group)[group]
            posts, df = posts[df >= 2], df[df >= 2]
            if len(posts) == 0:
                continue
            key = (U64(bucket % n_buckets) << U64(32)) | posts["k"].astype(U64)
            rank = np.log2(df).astype(U64) if bucket < n_buckets else np.full(len(df), 63, U64)
            rarest = rank << U64(56) | (mix64(key, 8) >> U64(8))
            least = mix64(key, 9) >> U64(1)
            order = np.argsort(posts["s"], kind="stable")
            sids = posts["s"][order]
            cut = np.flatnonzero(np.concatenate(([True], sids[1:] != sids[:-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sids[cut].astype(np.int64)),
                    *(pa.array(np.minimum.reduceat(x[order], cut).astype(np.int64)) for x in (rarest, least)),
                    pa.array(np.diff(np.append(cut, len(sids)))),
                ],
                ["sid", "seed", "other", "shared"],
            )

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c >= least_shared(n) for n, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_bytes(batch.column(2))
        for i, j in slices(starts, 1 << 19):
            sets = shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            own = batch.column(0).slice(i, j - i)
            # where rows share an id, another row's text isn't this set
            keep = pa.array([len(x) > 0 and set_id(x) == s for x, s in zip(sets, own.to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [
                    own,
                    batch.column(1).slice(i, j - i),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                ["sid", "seeds", "n", "hashes"],
            )
            yield out.filter(keep)


def _cluster_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for _, rows in key_runs(batches, 2):
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            continue
        sets = [np.frombuffer(r[1], U64) for r in rows]
        if len(rows) == 2:
            edges = [(0, 1)] if links(overlap(*sets), len(sets[0]), len(sets[1])) else []
        else:
            edges = cluster(sets)
        a += [rows[i][0] for i, _ in edges]
        b += [rows[j][0] for _, j in edges]
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _count_posts(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            held, size = [], 0

            def counted():
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                rows = np.zeros(len(keys), _COUNT)
                rows["n"] = n
                return keys, rows

            for batch in batches:
                for x in batch.column(0):
                    keys = mix64(_key(np.frombuffer(x.as_buffer(), U64)), 4)
                    held.append(keys)
                    size += len(keys)
                    if size > 1 << 19:
                        yield counted()
                        held, size = [], 0
            if size:
                yield counted()

        yield from _packed(parts(), n_buckets)

    return run


def _heavy(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _bucket_rows(batches, _COUNT):
            keys, at = np.unique(rows["k"], return_inverse=True)
            n = np.bincount(at, rows["n"].astype(np.float64)).astype(np.int64)
            keep = n >= least
            if keep.any():
                full = (U64(bucket) << U64(32)) | keys[keep].astype(U64)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(n[keep])], ["key", "n"])

    return run


def groups_for(n: int) -> int:
    """Groups of a set's point: about one for four shingles, so that sums of minima still tell sets apart."""
    return min(4096, max(16, 1 << (n // 4).bit_length()))


def _sketches(n_buckets: int, heavy):
    """Each set's first shingles in the order of frequency class and hash, as keys of both, and its point."""
    shift = U64(64 - (n_buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = heavy.value
        for batch in batches:
            sizes, sketches, points = [], [], []
            for x in batch.column(1):
                hashes = np.frombuffer(x.as_buffer(), U64)
                keys = mix64(_key(hashes), 4)
                order = keys >> U64(64 - _CLASS)
                rare = len(keys)
                if len(known):
                    short = ((keys >> shift) << U64(32)) | (keys & U64(0xFFFFFFFF))
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    found = np.where(known[at] == short, classes[at], U64(0))
                    rare = int((found == 0).sum())
                    order = order | found << U64(_CLASS)
                first = np.argsort(order, kind="stable")[: sketch_length(len(keys), rare)]
                p = point(hashes, groups_for(len(hashes)))
                sizes.append(len(hashes))
                sketches.append(np.stack((order[first], keys[first])).tobytes())
                points.append(p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(points, pa.binary())], ["sid", "n", "sketch", "point"]
            )

    return run


def _item_posts(n_buckets: int, hot: int):
    """Postings of the sketches with each set's cluster, size and place; lists of very frequent shingles are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                columns = (batch.column(i).to_pylist() for i in range(3))
                for sid, comp, n, x in zip(*columns, batch.column(3), strict=True):
                    order, keys = np.frombuffer(x.as_buffer(), U64).reshape(2, -1)
                    rows = np.zeros(len(keys), _ITEM)
                    rows["s"], rows["c"], rows["n"], rows["i"] = sid, comp, n, np.arange(len(keys))
                    rows["f"] = order >> U64(_CLASS)
                    spread = -(-(HOT << rows["f"].astype(np.int64)) // hot)
                    salt = np.where(spread > 1, 1 + (sid * 0x9E3779B1 & 0x7FFFFFFF) % spread, 0)
                    yield keys, rows, salt

        yield from _packed(parts(), n_buckets)

    return run


def may_link(n: np.ndarray | int, rest: np.ndarray | int, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sizes, and what follows their first common shingle, allow a link."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (7 * np.minimum(rest, other) >= 3 * (n + m))


def _lists(n_buckets: int):
    """Items of the lists in which sets of different clusters may link; parts of spread lists as they are."""
    names = ["lid", "parts", "spread", "sid", "comp", "n", "pos"]

    def out(rows: np.ndarray, lids: np.ndarray, parts: np.ndarray, spread: bool) -> pa.RecordBatch:
        columns = [lids.astype(np.int64), parts.astype(np.int32), np.full(len(rows), spread)]
        columns += [rows["s"], rows["c"], rows["n"].astype(np.int64), rows["i"].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, posts in _bucket_rows(batches, _ITEM):
            posts = posts[np.argsort(posts["k"], kind="stable")]
            cut = np.flatnonzero(np.concatenate(([True], posts["k"][1:] != posts["k"][:-1])))
            ends = np.append(cut[1:], len(posts))
            base = mix64((U64(bucket % n_buckets) << U64(32)) | posts["k"].astype(U64), 10)
            if bucket >= n_buckets:
                parts = -(-(HOT << posts["f"].astype(np.int64)) // PAIR_BLOCK)
                for k in range(0, len(posts), 10_000):
                    yield out(posts[k : k + 10_000], base[k : k + 10_000], parts[k : k + 10_000], True)
                continue
            low, high = (f.reduceat(posts["c"], cut) for f in (np.minimum, np.maximum))
            index = np.maximum.reduceat((7 * posts["i"].astype(np.int64) <= posts["n"]).astype(np.int8), cut)
            keep, parts = np.zeros(len(posts), bool), np.ones(len(posts), np.int64)
            for a, b in zip(cut[(low != high) & (index > 0)], ends[(low != high) & (index > 0)], strict=True):
                if b - a > PAIR_BLOCK:
                    keep[a:b], parts[a:b] = True, -(-(b - a) // PAIR_BLOCK)
                    continue
                n, c = posts["n"][a:b].astype(np.int64), posts["c"][a:b]
                rest = n - posts["i"][a:b]
                if b - a <= 256:
                    fits = may_link(n[:, None], rest[:, None], n[None], rest[None]) & (c[:, None] != c[None])
                    keep[a:b] = fits.any(0)
                    continue
                for i in np.flatnonzero(7 * rest >= 6 * n):  # the smaller set of a pair stands near its front
                    fits = may_link(n[i], rest[i], n, rest) & (c != c[i])
                    if fits.any():
                        keep[a:b] |= fits
                        keep[a + i] = True
            if keep.any():
                yield out(posts[keep], base[keep], parts[keep], False)

    return run


def _fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(-1, groups).sum(0) if len(p) > groups else p


def _first_here(x: tuple, y: tuple) -> bool:
    """Whether two items have no common shingle before the list's."""
    return set(x[3]).isdisjoint(y[3])


def _few_candidates(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
    """``candidates`` of a list so short that the bounds of its pairs are taken directly."""
    (c, n, at), (d, m, to) = (np.array([x[:3] for x in items], np.int64).T for items in (left, right))
    fits = may_link(n[:, None], (n - at)[:, None], m[None], (m - to)[None]) & (c[:, None] != d[None])
    for i, j in np.argwhere(np.triu(fits, 1) if same else fits).tolist():
        x, y = left[i], right[j]
        if _first_here(x, y):
            groups = min(len(x[4]), len(y[4]))
            bound = int(np.minimum(_fold(x[4], groups), _fold(y[4], groups)).sum())
            if links(bound, x[1], y[1]):
                yield i, j


def candidates(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of items (cluster, size, place, earlier keys, point) of one list that may link and first meet in it."""
    if len(left) * len(right) <= 4096:
        yield from _few_candidates(left, right, same)
        return

    def search(queries: list[tuple], items: list[tuple], up_to: bool) -> Iterator[tuple[int, int]]:
        by_groups: dict[int, list[int]] = {}
        for j, item in enumerate(items):
            by_groups.setdefault(len(item[4]), []).append(j)
        trees = {g: CountRTree(np.stack([items[j][4] for j in at])) for g, at in by_groups.items()}
        facts = {g: [np.array([items[j][k] for j in at]) for k in range(3)] for g, at in by_groups.items()}
        for i, (comp, n, pos, _, p) in enumerate(queries):
            for g, tree in trees.items():
                # of two sizes of points the larger one asks, folded
                if g > len(p) or (g == len(p) and not up_to):
                    continue
                c, m, at = facts[g]
                if not (may_link(n, n - pos, m, m - at) & (c != comp)).any():
                    continue
                found = tree.search(_fold(p, g))[0]
                c, m, at = c[found], m[found], at[found]
                for j in found[(c != comp) & may_link(n, n - pos, m, m - at)].tolist():
                    j = by_groups[g][j]
                    if _first_here(items[j], queries[i]):
                        yield i, j

    yield from search(left, right, True)
    if not same:
        yield from ((i, j) for j, i in search(right, left, False))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that the R-tree leaves a possible partner of another cluster: (job, sid, comp), connected ones in one job."""

    def item(r: tuple) -> tuple:
        p = np.frombuffer(r[6], np.uint8 if len(r[6]) == groups_for(r[3]) else np.uint32).astype(np.uint32)
        return r[2], r[3], r[4], np.frombuffer(r[5], U64).tolist(), p

    jobs, sids, comps = [], [], []
    for key, rows in key_runs(batches, 3):
        right = [r for r in rows if r[0] == 1]
        left, same = [r for r in rows if r[0] == 0], key[1] == key[2]
        if not right or not (left or same):
            continue
        items = [item(r) for r in right]
        others = items if same else [item(r) for r in left]
        shift = 0 if same else len(right)
        union, met = UnionFind(len(right) + (0 if same else len(left))), set()
        for i, j in candidates(others, items, same):
            union.join(i + shift, j)
            met |= {i + shift, j}
        groups: dict[int, list[int]] = {}
        for i in sorted(met):
            groups.setdefault(union.root(i), []).append(i)
        every = right if same else right + left
        for root, members in groups.items():
            # a job is bounded: larger groups are cut into blocks, one job for each two of them
            block, size, blocks = [], 0, []
            for i in members:
                if size + every[i][3] > JOB and block:
                    blocks.append(block)
                    block, size = [], 0
                block.append(i)
                size += every[i][3]
            blocks.append(block)
            seed = np.array([key[0], key[1], key[2], every[root][1]], np.int64).view(U64)
            base = int(mix64(seed, 12)[0] ^ mix64(seed, 13)[1] ^ mix64(seed, 14)[2] ^ mix64(seed, 15)[3])
            for x in range(len(blocks)):
                for y in range(x if len(blocks) == 1 else x + 1, len(blocks)):
                    job = int(mix64(np.array([base ^ (x << 32 | y)], U64), 16).astype(np.int64)[0])
                    for i in blocks[x] + (blocks[y] if x < y else []):
                        jobs.append(job)
                        sids.append(every[i][1])
                        comps.append(every[i][2])
            if len(jobs) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (jobs, sids, comps)], ["job", "sid", "comp"])
                jobs, sids, comps = [], [], []
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (jobs, sids, comps)], ["job", "sid", "comp"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified edges between clusters of a job's sets: one for each union, none missing."""
    a, b = [], []
    for _, rows in key_runs(batches, 1):
        edges = cluster([np.frombuffer(r[2], U64) for r in rows], [r[1] for r in rows])
        a += [rows[i][0] for i, _ in edges]
        b += [rows[j][0] for _, j in edges]
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, set_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links of Jaccard 0.75 or more, itself included.
    """
    scratch = Scratch(spark, "ngram")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = bucket_count(base)
    sign = scratch.write(base.mapInArrow(_signatures, "doc_id long, n long, sid long"))
    posts = base.select("text").mapInArrow(_prefix_posts(buckets), "bucket int, posts binary")
    met = by_key(posts, ["bucket"]).mapInArrow(_meetings(buckets), "sid long, seed long, other long, shared long")
    met = met.groupBy("sid").agg(F.min("seed").alias("seed"), F.min("other").alias("other"), F.sum("shared").alias("shared"))
    first = sign.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("doc_id"))
    near = first.join(met, "sid").select("sid", "doc_id", "n", "shared", "seed", "other")
    near = scratch.write(near.mapInArrow(_enough, near.schema))

    # seed shingles with more sets than a block are salted; this meets the small rows, not the sets
    seeds = near.select("sid", "doc_id", F.explode(F.array("seed", "other")).alias("seed"))
    sizes = scratch.write(seeds.groupBy("seed").agg(F.count("*").alias("m")).where("m >= 2"))  # written, so that the join can split a frequent seed
    salt = F.pmod(F.xxhash64("sid", "seed"), F.ceil(F.col("m") / BLOCK)).alias("salt")
    seeds = seeds.join(sizes, "seed").groupBy("sid", "doc_id").agg(F.collect_set(F.struct("seed", salt)).alias("seeds"))
    chosen = near.select("sid", "doc_id").join(seeds, ["sid", "doc_id"], "left")

    texts = Bloom.of(near.select("doc_id")).where(base, 0).join(chosen, "doc_id").select("sid", "seeds", "text")
    kind = "sid long, seeds array<struct<seed:long,salt:long>>, n long, hashes binary"
    sets = scratch.write(texts.mapInArrow(_full_sets, kind), "lz4")

    blocks = sets.select(F.explode("seeds").alias("b"), "sid", "hashes").select("b.seed", "b.salt", "sid", "hashes")
    trees = scratch.write(by_key(blocks, ["seed", "salt"]).mapInArrow(_cluster_blocks, "a long, b long"))
    comps = components(trees, scratch)

    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(HOT, -(-total // HEAVY_ENTRIES))  # no more than HEAVY_ENTRIES shingles can be as frequent
    counts = by_key(sets.select("hashes").mapInArrow(_count_posts(buckets), "bucket int, posts binary"), ["bucket"])
    heavy = counts.mapInArrow(_heavy(least), "key long, n long").toArrow()  # HEAVY_ENTRIES rows at most
    known = heavy.column("key").to_numpy().astype(U64)
    order = np.argsort(known)
    classes = np.log2(heavy.column("n").to_numpy()[order] / HOT).astype(U64) + U64(1)
    shared = spark.sparkContext.broadcast((known[order], classes))

    sketches = scratch.write(sets.select("sid", "hashes").mapInArrow(_sketches(buckets, shared), "sid long, n long, sketch binary, point binary"))
    held = sketches.join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    held = held.select("sid", F.coalesce("component", "sid").alias("comp"), "n", "sketch")
    posts = held.mapInArrow(_item_posts(buckets, HOT_LIST), "bucket int, posts binary")
    kind = "lid long, parts int, spread boolean, sid long, comp long, n long, pos long"
    items = scratch.write(by_key(posts, ["bucket"]).mapInArrow(_lists(buckets), kind))
    mixed = items.where("spread").groupBy("lid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.expr("7 * pos <= n")).alias("some"))
    spread = items.where("spread").join(mixed.where("low <> high and some").select("lid"), "lid", "left_semi")
    items = items.where("not spread").unionByName(spread).withColumn("own", F.pmod(F.xxhash64("sid", "lid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    items = items.select("lid", "sid", "comp", "n", "pos", "own", other).select(
        "lid",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "sid",
        "comp",
        "n",
        "pos",
    )
    earlier = F.expr("substring(sketch, 1, 8 * pos)").alias("earlier")  # the set's keys before the list's
    items = items.join(sketches.select("sid", "sketch", "point"), "sid").select("lid", "i", "j", "side", "sid", "comp", "n", "pos", earlier, "point")
    jobs = scratch.write(by_key(items, ["lid", "i", "j"], spread=True).mapInArrow(_partners, "job long, sid long, comp long"))
    few = Bloom.of(jobs.select("sid").distinct()).where(sets.select("sid", "hashes"), 0)
    jobs = jobs.join(few, "sid").select("job", "sid", "comp", "hashes")
    more = scratch.write(by_key(jobs, ["job"], spread=True).mapInArrow(_settle, "a long, b long"))
    comps = components(trees.select("a", "b").unionByName(more.select("a", "b")), scratch)

    ids = first.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    low = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = scratch.write(ids.join(low, "component").select("sid", "component_id"))
    full = sign.where("n > 0").join(ids, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("sid").alias("set_id"))
    empty = sign.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("set_id"))
    return full.unionByName(empty)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_join(spark, docs).select("doc_id", "n_shingles", "component_id")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_OP1 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + {SHINGLE}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""
