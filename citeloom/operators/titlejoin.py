"""Similarity join of titles: pairs whose Jaro similarity reaches a threshold, without comparing all of a block.

Jaro's similarity is (m / |a| + m / |b| + (m - t) / m) / 3, where m characters match. The last term is at most 1, so a threshold s
needs m >= (3s - 2) |a|, and m can't exceed what the titles have in common as multisets of characters. A title is therefore
a set of tokens (character, its count so far), in one global order with frequent tokens last, and two titles that
may be similar share at least two tokens among the first n - ceil((3s - 2) n) + 2 of each: pairs of those are the join's keys. Lengths
and the places of the shared tokens bound what can follow, and what survives is compared token by token before Jaro runs, once for
each pair.

Titles too short to be sure of two tokens are keyed by single tokens, and so are those so long that pairs of tokens would be too many.

Where titles of a block are many and all much alike in their characters, as six words of any text are, such keys thin little and cost more than
what they save. ``numbered_pairs`` therefore compares numbered titles tile by tile: bits stand for the titles' counts of characters, and how many of them differ bounds
how many characters two titles have in common; of what is left, the longest common subsequence bounds how many agree in turn, and Jaro runs in the same task on what may reach the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.similarity import jaro, jaro_many

FREQUENT = 256  # tokens whose frequency orders them; all others come first
LONG = 120  # characters from which on a title has keys of one token
SURE = 4  # characters up to which a title may share a single token with a partner
BLOCK, SMALL = 1 << 16, 1024  # numbered titles in a block, at most and at least; two blocks are a tile, which is what meets in a task
KINDS, PLACES, CELLS = 64, 64, 1 << 17  # classes of characters, characters that a word of bits has places for, and pairs that are compared at once
YEARS = 1024  # titles of known years that meet those of their years at once
TILES = 4096  # partitions that tiles are dealt to at most


def title_tokens(title: Column) -> Column:
    """A title's characters, each with how many of its kind there are up to it: a set that stands for the multiset."""
    kinds = F.array_distinct(F.filter(F.split(title, ""), lambda c: c != ""))
    count = lambda c: F.char_length(title) - F.char_length(F.replace(title, c, F.lit("")))
    return F.flatten(F.transform(kinds, lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda k: F.concat(c, k.cast("string")))))


def share_needed(least: float) -> float:
    """The share of a title's characters that must match where Jaro's similarity reaches ``least``."""
    need = 3 * least - 2
    if need <= 0:
        raise ValueError("below two thirds, similar titles need not share a character")
    return need


def title_keys(rows: DataFrame, title: str, least: float) -> DataFrame:
    """``rows`` (all columns, title not null) with ``n``, and a row for each key: ``key`` and ``pos``, the place of its last token."""
    need = share_needed(least)
    t = rows.where(F.char_length(title) > 0).withColumn("_t", title_tokens(F.col(title))).withColumn("n", F.size("_t"))
    counts = t.select(F.explode("_t").alias("k")).groupBy("k").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "k").limit(FREQUENT)
    order = counts.agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("_order"))  # one row of FREQUENT entries
    t = t.crossJoin(F.broadcast(order)).withColumn("_t", F.array_sort(F.transform("_t", lambda k: F.struct(F.coalesce(F.try_element_at("_order", k), F.lit(0)), k))))
    must = F.ceil(F.col("n") * need - 1e-9).cast("int")
    first = lambda extra: F.slice("_t", 1, F.least(F.col("n"), F.col("n") - must + extra))
    two = F.flatten(
        F.transform(
            first(2),
            lambda x, i: F.transform(
                F.slice(first(2), i + 2, F.lit(1 << 30)), lambda y, j: F.struct(F.xxhash64(F.lit(2), x, y).alias("key"), (i + j + 1).alias("pos"))
            ),
        )
    )
    one = F.transform(first(1), lambda x, i: F.struct(F.xxhash64(F.lit(1), x).alias("key"), i.alias("pos")))
    none = F.array().cast("array<struct<key:bigint,pos:int>>")
    both = F.concat(
        F.when(F.col("n").between(SURE + 1, LONG), two).otherwise(none),
        F.when((F.col("n") <= math.ceil(SURE / need)) | (F.col("n") > LONG * need), one).otherwise(none),
    )
    return t.select(*rows.columns, "n", F.explode(both).alias("_k")).select(*rows.columns, "n", F.col("_k.key").alias("key"), F.col("_k.pos").alias("pos"))


def matches_needed(n: Column, m: Column, least: float) -> Column:
    """How many characters of titles of ``n`` and ``m`` must match."""
    return (3 * least - 1) * n * m / (n + m)


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, order: str, on: list[str], least: float, fits=None) -> DataFrame:
    """Distinct (a, b) of keyed rows that agree in ``on``, the first one earlier in ``order``, and may be similar."""
    x = left.select(*on, "key", *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in (*on, "key")])
    y = right.select(*on, "key", *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in (*on, "key")])
    n, m, p, q = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    most = F.least(p, q) + 1 + F.least(n - p, m - q) - 1  # tokens up to the last one that they share, and what can follow
    near = (most >= matches_needed(n, m, least) - 1e-9) & (F.least(n, m) >= matches_needed(n, m, least) - 1e-9)
    both = x.join(y, [*on, "key"]).where((F.col(f"{order}_a") < F.col(f"{order}_b")) & near)
    if fits is not None:
        both = both.where(fits)
    return both.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b")).distinct()


def may_be_similar(a: Column, b: Column, least: float) -> Column:
    """Whether two titles have as many characters in common as must match."""
    common = F.size(F.array_intersect(title_tokens(a), title_tokens(b)))
    return common >= matches_needed(F.char_length(a), F.char_length(b), least) - 1e-9


def similar_pairs(pairs: DataFrame, rows: DataFrame, key: str, title: str, least: float) -> DataFrame:
    """(a, b, sim) of the candidate pairs whose similarity reaches ``least``."""
    t = rows.select(F.col(key).alias("k"), F.col(title).alias("t"))
    both = pairs.join(t.withColumnsRenamed({"k": "a", "t": "t_a"}), "a").join(t.withColumnsRenamed({"k": "b", "t": "t_b"}), "b")
    both = both.where(may_be_similar(F.col("t_a"), F.col("t_b"), least))
    return both.withColumn("sim", jaro(F.col("t_a"), F.col("t_b"))).where(F.col("sim") >= least).select("a", "b", "sim")


def _marks(titles: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two words of bits for each title, the classes of its first ``PLACES`` characters (``KINDS`` past its end), a row for each place, and whether each of them has a class of its own.

    A bit stands for a class of characters and a count that a title reaches, those that tell most first; the commonest characters are classes of their own.
    Two titles' bits differ in as many places at most as the titles have characters that the other one lacks.
    """
    kind = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32)
    often = np.bincount(kind)
    order = np.empty(len(often), np.int64)
    order[np.argsort(-often, kind="stable")] = np.arange(len(often))
    row, place = np.repeat(np.arange(len(titles)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    exact = np.bincount(row, order[kind] >= KINDS, minlength=len(titles)) == 0
    kind = (order % KINDS).astype(np.uint8)[kind]
    counts = np.bincount(row * KINDS + kind, minlength=len(titles) * KINDS).reshape(-1, KINDS)
    reached = [np.cumsum(np.bincount(c)[::-1])[::-1][1:] / len(titles) for c in counts.T]  # the share of titles that reach 1, 2, 3...
    share, which = np.concatenate(reached), [(c, k) for c, r in enumerate(reached) for k in range(len(r))]
    words = np.zeros((2, len(titles)), np.uint64)
    for at, best in enumerate(np.argsort(-share * (1 - share), kind="stable")[:128]):
        c, k = which[best]
        words[at // 64] |= (counts[:, c] > k).astype(np.uint64) << np.uint64(at % 64)
    codes = np.full((PLACES + 1, len(titles)), KINDS, np.uint8)
    some = place < PLACES
    codes[place[some], row[some]] = kind[some]
    return words, codes, exact


class _Tile:
    """Titles that are compared: by bits, then by the longest common subsequence, then by Jaro's similarity.

    Characters that match and agree in turn are a common subsequence, of m - 2t - 1 at least for m matches and t transpositions.
    """

    def __init__(self, titles: list[str], least: float):
        self.titles, self.least, self.need = np.array(titles, object), least, share_needed(least)
        self.size = np.array([len(t) for t in titles], np.int64)
        (self.one, self.two), self.codes, self.exact = _marks(titles, self.size)
        masks = np.zeros((len(titles), KINDS + 1), np.uint64)  # the places of each class, none past the end
        for place, kind in enumerate(self.codes[: min(PLACES, int(self.size.max()))]):
            masks[np.arange(len(titles)), kind] |= np.uint64(1 << place)
        masks[:, KINDS] = 0
        self.masks = masks.ravel()

    def least_common(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.ceil((3 * self.least - 1) * n * m / (n + m) - 1e-6)

    def similar(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, sim) of the titles i of ``x`` and j of ``y`` whose similarity reaches the threshold."""
        x, y = (side[np.argsort(self.size[side], kind="stable")] for side in (x, y))
        xn, yn, ones, found = self.size[x], self.size[y], self.one[y], [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for n in np.unique(xn):
            low, high = np.searchsorted(yn, n * self.need - 1e-6), np.searchsorted(yn, n / self.need + 1e-6, "right")
            if low == high:
                continue
            here, there, word = x[np.searchsorted(xn, n) : np.searchsorted(xn, n, "right")], y[low:high], ones[low:high]
            most = np.minimum(n + yn[low:high] - 2 * self.least_common(n, yn[low:high]), 255).astype(np.uint8)
            rows, hits = max(1, CELLS // len(word)), []
            differ, bits = np.empty((rows, len(word)), np.uint64), np.empty((rows, len(word)), np.uint8)
            for at in range(0, len(here), rows):
                k = min(rows, len(here) - at)
                np.bitwise_xor(self.one[here[at : at + k], None], word, out=differ[:k])
                np.bitwise_count(differ[:k], out=bits[:k])
                hits.append(np.flatnonzero(bits[:k] <= most) + at * len(word))
                if at + k == len(here) or sum(map(len, hits)) > CELLS:
                    i, j = np.divmod(np.concatenate(hits), len(word))
                    hits, i, may = [], here[i], most[j]
                    j = there[j]
                    some = np.bitwise_count(self.one[i] ^ self.one[j]) + np.bitwise_count(self.two[i] ^ self.two[j]) <= may
                    found.append(self._settle(i[some], j[some]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _settle(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = self.size[i], self.size[j]
        differ = np.bitwise_count(self.one[i] ^ self.one[j]).astype(np.int64) + np.bitwise_count(self.two[i] ^ self.two[j])
        # m - 2t - 1 is concave in the matches, so it is least at an end
        turn = lambda k: (6 * self.least - 1) * k - 2 * k * k * (1 / n + 1 / m) - 1 - 1e-6
        short = (n <= PLACES) & (m <= PLACES)
        some = ~short
        some[short] = self._in_order(i[short], j[short]) >= np.minimum(turn(self.least_common(n, m)), turn((n + m - differ) // 2))[short]
        i, j, short = i[some], j[some], short[some]
        sim, same = np.ones(len(i)), i == j
        bits = short & ~same & self.exact[i] & self.exact[j]
        sim[bits] = self._jaro(i[bits], j[bits])
        other = ~same & ~bits
        sim[other] = jaro_many(self.titles[i[other]].tolist(), self.titles[j[other]].tolist())
        some = sim >= self.least
        return i[some], j[some], sim[some]

    def _in_order(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common subsequences of short titles; classes count as characters."""
        own, v = i * (KINDS + 1), np.full(len(i), ~np.uint64(0))
        for kind in self.codes[: self.size[j].max(initial=0)]:
            u = v & self.masks[own + kind[j]]
            v = (v + u) | (v - u)
        return np.bitwise_count(~v)

    def _jaro(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Jaro's similarity of short titles whose characters are classes of their own: places that match are bits of a word."""
        n, m, every, one = self.size[i], self.size[j], ~np.uint64(0), np.uint64(1)
        reach, own = np.maximum(0, np.maximum(n, m) // 2 - 1), j * (KINDS + 1)
        free, hit = np.full(len(i), every), np.zeros(len(i), np.uint64)
        for place, kind in enumerate(self.codes[: n.max(initial=0)]):
            window = (every << np.maximum(0, place - reach).astype(np.uint64)) & (every >> (63 - np.minimum(63, place + reach)).astype(np.uint64))
            fits = self.masks[own + kind[i]] & free & window
            free &= ~(fits & (~fits + one))  # the first one is taken
            hit |= (fits > 0).astype(np.uint64) << np.uint64(place)
        matched, taken, moved = np.bitwise_count(hit).astype(np.int64), ~free, np.zeros(len(i), np.int64)
        for _ in range(matched.max(initial=0)):
            p, q = hit & (~hit + one), taken & (~taken + one)
            moved += self.codes[np.bitwise_count(p - one), i] != self.codes[np.bitwise_count(q - one), j]  # past the last one: two ends
            hit, taken = hit ^ p, taken ^ q
        some = np.maximum(matched, 1)
        return np.where(matched > 0, (matched / n + matched / m + (matched - moved // 2) / some) / 3, 0.0)


def tile_pairs(left: pd.DataFrame, right: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b, sim) of two blocks of (id, t, y): a before b, of one year or b of none, Jaro's similarity at least ``least``.

    Rows of unknown years meet all earlier ones, equal titles once; rows of known years meet those of their years.
    """
    x, y = (side[side["t"].str.len() > 0] for side in (left, right))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(x) and len(y):
        code, titles = pd.factorize(pd.concat([x["t"], y["t"]]))
        tile = _Tile(list(titles), least)
        (xi, xy), (yi, yy) = ((side["id"].to_numpy(), side["y"].to_numpy(np.float64, na_value=np.nan)) for side in (x, y))
        xc, yc, known, dated = code[: len(x)], code[len(x) :], ~np.isnan(xy), ~np.isnan(yy)
        met = [(np.arange(len(x)), np.flatnonzero(~dated))]
        one, two = (np.flatnonzero(which)[np.argsort(years[which], kind="stable")] for which, years in ((known, xy), (dated, yy)))
        for at in range(0, len(one), YEARS):
            some = one[at : at + YEARS]
            met.append((some, two[np.searchsorted(yy[two], xy[some[0]]) : np.searchsorted(yy[two], xy[some[-1]], "right")]))
        for p, q in met:
            i, j, sim = tile.similar(np.unique(xc[p]), np.unique(yc[q]))
            # from titles to their rows
            i, sim, j = _held(i, xc[p], p, sim, j)
            j, sim, i = _held(j, yc[q], q, sim, i)
            fits = (xi[i] < yi[j]) & (~dated[j] | (xy[i] == yy[j]))
            found.append((xi[i[fits]], yi[j[fits]], sim[fits]))
    return pd.DataFrame(dict(zip(("a", "b", "sim"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def _held(title: np.ndarray, own: np.ndarray, rows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each title those of ``rows`` that have it (``own`` is their titles), ``more`` repeated beside them."""
    order = np.argsort(own, kind="stable")
    first, end = np.searchsorted(own[order], title), np.searchsorted(own[order], title, "right")
    times = end - first
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return rows[order[at]], *(np.repeat(m, times) for m in more)


def numbered_pairs(rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(a, b, sim), a < b, of the similar titles of one year, or an unknown one: ``rows`` (id, t, y) are numbered by year, unknown ones last, from 1.

    Blocks are ranges of ids, so a year is in consecutive blocks, and the unknown ones in the last: a block meets itself, the others of its years and those
    with unknown years. Every pair is looked at once; a task holds two blocks. Blocks grow with the input up to ``BLOCK``, while there are tiles for all cores.
    """
    share_needed(least)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ends = rows.groupBy("y").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    last, first_open = rows.agg(F.max("id"), F.min(F.when(F.col("y").isNull(), F.col("id")))).first()
    if block is None:
        free = 0 if first_open is None else last - first_open + 1
        block = max(SMALL, min(BLOCK, math.ceil(math.sqrt((last or 0) * max(free, SMALL) / (4 * cores)))))
    number = lambda c: F.floor((F.col(c) - 1) / block).cast("int")
    n = 1 + ((last or 1) - 1) // block
    opened = n if first_open is None else (first_open - 1) // block
    known = rows.where("y is not null").join(ends.where("y is not null"), "y").select("id", "t", "y", number("id").alias("_own"), number("_first").alias("_low"), number("_last").alias("_high"))
    free = rows.where("y is null").select("id", "t", "y", number("id").alias("_own"), F.lit(0).alias("_low"), F.lit(n - 1).alias("_high"))
    dealt = known.unionByName(free)
    # as the earlier one: up to the end of its year, and with all blocks of unknown years
    after = F.array_union(F.sequence("_own", "_high"), F.sequence(F.greatest(F.col("_own"), F.lit(opened)), F.lit(n - 1)) if opened < n else F.array().cast("array<int>"))
    parts = max(cores, min(TILES, n + n * (n - opened)))
    row = [F.col(c).alias(c) for c in ("id", "t", "y")]  # columns of their own for each side
    one = dealt.select(*row, F.col("_own").alias("_i"), F.explode(after).alias("_j")).repartition(parts, "_i", "_j")
    two = dealt.select(*row, F.explode(F.sequence("_low", "_own")).alias("_i"), F.col("_own").alias("_j")).repartition(parts, "_i", "_j")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return tile_pairs(left, right, least)

    return one.groupBy("_i", "_j").cogroup(two.groupBy("_i", "_j")).applyInPandas(meet, "a long, b long, sim double")
