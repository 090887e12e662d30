"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last sixteen bytes rates every place; a chunk ends where a rating is the largest
within ``REACH`` bytes on both sides (at white space where there is any), so an insertion moves only the
chunks around it. Chunks are posted by digest; the first place of each digest (smallest document, then
position) stays, all others are repeats. Neighbouring repeats join into runs. As short chunks repeat by
chance, a run counts only as far as it holds chunks that follow one source at one distance for at
least ``STRONG_WORDS`` words or ``STRONG_BYTES`` bytes; from ``MIN_WORDS`` words or ``MIN_BYTES`` bytes on it is a
repeated span, so that texts without spaces have theirs too. A chunk that some of a task's rows repeat is
posted once for all of them, and what is found about it comes back to them, so a chunk that a third of all documents hold
costs one posting a task, and spans don't depend on the partitions.

A document that repeats its own passages has repeated spans too. Null and empty texts and rows without an id have no
chunks: they repeat nothing and stay. Rows that agree in id and text are one document; rows that only share an id are
documents of their own, which come after all others (``numbered``). A text without
white space is cut at character bounds, every 255 bytes at the latest. Ties are settled by document
and position. Empty tables give no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import SHARED_IDS, U64, Bloom, Scratch, bucket_count, by_key, free_name, key_runs, mix64, numbered, slices, text_bytes

REACH = 24
MIN_WORDS = 20
STRONG_WORDS = 14
MIN_BYTES = 16 * MIN_WORDS
STRONG_BYTES = 16 * STRONG_WORDS
MOST_BYTES = 255
SPANS = "array<struct<start:int,length:int>>"

_GEAR = (mix64(np.arange(256, dtype=U64), 31) >> U64(40)).astype(np.uint32)
_BYTE = mix64(np.arange(256, dtype=U64), 32)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POST = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("length", "u1"), ("words", "u1"), ("task", "<i8")])
_AGAIN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("length", "u1"), ("words", "u1")])
_FIRST = np.dtype([("h", "<u8"), ("first", "<i8"), ("place", "<u4")])
_REPEAT = np.dtype([("doc", "<i8"), ("start", "<u4"), ("length", "u1"), ("words", "u1"), ("first", "<i8"), ("place", "<u4")])
_PAD = 48  # zero bytes between texts, so that nothing sees its neighbour


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  one table for each worker
    if len(cache.get("up", ())) < n:
        size = max(1 << 18, 1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, base, U64)
                x[0] = 1
                cache[name] = np.multiply.accumulate(x)
    return cache["up"][:n], cache["down"][:n]


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of h = 2h + gear[byte]: they depend on the last 16 bytes only."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h & np.uint32(0xFFFF)


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each chunk its text's index, start in the text, length, words and digest."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    fresh = np.append((data[1:] & 0xC0) != 0x80, True)  # a character ends here
    place = np.arange(n) + _PAD * np.repeat(np.arange(1, len(starts)), np.diff(starts))
    wide = np.zeros(n + _PAD * len(starts), np.uint8)
    wide[place] = data
    h = gear_hash(wide)[place].astype(np.int32)
    rating = np.zeros(len(wide), np.int32)
    rating[place] = np.where(space, h + 1025, np.where(fresh, (h >> 6) + 1, 0))
    most = rating.copy()  # the largest of the last 16, then of the last REACH ratings
    for k in (1, 2, 4, 8):
        most[k:] = np.maximum(most[k:], most[:-k])
    most[REACH - 16 :] = np.maximum(most[REACH - 16 :], most[: 16 - REACH or None])
    before, after = most[place - 1], most[np.minimum(place + REACH, len(wide) - 1)]
    rating = rating[place]
    ends = (rating > before) & (rating >= after)
    bound = np.zeros(n + 1, bool)
    bound[1:] = ends
    bound[starts] = True
    at = np.flatnonzero(bound)
    far = np.flatnonzero(np.diff(at) > MOST_BYTES)
    if len(far):
        more = []
        for i in far:
            a, b = int(at[i]), int(at[i + 1])
            while b - a > MOST_BYTES:
                c = a + MOST_BYTES
                while c > a + MOST_BYTES - 4 and not fresh[c - 1]:
                    c -= 1
                more.append(c)
                a = c
        at = np.union1d(at, more)
    begin, end = at[:-1], at[1:]
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.add.accumulate(_BYTE[data] * up)))
        digest = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64), 33)
    first = ~space
    first[1:] &= space[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = ~space[inner]
    count = np.concatenate(([0], np.cumsum(first)))
    doc = np.searchsorted(starts, begin, "right") - 1
    return doc, begin - starts[doc], end - begin, count[end] - count[begin], digest


def _settle(posts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each digest, the repeats, and the index of each repeat's first place."""
    order = np.lexsort((posts["start"], posts["doc"], posts["h"]))
    posts = posts[order]
    head = np.ones(len(posts), bool)
    head[1:] = posts["h"][1:] != posts["h"][:-1]
    first = np.cumsum(head) - 1
    firsts = posts[head]
    # a document that is there twice doesn't repeat itself
    again = (posts["doc"] != firsts["doc"][first]) | (posts["start"] != firsts["start"][first])
    again[1:] &= head[1:] | (posts["doc"][1:] != posts["doc"][:-1]) | (posts["start"][1:] != posts["start"][:-1])
    return firsts, posts[again], first[again]


def _as_repeats(firsts: np.ndarray, again: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(again), _REPEAT)
    for name in ("doc", "start", "length", "words"):
        out[name] = again[name]
    out["first"], out["place"] = firsts["doc"][first], firsts["start"][first]
    return out


# kinds of packed rows
POSTED, AGAIN, SETTLED, FOUND = range(4)


def _spread(rows: np.ndarray, key: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(rows) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(rows))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key[cut].astype(np.int64)),
            pa.array([kind] * len(cut), pa.int32()),
            pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ],
        ["key", "kind", "posts"],
    )


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.astype(U64), 34) % U64(buckets)).astype(np.int64)


def _packed(rows: list[tuple], kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[1] for r in rows if r[0] == kind), dtype)


def _posts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each digest's first place in a part of the task's rows by the digest's bucket, and under the part's own key those after it."""
    held, size, task = [], 0, -1 - (TaskContext.get().partitionId() << 24)

    def out() -> Iterator[pa.RecordBatch]:
        firsts, again, first = _settle(np.concatenate(held))
        firsts["task"] = 0
        firsts["task"][first] = task  # 0: nobody waits for an answer
        yield _spread(firsts, (firsts["h"] % U64(buckets)).astype(np.int64), POSTED)
        if len(again):
            rows = np.zeros(len(again), _AGAIN)
            for name in _AGAIN.names:
                rows[name] = again[name]
            yield _spread(rows, np.full(len(rows), task), AGAIN)

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, starts = text_bytes(batch.column(1))
        for i, j in slices(starts):
            doc, start, length, n, digest = chunks(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            rows = np.zeros(len(doc), _POST)
            rows["h"], rows["doc"], rows["start"], rows["length"] = digest, ids[i + doc], start, length
            rows["words"] = np.minimum(n, 255)
            held.append(rows)
            size += len(rows)
            if size >= 1 << 18:
                yield from out()
                held, size, task = [], 0, task - 1
    if size:
        yield from out()


def _repeats(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Repeats by their document's bucket, and for parts of tasks that wait the first places of their digests."""
    for (key,), rows in key_runs(batches, 1):
        if key < 0:
            yield _spread(np.concatenate([np.frombuffer(r[1], _AGAIN) for r in rows]), np.full(sum(len(r[1]) // _AGAIN.itemsize for r in rows), key), AGAIN)
            continue
        posts = _packed(rows, POSTED, _POST)
        firsts, again, first = _settle(posts)
        if len(again):
            yield _spread(_as_repeats(firsts, again, first), _doc_bucket(again["doc"], buckets), FOUND)
        waits = posts[posts["task"] < 0]
        if len(waits):
            at = np.searchsorted(firsts["h"], waits["h"])
            known = np.zeros(len(waits), _FIRST)
            known["h"], known["first"], known["place"] = waits["h"], firsts["doc"][at], firsts["start"][at]
            yield _spread(known, waits["task"], SETTLED)


def _answered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """All repeats by their document's bucket: those of waiting parts of tasks meet the first places of their digests."""
    for (key,), rows in key_runs(batches, 1):
        if key >= 0:
            found = _packed(rows, FOUND, _REPEAT)
            yield _spread(found, np.full(len(found), key), FOUND)
            continue
        again, known = _packed(rows, AGAIN, _AGAIN), _packed(rows, SETTLED, _FIRST)
        known = known[np.argsort(known["h"])]
        at = np.searchsorted(known["h"], again["h"])
        out = np.zeros(len(again), _REPEAT)
        for name in ("doc", "start", "length", "words"):
            out[name] = again[name]
        out["first"], out["place"] = known["first"][at], known["place"][at]
        yield _spread(out, _doc_bucket(out["doc"], buckets), FOUND)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in key_runs(batches, 1):
        r = np.frombuffer(b"".join(x[1] for x in rows), _REPEAT)
        r = r[np.lexsort((r["start"], r["doc"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] != r["start"][:-1])
        r = r[new]
        end = r["start"].astype(np.int64) + r["length"]
        words = r["words"].astype(np.int64)
        new = np.ones(len(r), bool)
        new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] != end[:-1])
        run = np.cumsum(new) - 1
        # within a run, chunks that follow one source at one distance
        away = r["place"].astype(np.int64) - r["start"]
        order = np.lexsort((away, r["first"], run))
        line = np.ones(len(r), bool)
        line[1:] = (run[order][1:] != run[order][:-1]) | (r["first"][order][1:] != r["first"][order][:-1]) | (away[order][1:] != away[order][:-1])
        cut = np.flatnonzero(line)
        strong = np.zeros(len(r), bool)
        size = np.add.reduceat(r["length"][order].astype(np.int64), cut)
        strong[order] = ((np.add.reduceat(words[order], cut) >= STRONG_WORDS) | (size >= STRONG_BYTES))[np.cumsum(line) - 1]
        at = np.flatnonzero(strong)
        if not len(at):
            continue
        head = np.flatnonzero(np.concatenate(([True], run[at][1:] != run[at][:-1])))
        low, high = at[head], at[np.append(head[1:], len(at)) - 1]
        total = np.concatenate(([0], np.cumsum(words)))
        keep = (total[high + 1] - total[low] >= MIN_WORDS) | (end[high] - r["start"][low] >= MIN_BYTES)
        low, high = low[keep], high[keep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(r["doc"][low]),
                pa.array(r["start"][low].astype(np.int64)),
                pa.array(end[high] - r["start"][low]),
                pa.array(total[high + 1] - total[low]),
                pa.array([np.unique(r["first"][i : j + 1][strong[i : j + 1]]).tolist() for i, j in zip(low, high, strict=True)], pa.list_(pa.int64())),
            ],
            ["doc_id", "start_byte", "n_bytes", "n_words", "source_doc_ids"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """A row for each repeated span: (doc_id, start_byte, n_bytes, n_words, source_doc_ids).

    Offsets count UTF-8 bytes; ``source_doc_ids`` are the documents whose first occurrences it repeats. Of rows that only
    share an id each has spans of its own.
    """
    rows, shared = numbered(docs.select("doc_id", "text"), "number")
    found = _spans(rows.select(F.col("number").alias("doc_id"), "text"))
    if not shared:
        return found
    # numbers of rows that share ids become ids again
    found = Scratch(docs.sparkSession, "cdc").write(found)
    names = rows.where(F.col("number") >= SHARED_IDS).select("number", F.col("doc_id").cast("long").alias("name")).distinct()
    other = F.exists("source_doc_ids", lambda x: x >= SHARED_IDS)
    key = ["doc_id", "start_byte", "n_bytes", "n_words"]
    each = found.where(other).select(*key, F.explode("source_doc_ids").alias("number")).join(names, "number", "left")
    each = each.groupBy(*key).agg(F.array_sort(F.collect_set(F.coalesce("name", "number"))).alias("source_doc_ids"))
    whole = found.where(~other).unionByName(each).join(names, F.col("doc_id") == F.col("number"), "left")
    return whole.select(F.coalesce("name", "doc_id").alias("doc_id"), *key[1:], "source_doc_ids")


def _spans(base: DataFrame) -> DataFrame:
    """``repeated_spans`` of rows (doc_id, text), where equal ids mean equal texts."""
    packed = "key long, kind int, posts binary"
    n = bucket_count(base)
    posts = base.mapInArrow(lambda batches: _posts(batches, n), packed)
    again = by_key(posts, ["key"]).mapInArrow(lambda batches: _repeats(batches, n), packed)
    found = by_key(again, ["key"]).mapInArrow(lambda batches: _answered(batches, n), packed)
    schema = "doc_id long, start_byte long, n_bytes long, n_words long, source_doc_ids array<long>"
    return by_key(found, ["key"]).mapInArrow(_runs, schema)


def _cut(column: int, spans: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], [True] * batch.num_rows
            for text, cuts in zip(batch.column(column), batch.column(spans), strict=True):
                if not cuts.is_valid:
                    texts.append(text.as_py())
                    continue
                raw, out, at = (text.as_py() or "").encode(), [], 0
                for c in sorted(cuts.as_py(), key=lambda c: c["start"]):
                    out.append(raw[at : c["start"]])
                    at = c["start"] + c["length"]
                out.append(raw[at:])
                texts.append(b"".join(out).decode("utf-8", "replace"))
                keep[len(texts) - 1] = bool(texts[-1].strip())
            columns = [pa.array(texts, pa.string()) if i == column else c for i, c in enumerate(batch.columns) if i != spans]
            yield pa.RecordBatch.from_arrays(columns, [n for i, n in enumerate(batch.schema.names) if i != spans]).filter(pa.array(keep, pa.bool_()))

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without their repeated spans; documents that were cut and of which only white space is left go.

    The spans are one small row for each document concerned; only texts that a Bloom table of those
    documents lets through move, to meet them. Untouched documents stay as they are, empty ones too.
    """
    number, cut, key = (free_name(docs.columns, n) for n in ("number", "cuts", "key"))
    rows, _ = numbered(docs, number)
    spans = Scratch(spark, "cdc").write(_spans(rows.select(F.col(number).alias("doc_id"), "text")))
    one = F.struct(F.col("start_byte").cast("int").alias("start"), F.col("n_bytes").cast("int").alias("length"))
    cuts = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(one).alias(cut))
    some = Bloom.of(cuts.select(key))
    at, text, last = rows.columns.index(number), docs.columns.index("text"), len(docs.columns)
    both = some.where(rows, at).join(cuts, F.col(number) == F.col(key), "left").select(*docs.columns, cut)
    out = both.mapInArrow(_cut(text, last), docs.schema)
    return out.unionByName(some.where(rows, at, within=False).select(*docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
