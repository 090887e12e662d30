"""Benchmark decontamination with a distributed positional inverted index.

The index is built once, for all items, and cut by documents: a shard holds, for some hundred thousand words of whole
documents, each test term's postings (positions in the shard), sorted by term and position, and is stored as one row of
a table. A search takes an item's windows of ten consecutive words, starts from the postings of the
window's rarest term over the whole corpus and intersects the offset-adjusted lists of the next rarest
terms. What is left are exact phrase occurrences; proximity matches are windows whose three rarest
terms lie near their places though the phrase as a whole doesn't.

Items are searched in slices of bounded size: each reads the index, not the documents, and holds its windows in packed
arrays of about twenty bytes a byte of text. Terms are 64-bit hashes of words.

Words: A-Z lower-cased, then runs of digits, a-z and anything outside ASCII. Null and empty texts have
no words; an item shorter than a window is one window, one without words none. Every row of documents gives one row: a
null or repeated id doesn't matter, as rows are told apart by their place in the index. Items that
share an id count once. Empty tables give documents without hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import U64, Bloom, Scratch, mix64, slices, text_bytes, word_hashes

WINDOW = 10
NEAR = 2  # words that a proximity match may be off
GAP = WINDOW + 2 * NEAR + 1
SLICE_BYTES = 8_000_000  # of item text that one search holds
SHARD_WORDS = 400_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
SPAN = "struct<item:string,start:int,length:int>"
_INDEX = "shard long, doc_ids array<long>, doc_words array<int>, terms binary, bounds binary, posts binary"
_FOUND = f"shard long, at int, spans array<{SPAN}>, near_items array<string>"


class Windows:
    """The distinct windows of some items, as numbers of their terms, in packed arrays."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        data, starts = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        words, at = word_hashes(data, starts, _IN_WORD)
        self.terms, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int32)
        parts, owners = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int32)]
        for k, (item, _) in enumerate(items):
            own = ids[at[k] : at[k + 1]]
            if len(own) >= WINDOW:
                parts.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW))
            elif len(own):
                parts.append(np.concatenate((own, np.full(WINDOW - len(own), -1, np.int32)))[None])
            else:
                continue
            owners.append(np.full(len(parts[-1]), number[item], np.int32))
        rows, owner = np.concatenate(parts), np.concatenate(owners)
        key = np.zeros(len(rows), U64)
        for j in range(WINDOW):
            key = mix64(key ^ (rows[:, j].astype(np.int64) + 2).astype(U64), j)
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        other = np.flatnonzero((rows[first[group]] != rows).any(1))  # of equal keys, rows that differ stand alone
        group[other] = len(first) + np.arange(len(other))
        self.rows = rows[np.concatenate((first, other))]
        self.sizes = (self.rows >= 0).sum(1)
        pairs = np.unique(group.astype(np.int64) << 32 | owner)
        self.owner = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.owner_at = np.searchsorted(pairs >> 32, np.arange(len(self.rows) + 1))

    def owners(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.owner_at[window] : self.owner_at[window + 1]].tolist()]

    def rank(self, counts: np.ndarray) -> None:
        """Put each window's terms in order from the rarest over the corpus to the commonest, with their offsets."""
        often = np.where(self.rows < 0, np.iinfo(np.int64).max, counts[self.rows])
        order = np.argsort(often, axis=1, kind="stable")
        self.term, self.offset = np.take_along_axis(self.rows, order, 1), order.astype(np.int8)
        del self.rows


def _firsts(sizes: list[int]) -> np.ndarray:
    """Each document's first position in its shard; gaps keep phrases and near matches inside a document."""
    return np.cumsum([GAP, *(s + GAP for s in sizes)])[:-1]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_bytes(batch.column(0))
        for i, j in slices(starts):
            found = np.unique(word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], _IN_WORD)[0])
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["term"])


def _build(shared, bits: int):
    """Index shards of some documents, over the terms that the Bloom table of test terms lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = shared.value, TaskContext.get().partitionId() << 32
        ids, sizes, parts, total = [], [], [], 0

        def out() -> pa.RecordBatch:
            term = np.concatenate(parts) if parts else np.zeros(0, U64)
            start = _firsts(sizes)
            place = np.repeat(start - np.cumsum([0, *sizes])[:-1], sizes) + np.arange(len(term))
            keep = Bloom.holds(table, bits, term)
            place, term = place[keep], term[keep]
            order = np.argsort(term, kind="stable")
            place, term = place[order], term[order]
            cut = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            packed = [term[cut].astype("<u8"), np.append(cut, len(term)).astype("<u4"), place.astype("<u4")]
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))]
            columns = [pa.array([shard], pa.int64()), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "doc_words", "terms", "bounds", "posts"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, starts = text_bytes(batch.column(1))
            for i, j in slices(starts):
                words, at = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], _IN_WORD)
                ids += names[i:j]
                sizes += np.diff(at).tolist()
                parts.append(words)
                total += len(words) + GAP * (j - i)
                if total >= SHARD_WORDS:
                    yield out()
                    shard, ids, sizes, parts, total = shard + 1, [], [], [], 0
        if ids:
            yield out()

    return run


def _lists(win: Windows, terms: bytes, bounds: bytes, posts: bytes) -> tuple[np.ndarray, ...]:
    """A shard's lists of the windows' terms: their numbers, bounds and postings."""
    term, bound, post = np.frombuffer(terms, "<u8"), np.frombuffer(bounds, "<u4").astype(np.int64), np.frombuffer(posts, "<u4")
    if not len(term) or not len(win.terms):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(win.terms, term), len(win.terms) - 1)
    known, size = win.terms[at] == term, np.diff(bound)
    return at[known], np.concatenate(([0], np.cumsum(size[known]))), post[np.repeat(known, size)].astype(np.int64)


def _term_counts(shared):
    """Occurrences of each term of the windows in a partition's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared.value
        counts = np.zeros(len(win.terms), np.int64)
        for batch in batches:
            for terms, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term, size = np.frombuffer(terms, "<u8"), np.diff(np.frombuffer(bounds, "<u4").astype(np.int64))
                if len(term) and len(counts):
                    at = np.minimum(np.searchsorted(win.terms, term), len(counts) - 1)
                    known = win.terms[at] == term
                    counts[at[known]] += size[known]
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["term", "n"])

    return run


def _find(win: Windows, terms: np.ndarray, bounds: np.ndarray, posts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, start) of exact occurrences and of proximity matches in one shard."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(win.term):
        return none, none, none, none
    span = int(posts.max()) + 2 * WINDOW + 2
    size = np.diff(bounds)
    key = np.repeat(terms, size) * span + posts  # sorted by term and position: all lists in one
    at = np.searchsorted(terms, win.term[:, 0])
    at[at == len(terms)] = 0
    live = np.flatnonzero(terms[at] == win.term[:, 0])
    at = at[live]
    window = np.repeat(live, size[at])
    begin = np.repeat(bounds[at] - np.cumsum(np.concatenate(([0], size[at][:-1]))), size[at]) + np.arange(len(window))
    start = posts[begin] - win.offset[window, 0]
    window, start = window[start >= 0], start[start >= 0]

    def holds(window: np.ndarray, start: np.ndarray, j: int, shift: int = 0) -> np.ndarray:
        term, place = win.term[window, j].astype(np.int64), start + win.offset[window, j] + shift
        wanted = term * span + place
        i = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return (term < 0) | ((key[i] == wanted) & (place >= 0))

    near = np.ones(len(window), bool)
    for j in (1, 2):
        ok = np.zeros(len(window), bool)
        for shift in range(-NEAR, NEAR + 1):
            ok |= holds(window, start, j, shift)
        near &= ok
    near_window, near_start = window[near], start[near]
    window, start = near_window, near_start  # an exact match is a proximity match
    for j in range(1, WINDOW):
        keep = holds(window, start, j)
        window, start = window[keep], start[keep]
    return window, start, near_window, near_start


def _search(shared):
    """Documents with matches, by shard and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared.value
        for batch in batches:
            for shard, sizes, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                window, start, near_window, near_start = _find(win, *_lists(win, *packed))
                first = _firsts(sizes)
                spans: dict[int, list[dict]] = {}
                doc = np.searchsorted(first, start, "right") - 1
                by_item: dict[tuple[int, str], list[tuple[int, int]]] = {}
                for w, s, d in zip(window.tolist(), (start - first[doc]).tolist(), doc.tolist(), strict=True):
                    for item in win.owners(w):
                        by_item.setdefault((d, item), []).append((s, int(win.sizes[w])))
                for (d, item), found in by_item.items():
                    found.sort()
                    low, high = found[0][0], 0
                    for s, n in found:
                        if high and s > high:
                            spans.setdefault(d, []).append({"item": item, "start": low, "length": high - low})
                            low = s
                        high = max(high, s + n)
                    spans.setdefault(d, []).append({"item": item, "start": low, "length": high - low})
                close: dict[int, set[str]] = {}
                doc = np.searchsorted(first, near_start, "right") - 1
                for w, d in set(zip(near_window.tolist(), doc.tolist(), strict=True)):
                    close.setdefault(d, set()).update(x for x in win.owners(w) if (d, x) not in by_item)
                ids = sorted({*spans, *(d for d, x in close.items() if x)})
                kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(ids), pa.int64()),
                        pa.array(ids, pa.int32()),
                        pa.array([spans.get(d, []) for d in ids], kind),
                        pa.array([sorted(close.get(d, ())) for d in ids], pa.list_(pa.string())),
                    ],
                    ["shard", "at", "spans", "near_items"],
                )

    return run


def _item_slices(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The items' (id, text), at most SLICE_BYTES of text at a time where no single item is longer."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // SLICE_BYTES) if total > SLICE_BYTES else 1)
    for k in range(n):
        yield [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]


def phrase_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each document: (doc_id, n_words, spans, near_items).

    ``spans``: for each item, merged runs of words (item, start, length) inside exact window occurrences;
    ``near_items``: items with proximity matches only.
    """
    scratch = scratch or Scratch(spark, "decontam")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = Bloom.of(scratch.write(items.select("text").mapInArrow(_item_terms, "term long").distinct()))
    index = scratch.write(base.mapInArrow(_build(terms.shared, terms.bits), _INDEX))
    found = []
    for items_now in _item_slices(items):
        win = Windows(items_now)
        counts = np.zeros(max(1, len(win.terms)), np.int64)
        parts = index.select("terms", "bounds").mapInArrow(_term_counts(spark.sparkContext.broadcast(win)), "term long, n long")
        for r in parts.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # the slice's terms at most
            counts[r.term] = r.n
        win.rank(counts)
        matches = index.select("shard", "doc_words", "terms", "bounds", "posts").mapInArrow(_search(spark.sparkContext.broadcast(win)), _FOUND)
        found.append(scratch.write(matches))
    hits = reduce(DataFrame.unionByName, found)
    if len(found) > 1:  # an item's windows are all in one slice
        hits = hits.groupBy("shard", "at").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("near_items")).alias("near_items"))
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("at", "d"))
    rows = rows.select("shard", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(hits, ["shard", "at"], "left").select("doc_id", "n_words", empty("spans", SPAN), empty("near_items", "string"))


def covered(spans: str = "spans"):
    """How many words lie in any of the spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))))

    def step(acc, s):
        end = s["start"] + s["length"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(sorted_spans, zero, step, lambda acc: acc["n"])


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document's hits: counts, the items' digest and whether it is contaminated."""
    found = phrase_matches(spark, docs, items)
    hit_items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return found.select(
        "doc_id",
        "n_words",
        covered().alias("n_hit"),
        F.size(hit_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit_items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    upper, gaps = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{gaps}'), lambda w: w <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {split} AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
i AS (SELECT item_id::VARCHAR AS item, {split} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, list_slice(w, s + 1, s + {WINDOW}) AS win FROM (SELECT item, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS s FROM i WHERE len(w) > 0)),
one AS MATERIALIZED (SELECT DISTINCT win FROM win),
n AS (SELECT word, count(*) AS n FROM dw GROUP BY 1),
t AS (SELECT win, unnest(win) AS word, generate_subscripts(win, 1) - 1 AS j FROM one),
r AS MATERIALIZED (SELECT win, t.word, j, row_number() OVER (PARTITION BY win ORDER BY coalesce(n.n, 0), j) AS r FROM t LEFT JOIN n ON t.word = n.word),
start AS MATERIALIZED (SELECT dw.doc_id, r.win, dw.pos - r.j AS s FROM r JOIN dw ON dw.word = r.word WHERE r.r = 1),
exact AS MATERIALIZED (SELECT start.doc_id, start.win, s FROM start JOIN d ON d.doc_id = start.doc_id WHERE s >= 0 AND list_slice(d.w, s + 1, s + len(win)) = win),
hits AS (SELECT DISTINCT doc_id, unnest(range(s, s + len(win))) AS pos FROM exact),
items AS MATERIALIZED (SELECT DISTINCT exact.doc_id, win.item FROM exact JOIN win ON win.win = exact.win),
near AS (SELECT DISTINCT start.doc_id, win.item FROM start JOIN win ON win.win = start.win
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.win = start.win AND r.r IN (2, 3) AND NOT EXISTS (
    SELECT 1 FROM dw WHERE dw.doc_id = start.doc_id AND dw.word = r.word AND abs(dw.pos - (start.s + r.j)) <= {NEAR})))
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items,
  sha256(coalesce(x.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(y.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) h ON h.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY 1) x ON x.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT * FROM near EXCEPT SELECT * FROM items) GROUP BY 1) y ON y.doc_id = d.doc_id
"""


ORACLE_OP6 = _oracle()
