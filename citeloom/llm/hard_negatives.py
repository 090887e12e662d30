"""Hard-negative mining by product quantisation with stored residual norms.

Vectors become integers floor(scale * x) and are cut into parts of about four components. A codebook for each part is fitted on
a bounded sample; it decides how tight the bounds are, never the result. All rows are stored as codes, the norm of what each
code leaves of its part (rounded up), and the integers. An anchor's score with a row is looked up in a table of its parts'
products with the entries; it is off by no more than the sum of the products of the parts' norms and the residuals' norms, so
a row whose upper bound misses a window, or the last of the best found so far, can't be wanted. All others are
scored exactly in integers.

Anchors are searched in slices of ``SLICE`` (16 MB at 64 components), each of which is broadcast and meets all rows where these lie: first a
64th of the rows, whose best give the rest rigorous thresholds, so that tasks send little more than what is wanted; then all.
Positives are windows without bounds over rows of the anchor's label; each positive opens a window for negatives. Of equal
scores the smaller id is first, so a vector that a third of all rows share fills a window with its smallest ids and every task
sends at most a window's rows.

Rows whose label or id is null, or whose vector is null or holds null or non-finite components, take no part; neither
do vectors of another length than most (of equally frequent lengths the largest counts), which have no product with them. Rows that repeat an id are
rows of their own: each is another row than the anchor, and an anchor that is there twice is searched twice. A positive with a
negative score has an empty window. Products must fit in longs: larger components raise. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, finite, mix64, usual_length

SCALE, PART, ENTRIES = 256, 4, 256
SAMPLE = 4096  # rows that the codebooks are fitted on
SLICE = 65_536  # anchors that are broadcast at once
HELD, BLOCK, CHUNK = 16_384, 256, 2048  # rows that a task holds, anchors and rows that it scores at once
FIRST = 64  # one row of so many is searched first
NONE = -(2**63) + 1
EVERY = 2**63 - 1


def part_bounds(dim: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, dim, math.ceil(dim / PART) + 1).round().astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def fit_codebooks(sample: np.ndarray, entries: int = ENTRIES, rounds: int = 6, seed: int = 5) -> list[np.ndarray]:
    """For each part up to ``entries`` centres of the sample's parts, by Lloyd's rounds."""
    rng, books = np.random.default_rng(seed), []
    for a, b in part_bounds(sample.shape[1]):
        x = sample[:, a:b].astype(np.float64)
        centre = np.unique(x[rng.permutation(len(x))[:entries]], axis=0)
        for _ in range(rounds):
            near = _nearest(x, centre)
            n = np.bincount(near, minlength=len(centre))
            total = np.stack([np.bincount(near, x[:, i], len(centre)) for i in range(b - a)], 1)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        books.append(centre)
    return books


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None] - 2 * x @ centre.T).argmin(1)


def quantise(q: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's codes (bytes) and the norms of its parts' residuals, rounded up to floats."""
    codes, norms = np.zeros((len(q), len(books)), np.uint8), np.zeros((len(q), len(books)), np.float32)
    for m, ((a, b), book) in enumerate(zip(part_bounds(q.shape[1]), books, strict=True)):
        x = q[:, a:b].astype(np.float64)
        codes[:, m] = _nearest(x, book)
        norms[:, m] = np.nextafter((np.linalg.norm(x - book[codes[:, m]], axis=1) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
    return codes, norms


def score_bounds(anchors: np.ndarray, books: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of anchors with coded rows from lookup tables, and how far each may be off."""
    score = np.zeros((len(anchors), len(codes)), np.float32)
    own = np.zeros((len(anchors), len(books)), np.float32)
    slack = np.zeros(len(anchors))
    for m, ((a, b), book) in enumerate(zip(part_bounds(anchors.shape[1]), books, strict=True)):
        part = anchors[:, a:b].astype(np.float64)
        table = (part @ book.T).astype(np.float32)
        score += np.take(table, codes[:, m], axis=1)
        size = np.linalg.norm(part, axis=1)
        own[:, m] = size
        slack += size * np.linalg.norm(book, axis=1).max(initial=0)
    # rounding of floats: each term and each partial sum is off by 2^-24 of the terms' sizes at most
    off = (own @ norms.T) * np.float32(1 + 1e-5) + (slack * (len(books) + 2) * 2.0**-23 + 1e-3)[:, None].astype(np.float32)
    return score, off


def _bytes_matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of rows of equal sizes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _encode(dim: int, scale: int, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _integers(np.asarray(batch.column(3).flatten(), dtype=np.float64).reshape(-1, dim), scale)
            codes, norms = quantise(q, books)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.astype("<i4"), codes, norms.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), *packed], ["row", "id", "label", "anchor", "q", "codes", "norms"])

    return run


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(scale * x)
    if y.size and not np.abs(y).max() < min(2**31, math.isqrt((2**63 - 1) // x.shape[1])):
        raise ValueError("components are too large for scores in longs")
    return y.astype(np.int64)


class Best:
    """For each window (anchor, slot) the best rows so far: scores downwards, equal ones by id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.score = np.full((slots, anchors, k), NONE, np.int64)
        self.id = np.zeros((slots, anchors, k), np.int64)

    def add(self, slot: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(anchor):
            return
        k = self.score.shape[2]
        touched = np.unique(anchor)
        a = np.concatenate((np.repeat(touched, k), anchor))
        s = np.concatenate((self.score[slot, touched].ravel(), score))
        i = np.concatenate((self.id[slot, touched].ravel(), ids))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        first = np.searchsorted(a, touched)
        place = first[:, None] + np.arange(k)[None]
        self.score[slot, touched], self.id[slot, touched] = s[place], i[place]


def _search(shared, same: bool, k: int):
    """The best ``k`` rows of a partition in each window of a slice's anchors: (anchor, slot, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        q, books, high, least = own["q"], own["books"], own["high"], own["least"]  # high, least: slots x anchors
        best, dim = Best(len(q), len(high), k), q.shape[1]

        def look(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, r: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
            for lo in range(0, len(q), BLOCK):
                cut = slice(lo, lo + BLOCK)
                for at in range(0, len(ids), CHUNK):
                    these = slice(at, at + CHUNK)
                    need = np.maximum(least[:, cut], best.score[:, cut, -1])
                    score, off = score_bounds(q[cut], books, codes[these], norms[these])
                    wanted = np.zeros(score.shape, bool)
                    for s in range(len(high)):
                        wanted |= (score + off >= need[s][:, None]) & (score - off <= high[s, cut][:, None])
                    wanted &= (own["label"][cut][:, None] == labels[these][None]) == same
                    wanted &= own["row"][cut][:, None] != rows[these][None]
                    i, j = np.nonzero(wanted)
                    for p in range(0, len(i), 1 << 16):
                        a, b = i[p : p + (1 << 16)], at + j[p : p + (1 << 16)]
                        exact = np.einsum("ij,ij->i", q[lo + a], r[b])
                        for s in range(len(high)):
                            ok = (exact >= need[s][a]) & (exact <= high[s, lo + a])
                            best.add(s, lo + a[ok], exact[ok], ids[b[ok]])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                look(*_laid(held, dim, len(books)))
                held, size = [], 0
        if size:
            look(*_laid(held, dim, len(books)))
        slot, anchor, place = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own["row"][anchor]), pa.array(slot.astype(np.int32)), pa.array(best.score[slot, anchor, place]), pa.array(best.id[slot, anchor, place])],
            ["anchor", "slot", "score", "id"],
        )

    return run


def _laid(held: list[pa.RecordBatch], dim: int, parts: int) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, rows, labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
    r = _bytes_matrix(table.column("q"), "<i4", dim).astype(np.int64)
    return ids, rows, labels, r, _bytes_matrix(table.column("codes"), "u1", parts), _bytes_matrix(table.column("norms"), "<f4", parts)


def mine_negatives(
    spark: SparkSession, vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", sample: int = SAMPLE, slice_size: int = SLICE,
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of its label: the best ``negatives`` rows of other labels that score
    from ``low`` percent of the positive's score up to all of it.

    Returns (anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score). The codebooks are fitted
    on at most ``sample`` rows.
    """
    scratch = Scratch(spark, "negatives")
    base = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    dim = usual_length(base, "v")
    schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    if dim is None:
        return spark.createDataFrame([], schema)
    base = scratch.write(base.where(F.size("v") == dim))
    some = base.select("v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(sample).collect()
    books = fit_codebooks(_integers(np.array([r["v"] for r in some], np.float64), scale))
    packed = "row long, id long, label long, anchor boolean, q binary, codes binary, norms binary"
    coded = scratch.write(base.mapInArrow(_encode(dim, scale, books), packed))
    anchors = coded.where("anchor").select("row", "id", "label", "q")
    n_slices = max(1, math.ceil(anchors.count() / slice_size))
    rows = coded.select("row", "id", "label", "q", "codes", "norms")
    first = rows.where(F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0)
    out = []
    for i in range(n_slices):
        mine = anchors.where(F.pmod(F.hash("row"), F.lit(n_slices)) == i).toArrow()  # a slice: bounded
        if not mine.num_rows:
            continue
        order = np.argsort(mix64(mine.column("row").to_numpy().astype(np.uint64), 5))
        mine = mine.take(pa.array(order)).combine_chunks()
        own = {"row": mine.column("row").to_numpy(), "label": mine.column("label").to_numpy(), "books": books}
        own["q"] = _bytes_matrix(mine.column("q"), "<i4", dim).astype(np.int64)
        n = len(own["row"])
        found = _windows(spark, scratch, rows, first, own | {"high": np.full((1, n), EVERY), "least": np.full((1, n), NONE + 1)}, True, positives)
        high, least = np.full((positives, n), NONE), np.full((positives, n), EVERY)  # empty windows
        kept = found.select("anchor", "rank", "score").toArrow()  # of a slice's anchors
        by_row = np.argsort(own["row"])
        a = by_row[np.searchsorted(own["row"], kept.column("anchor").to_numpy(), sorter=by_row)]
        slot, score = kept.column("rank").to_numpy() - 1, kept.column("score").to_numpy()
        high[slot, a] = score
        least[slot, a] = score - _floor_share(score, 100 - low)
        hard = _windows(spark, scratch, rows, first, own | {"high": high, "least": least}, False, negatives)
        pos = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        neg = hard.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        both = neg.join(pos, ["anchor", "slot"]).join(names, "anchor").withColumn("positive_rank", F.col("slot") + 1)
        out.append(scratch.write(both.select(*[c.split()[0] for c in schema.split(", ")])))
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _floor_share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) of longs, without overflow."""
    whole, rest = np.divmod(score, 100)
    return percent * whole + percent * rest // 100


def _windows(spark: SparkSession, scratch: Scratch, rows: DataFrame, first: DataFrame, own: dict, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of each window, over all rows: (anchor, slot, rank, score, id)."""
    schema = "anchor long, slot int, score long, id long"

    def best(df: DataFrame) -> DataFrame:
        found = df.mapInArrow(_search(spark.sparkContext.broadcast(own), same, k), schema)
        rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # what the first rows have at rank k bounds the rest from below
    floor = best(first).where(F.col("rank") == k).select("anchor", "slot", "score").toArrow()
    least = own["least"].copy()
    by_row = np.argsort(own["row"])
    a = by_row[np.searchsorted(own["row"], floor.column("anchor").to_numpy(), sorter=by_row)]
    slot = floor.column("slot").to_numpy()
    least[slot, a] = np.maximum(least[slot, a], floor.column("score").to_numpy())
    own = own | {"least": least}
    return scratch.write(best(rows).select("anchor", "slot", "rank", "score", "id"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = mine_negatives(spark, vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS positive_id, p.s AS positive_score, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, positive_id, r::INT AS rank, b AS negative_id, positive_score, s AS negative_score FROM n WHERE r <= 5
"""
