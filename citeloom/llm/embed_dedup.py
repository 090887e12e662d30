"""Embedding near-dedup by sorted projection passes.

In each pass a vector gets the signs of 64 random projections as one number; ordered by it, vectors that
start with the same signs are neighbours, and every vector is compared with a bounded window of the next ones. What is
ordered is a byte for each component and the rounding error's norm, which bounds how far a cosine can be off: pairs that are surely
linked are joined within a task; pairs that could be either, and whose components are still apart when all passes are
united, are compared in double precision. Each component's links are then counted exactly, in double precision:

* vectors whose angles to the component's centre are at most half of the link angle are all linked with
  each other, so their links are the core's size, without any comparison;
* the others are compared with their whole component in blocks, which emit counts and no pairs.

The number of passes grows with the number of distinct vectors (``passes_for``), so that a lone pair at the
link angle before an even background meets in a window with a probability of ``RECALL``, whatever the table's
size. So what a window misses within a component is still counted; only a component that no pass connects is
lost (the recall against brute force and of such pairs is measured in the tests). Equal vectors are one vector with a
weight. Vectors that are null, zero or hold null or non-finite components link with nothing. Rows of one id with different vectors are
vectors of their own; a row without an id takes part like all others, a component's id is its smallest one, and null where it has
none. Labels are never looked at. Empty tables give no rows.

Where vectors have a common direction, most signs of a projection agree: so the mean of all unit vectors is taken off before the
signs are taken, and the number of passes follows the angle that a pair at the link angle has then. There are ``MOST_PASSES`` at most: where
the mean cosine comes so near to the links' that more would be needed (above 0.8 at 300,000 vectors), nearly all vectors are in
one component, and a lone pair in such a crowd meets with a lower probability than ``RECALL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, by_key, components, key_runs

COSINE = 0.9
PASSES, MOST_PASSES = 8, 256  # at least; at most, where nearly all vectors have one direction
RECALL = 0.99  # of lone pairs at the link angle
WINDOW = 512
BLOCK = 2048
#: How many components the packed vector ``v`` has.
_SIZE = "cast((octet_length(v) - 1) / if(substring(v, octet_length(v), 1) = x'01', 4, 8) as int)"
#: Two angles of at most this much can't add up to more than the link angle.
CORE = math.acos(COSINE) / 2 - 1e-7


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """How many passes ``n`` vectors need.

    Two vectors at the link angle share a sign with probability 1 - angle / pi. They are within a window once they share
    the log2(n / window) signs that leave about a window's vectors together.
    """
    signs = max(0.0, math.log2(max(n, 1) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    if meet >= 1:
        return PASSES
    return min(MOST_PASSES, max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet > 0 else MOST_PASSES))


def _vector(packed: bytes) -> np.ndarray:
    """A packed vector in double precision."""
    return np.frombuffer(packed, "<f4" if packed[-1] else "<f8", (len(packed) - 1) // (4 if packed[-1] else 8)).astype(np.float64)


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.stack([_vector(b) for b in packed])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors packed as floats where those hold them exactly, else as doubles, and which; null where they can't link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            good = len(x) and np.isfinite(x).all() and x.any()
            if good and not 1e-200 < (most := np.abs(x).max()) < 1e150:  # squares would over- or underflow: scaled by a power of two
                x = np.ldexp(x, -int(np.frexp(most)[1]))
            with np.errstate(over="ignore"):
                short = good and (x.astype(np.float32) == x).all()
            out.append((x + 0.0).astype("<f4" if short else "<f8").tobytes() + (b"\1" if short else b"\0") if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes, one row each: a scale and the norm of the rounding error (floats), then a byte for each component."""
    scale = (np.abs(x).max(1) / 127).astype("<f4")
    q = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1)
    head = np.stack((scale, np.nextafter(error.astype("<f4"), np.float32(1))), axis=1)
    return np.concatenate((np.ascontiguousarray(head).view(np.uint8), q.view(np.uint8)), axis=1)


def _restored(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors and their errors."""
    head = np.ascontiguousarray(rows[:, :8]).view("<f4")
    return rows[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _means(distinct: DataFrame, sizes: list) -> dict[int, tuple[int, float, np.ndarray]]:
    """For each length of vectors: how many there are, their unit vectors' mean's squared norm (the mean cosine), and the mean."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in _by_size(batch.column(0).to_pylist()).items():
                sums[size] = sums.get(size, 0) + _unit([batch.column(0)[i].as_py() for i in rows]).sum(0)
        flat = [(size, i, float(x)) for size, s in sums.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["size", "i", "s"])

    found: dict[int, np.ndarray] = {r["size"]: np.zeros(r["size"]) for r in sizes}
    sums = distinct.select("v").mapInArrow(partial, "size int, i int, s double").groupBy("size", "i").agg(F.sum("s").alias("s"))
    for r in sums.collect():  # a number for each component
        found[r["size"]][r["i"]] = r["s"]
    return {r["size"]: (r["n"], float(m @ m), m) for r in sizes for m in [found[r["size"]] / r["n"]]}


def _by_size(packed: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(packed):
        out.setdefault((len(b) - 1) // (4 if b[-1] else 8), []).append(i)
    return out


def centred_cosine(cosine: float, common: float) -> float:
    """What a cosine of two usual vectors becomes once their mean is taken off, where ``common`` is the mean cosine."""
    return max(0.0, (cosine - common) / (1 - common)) if common < 1 else 0.0


def _codes(passes: int, bits: int, seed: int, means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed = part.column(1).to_pylist()
                for size, at in _by_size(packed).items():
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).normal(size=(size, passes * bits))
                    unit = _unit([packed[i] for i in at])
                    signs = ((unit - means[size]) @ planes[size] >= 0).reshape(len(at), passes, bits)
                    code = np.packbits(signs, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                    # as an ordered signed number
                    code = (code ^ np.uint64(1 << 63)).astype(np.int64)
                    ids, vec = part.column(0).take(pa.array(at)), _binary(rounded(unit))
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p] * len(at), pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array(code[:, p]), ids, vec],
                            ["pass", "size", "code", "id", "v"],
                        )

    return run


def _united(n: int, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, under labels to start with and pairs to unite."""
    label = start
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _windows(cosine: float, window: int):
    """Edges (a, b, sure) among neighbours of a sorted partition: a spanning forest of the sure ones, and open pairs between its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail = None, None  # of the last rows: ids, ids of their trees' roots, vectors, errors

        def edges(ids: np.ndarray, roots: np.ndarray, x: np.ndarray, error: np.ndarray, new: int) -> tuple[pa.RecordBatch, np.ndarray]:
            """Compare each of the last ``new`` rows with the ``window`` rows before it."""
            old = len(ids) - new
            dots = x[old:] @ x.T
            slack = error[old:, None] + (1 + error[old:, None]) * error[None, :] + 1e-5
            place, other = np.arange(old, len(ids))[:, None], np.arange(len(ids))[None, :]
            near = (dots >= cosine - slack) & (other < place) & (other >= place - window)
            i, j = np.nonzero(near)
            sure = dots[i, j] >= cosine + slack[i, j]
            i += old
            _, first, start = np.unique(roots, return_index=True, return_inverse=True)
            start = first[start]  # trees of earlier rows
            label = _united(len(ids), start, i[sure], j[sure])
            joined = np.flatnonzero((start == np.arange(len(ids))) & (label != start))
            open_i, open_j = i[~sure], j[~sure]
            apart = label[open_i] != label[open_j]
            open_i, open_j = open_i[apart], open_j[apart]
            a, b = np.concatenate((roots[label[joined]], ids[open_j])), np.concatenate((roots[joined], ids[open_i]))
            kind = np.arange(len(a)) < len(joined)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind)], ["a", "b", "sure"]), roots[label]

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            ids = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if hi == lo:
                    continue
                key, width = tuple(keys[:, lo].tolist()), int(keys[1, lo]) + 8
                raw = batch.column(4).slice(lo, hi - lo)
                offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + 2]
                rows = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[0] + (hi - lo) * width].reshape(hi - lo, width)
                x, error = _restored(rows)
                parts = (ids[lo:hi], ids[lo:hi], x, error)
                if key == tail_key:
                    parts = tuple(np.concatenate(p) for p in zip(tail, parts, strict=True))
                found, roots = edges(*parts, hi - lo)
                yield found
                tail_key, tail = key, tuple(p[-window:] for p in (parts[0], roots, *parts[2:]))

    return run


def _linked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = _unit([x])[0], _unit([y])[0]
                keep.append(bool(a @ b >= cosine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _partial_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[int, np.ndarray] = {}
        for comp, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = _vector(b)
            x = x / np.linalg.norm(x)
            sums[comp] = sums[comp] + x if comp in sums else x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())], ["comp", "sum"]
        )


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (comp,), rows in key_runs(batches, 1):
        total = sum(np.frombuffer(r[0], "<f8") for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array([comp], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["comp", "sum"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for b, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            x, y = _vector(b), np.frombuffer(c, "<f8")
            size = np.linalg.norm(x) * np.linalg.norm(y)
            out.append(bool(size > 0 and math.acos(max(-1.0, min(1.0, float(x @ y / size)))) <= CORE))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], ["comp", "id", "n", "v", "core"])


def _block_counts(cosine: float):
    """Of a block pair (side 0: vectors to count for, side 1: vectors to count), each side-0 vector's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_runs(batches, 3):
            left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            if not left or not right:
                continue
            x, y = _unit([r[3] for r in left]), _unit([r[3] for r in right])
            n, core = np.array([r[2] for r in right]), np.array([r[4] for r in right])
            same = np.array([r[1] for r in left])[:, None] == np.array([r[1] for r in right])[None, :]
            linked = (x @ y.T >= cosine) & ~same
            # a core vector of the other side gains this one's weight in turn
            back = (linked & core[None, :]).T @ np.array([r[2] for r in left])
            ids = [r[1] for r in left] + [r[1] for r in right]
            gain = np.concatenate((linked @ n, back))
            keep = gain > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids)[keep]), pa.array(gain[keep].astype(np.int64))], ["id", "gain"]
            )

    return run


def embedding_near_dedup(
    spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, seed: int = 41
) -> DataFrame:
    """A row for each vector: (vec_id, n_links, component_id, kept). Without ``passes`` there are as many as the table needs."""
    scratch = Scratch(spark, "embed")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = scratch.write(base.mapInArrow(_pack, "vec_id long, v binary"))
    distinct = packed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    # numbers tell vectors apart, also where rows share an id; results only have ids
    distinct = scratch.write(distinct.select(F.monotonically_increasing_id().alias("id"), "v", "n", "vec_id"))
    sizes = distinct.groupBy(F.expr(_SIZE).alias("size")).agg(F.count("*").alias("n"))
    centres = _means(distinct, sizes.collect())  # a row for each length of vectors
    if passes is None:
        passes = max((passes_for(n, centred_cosine(cosine, common), window) for _, (n, common, _) in centres.items()), default=PASSES)

    order = ["pass", "size", "code", "id"]
    means = {size: mean for size, (_, _, mean) in centres.items()}
    coded = distinct.select("id", "v").mapInArrow(_codes(passes, 64, seed, means), "pass int, size int, code long, id long, v binary")
    laid = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    edges = scratch.write(laid.mapInArrow(_windows(cosine, window), "a long, b long, sure boolean").distinct())
    sure = edges.where("sure").select("a", "b")
    comps = components(sure, scratch)
    side = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
    apart = edges.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = apart.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(a_comp, a) <> coalesce(b_comp, b)")
    apart = scratch.write(apart.select("a", "b"))
    if not apart.isEmpty():
        whole = lambda c, v: distinct.select(F.col("id").alias(c), F.col("v").alias(v))
        both = apart.join(whole("a", "x"), "a").join(whole("b", "y"), "b").select("a", "b", "x", "y")
        more = scratch.write(both.mapInArrow(_linked(cosine), "a long, b long"))
        comps = components(sure.unionByName(more), scratch)
    comps = comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))

    members = distinct.join(comps, "id").select("comp", "id", "n", "v")
    centres = by_key(members.select("comp", "v").mapInArrow(_partial_centres, "comp long, sum binary"), ["comp"])
    members = members.join(centres.mapInArrow(_centres, "comp long, sum binary"), "comp")
    schema = "comp long, id long, n long, v binary, core boolean"
    members = scratch.write(members.select("comp", "id", "n", "v", "sum").mapInArrow(_angles, schema))
    sizes = members.groupBy("comp").agg(
        F.count("*").alias("m"),
        F.count_if(~F.col("core")).alias("outer"),
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"),
    )
    sizes = scratch.write(sizes)
    # comparisons: every outer vector with its whole component, in blocks
    wide = F.ceil(F.col("m") / BLOCK).cast("int")
    tall = F.ceil(F.col("outer") / BLOCK).cast("int")
    mixed = members.join(sizes.where("outer > 0").select("comp", wide.alias("wide"), tall.alias("tall")), "comp")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = mixed.where(~F.col("core")).select("comp", own("tall").alias("i"), F.explode(upto("wide")).alias("j"), F.lit(0).alias("side"), "id", "n", "v", "core")
    right = mixed.select("comp", F.explode(upto("tall")).alias("i"), own("wide").alias("j"), F.lit(1).alias("side"), "id", "n", "v", "core")
    gains = by_key(left.unionByName(right), ["comp", "i", "j"]).mapInArrow(_block_counts(cosine), "id long, gain long")
    gains = gains.groupBy("id").agg(F.sum("gain").alias("gain"))
    counted = members.join(sizes.select("comp", "core_n"), "comp").join(gains, "id", "left").select(
        "id",
        "comp",
        (F.coalesce("gain", F.lit(0)) + F.when(F.col("core"), F.col("core_n") - F.col("n")).otherwise(0)).alias("links"),
    )
    # a rep is the smallest id of its copies, a component the smallest of its reps
    counted = scratch.write(distinct.select("id", "n", "vec_id", "v").join(counted, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    least = counted.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    known = counted.join(least, "comp").select(
        "v",
        "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    good = packed.where("v is not null").join(known, "v", "left").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id"
    )
    bad = packed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) c ON c.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) n ON n.a = v.vec_id
"""
