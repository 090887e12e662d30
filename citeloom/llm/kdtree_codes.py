"""Vector code compression: product codes whose codebooks come from filtering Lloyd.

Vectors become integers and are cut into equal consecutive parts; each part position has its own codebook. Every partition
builds kd-trees over its vectors' parts once, in chunks of ``CHUNK`` vectors: a node knows its bounding box, and the
sum and number of its points. They are written to the shared folder, and each round of Lloyd's algorithm reads them: a node
takes the entry nearest to its box's middle and drops every other entry that is no nearer anywhere in the box; a
node with one entry left is assigned whole, by its sum and number, without looking at its points; what reaches a leaf is
compared. All of it is integer arithmetic, so equal distances go to the lower index exactly and results don't depend on the
partitions. What leaves a round are a sum and a number for each entry, added up by Spark; the codebooks are all that
the driver holds.

Left out are vectors that are null, hold null or non-finite components, or have another length than most (of equally
frequent lengths the largest counts; it must be a multiple of the number of parts, else this raises). Codebooks start from the smallest
ids; rows of equal ids are ordered by their vectors, and null ids come last. With fewer vectors than entries, codebooks are
that much shorter. Every other row gives one row, repeated ones too. Components of 2^23 or so and more overflow what squared distances in longs
hold: they raise (``largest_component``). No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, finite, meet_groups, usual_length

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CHUNK, LEAF = 8192, 16


def largest_component(dim: int) -> int:
    """Integer components below this keep all squared distances, and their sum over a vector, within a long."""
    return math.isqrt((2**63 - 1) // max(dim, 1)) // 4


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, one vector a row."""
    y = np.floor(scale * values)
    if y.size and not np.abs(y).max() < largest_component(values.shape[1]):
        raise ValueError("components are too large for squared distances in longs")
    return y.astype(np.int64)


def level_starts(n: int) -> list[np.ndarray]:
    """Where the nodes of each level start in a tree over ``n`` points, halves of halves until leaves hold ``LEAF`` at most."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max(initial=0) > LEAF:
        at = levels[-1]
        middle = at[:-1] + np.diff(at) // 2
        levels.append(np.append(np.stack((at[:-1], middle), 1).ravel(), n))
    return levels


@dataclass
class Tree:
    """A kd-tree over some points: their order, the points in it, and for each level its nodes' starts, boxes and sums."""

    order: np.ndarray
    points: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        """Nodes are halved along the widest side of their box."""
        starts, order = level_starts(len(points)), np.arange(len(points))
        low, high, total = [], [], []
        for level, at in enumerate(starts):
            laid, first = points[order], at[:-1]
            low.append(np.minimum.reduceat(laid, first))
            high.append(np.maximum.reduceat(laid, first))
            total.append(np.add.reduceat(laid, first))
            if level + 1 < len(starts):
                node = np.repeat(np.arange(len(first)), np.diff(at))
                widest = (high[-1] - low[-1]).argmax(1)
                order = order[np.lexsort((laid[np.arange(len(laid)), widest[node]], node))]
        # the last level's order holds for all levels: nodes only reorder within
        return Tree(order, points[order], starts, low, high, total)

    def pack(self) -> bytes:
        whole = [self.order.astype("<i4"), self.points.astype("<i4")]
        for level in range(len(self.starts)):
            whole += [self.low[level].astype("<i4"), self.high[level].astype("<i4"), self.total[level].astype("<i8")]
        return b"".join(x.tobytes() for x in whole)

    @staticmethod
    def unpack(data: bytes, n: int, d: int) -> Tree:
        at = 0

        def take(rows: int, kind: str, width: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, rows * width, at)
            at += x.nbytes
            return x.reshape(rows, width).astype(np.int64)

        order, points, starts = take(n, "<i4", 1)[:, 0], take(n, "<i4", d), level_starts(n)
        low, high, total = [], [], []
        for s in starts:
            m = len(s) - 1
            low.append(take(m, "<i4", d))
            high.append(take(m, "<i4", d))
            total.append(take(m, "<i8", d))
        return Tree(order, points, starts, low, high, total)

    def assign(self, entries: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
        """Of each entry the sum and number of its points; with ``codes`` each point's entry, in the tree's order; and how many points were compared."""
        k = len(entries)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
        code = np.zeros(len(self.points), np.int64) if codes else None
        node, left, compared = np.zeros(1, np.int64), np.ones((1, k), bool), 0
        for level, at in enumerate(self.starts):
            low, high = self.low[level][node], self.high[level][node]
            from_middle = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(left, from_middle, np.iinfo(np.int64).max).argmin(1)
            lead = entries[best][:, None]
            corner = np.where(entries[None] > lead, high[:, None], low[:, None])  # of the box, farthest towards the other entry
            ahead = ((corner - entries[None]) ** 2).sum(2) - ((corner - lead) ** 2).sum(2)
            left = left & ((ahead < 0) | ((ahead == 0) & (np.arange(k)[None] <= best[:, None])))
            alone = left.sum(1) == 1
            own, entry = node[alone], best[alone]
            np.add.at(sums, entry, self.total[level][own])
            np.add.at(counts, entry, at[own + 1] - at[own])
            if codes:
                for i, e in zip(own.tolist(), entry.tolist(), strict=True):
                    code[at[i] : at[i + 1]] = e
            node, left = node[~alone], left[~alone]
            if not len(node):
                break
            if level + 1 < len(self.starts):
                node, left = np.stack((2 * node, 2 * node + 1), 1).ravel(), np.repeat(left, 2, axis=0)
                continue
            size = at[node + 1] - at[node]
            place = np.repeat(at[node] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            points = self.points[place]
            near = nearest(points, entries)
            compared += len(points)
            np.add.at(sums, near, points)
            np.add.at(counts, near, 1)
            if codes:
                code[place] = near
        return sums, counts, code, compared


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of each point's nearest entry, the lower of equally near ones."""
    out = np.zeros(len(points), np.int64)
    for lo in range(0, len(points), 4096):
        out[lo : lo + 4096] = ((points[lo : lo + 4096, None] - entries[None]) ** 2).sum(2).argmin(1)
    return out


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _trees(dim: int, parts: int, scale: int):
    d = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            y = integers(vectors_of(table.column(2).combine_chunks(), dim), scale)
            packed = [Tree.of(y[:, p * d : (p + 1) * d]).pack() for p in range(parts)]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.column(c).type)) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if size and size + part.num_rows > CHUNK:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield out()

    return run


def _sums(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for ids, trees in zip(batch.column(0), batch.column(1), strict=True):
                for p, (book, packed) in enumerate(zip(books, trees.as_py(), strict=True)):
                    s, c, _, _ = Tree.unpack(packed, len(ids), book.shape[1]).assign(book)
                    sums[p] += s
                    counts[p] += c
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        columns = [pa.array([x[i] for x in used], pa.int32()) for i in (0, 1)]
        columns.append(pa.array([int(counts[p][e]) for p, e in used], pa.int64()))
        columns += [pa.array([int(sums[p][e, i]) for p, e in used], pa.int64()) for i in range(books[0].shape[1])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{i}" for i in range(books[0].shape[1]))])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns, strict=True):
                n = len(ids)
                codes, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
                for p, (book, packed) in enumerate(zip(books, trees.as_py(), strict=True)):
                    tree = Tree.unpack(packed, n, book.shape[1])
                    code = tree.assign(book, codes=True)[2]
                    codes[tree.order, p] = code
                    error[tree.order] += ((tree.points - book[code]) ** 2).sum(1)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


@dataclass
class Compressed:
    """``codes`` (vec_id, label, code, error), a row for each vector, and the codebooks, one matrix for each part."""

    codes: DataFrame
    codebooks: list[np.ndarray]


def compress(
    spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> Compressed:
    """Fit codebooks on all vectors and encode all of them."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    scratch, schema = Scratch(spark, "codes"), "vec_id long, label string, code string, error long"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.where(finite(F.col("v")))
    dim = usual_length(base, "v")
    if dim is None:
        return Compressed(spark.createDataFrame([], schema), [])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components don't divide into {parts} equal parts")
    d, base = dim // parts, base.where(F.size("v") == dim)
    seeds = base.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    first = integers(np.array([r["v"] for r in seeds], np.float64), scale)
    books = [first[:, p * d : (p + 1) * d].copy() for p in range(parts)]
    trees = scratch.write(base.mapInArrow(_trees(dim, parts, scale), "ids array<long>, labels array<string>, trees array<binary>"))
    columns = [f"s{i}" for i in range(d)]
    found_schema = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns)
    for _ in range(rounds):
        found = trees.select("ids", "trees").mapInArrow(_sums(books), found_schema)
        found = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *columns)])
        for r in found.collect():  # a row for each entry at most
            books[r["part"]][r["entry"]] = [r[c] // r["n"] for c in columns]
    return Compressed(trees.mapInArrow(_codes(books), schema), books)


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = Scratch(spark, "coded").write(made.codes)
    keys = [F.coalesce("label", F.lit("")).alias("_label"), F.col("label").isNull().alias("_none")]
    sums = codes.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    both = meet_groups(codes.select("vec_id", "code", "error", *keys), sums, ["_label", "_none"], "_n", codes.count())
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(made.codebooks)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds as tables of entries (p, e, c), each from the one before."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "q AS MATERIALIZED (SELECT vec_id, label, p, y[p * (len(y) // 8) + 1 : (p + 1) * (len(y) // 8)] AS y FROM v, (SELECT unnest(range(8)) AS p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""d{i} AS MATERIALIZED (SELECT vec_id, label, p, y, min(({_DISTANCE}, e)) AS m FROM q JOIN b{i} USING (p) GROUP BY ALL)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS MATERIALIZED (SELECT p, m[2] AS e, i, floor(sum(y[i]) / count(*))::BIGINT AS c FROM d{i}, unnest(range(1, len(y) + 1)) AS u(i) GROUP BY ALL),
n{i} AS (SELECT p, e, list(c ORDER BY i) AS c FROM s{i} GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (p, e))"""
            )
    steps.append(
        f"""x AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM d{ROUNDS} GROUP BY 1, 2),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})"""
    )
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM x, h"


_DISTANCE = "list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
ORACLE_OP13 = _oracle()
