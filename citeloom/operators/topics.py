"""Clusters of vectors: Lloyd's rounds from several starts, then Hartigan's transfers; and what represents a cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.plans.scratch import Tables


@dataclass
class Clusters:
    """``rows`` with their ``cluster`` (0, 1, ...), the clusters' centres, and the sum of squared distances to them."""

    rows: DataFrame
    centres: np.ndarray
    cost: float
    lloyd_cost: float
    issue: str = "ok"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


BINS = 12  # bands of a move's gain against the row's distance, each half of the one before

Move = tuple[int, int]  # from and to


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).clip(0)


def _best_moves(x: np.ndarray, own: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the squared distance to its centre, the cluster that it would move to, what that gains, and the gain's band."""
    far, at = _far(x, centres), np.arange(len(x))
    here = far[at, own]
    # leaving shrinks a cluster of n by n / (n - 1) of the distance, joining costs n / (n + 1) of it
    leaving = np.where(sizes[own] > 1, here * sizes[own] / np.maximum(sizes[own] - 1, 1), 0.0)
    joining = far * (sizes / (sizes + 1))[None]
    joining[at, own] = np.inf
    to = joining.argmin(1)
    gain = leaving - joining[at, to]
    gain = np.where(gain > 1e-9 * (1 + here), gain, 0.0)
    band = np.clip(1 - np.log2(np.maximum(gain, 1e-300) / np.maximum(here, 1e-300)), 0, BINS - 1).astype(np.int64)
    return here, to, gain, band


def _sums(rows: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The clusters' sizes and sums; one row a cluster comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim))
        for batch in batches:
            x, own = _matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            np.add.at(n, own, 1)
            np.add.at(total, own, x)
        found = np.flatnonzero(n)
        columns = [pa.array(found.astype(np.int32)), pa.array(n[found])] + [pa.array(total[found, i]) for i in range(dim)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *(f"s{i}" for i in range(dim))])

    names = [f"s{i}" for i in range(dim)]
    parts = rows.select("_row", "cluster", "_x").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} double" for c in names))
    sizes, sums = np.zeros(k), np.zeros((k, dim))
    for r in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        sizes[r["cluster"]], sums[r["cluster"]] = r["n"], [r[c] for c in names]
    return sizes, sums


def _transfers(rows: DataFrame, centres: np.ndarray, sizes: np.ndarray) -> tuple[dict[Move, dict[int, tuple[int, np.ndarray]]], dict[Move, tuple[int, float, np.ndarray]], float]:
    """What moves between each two clusters would gain.

    By move and band the rows' number and sum, by move the row that gains most with its gain and vector, and the cost as it is: k * k * BINS rows at most come to the driver.
    """
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list] = {}
        cost = 0.0
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            own = batch.column(1).to_numpy(zero_copy_only=False)
            here, to, gain, band = _best_moves(x, own, centres, sizes)
            cost += float(here.sum())
            some = np.flatnonzero(gain > 0)
            key = (own[some] * k + to[some]) * BINS + band[some]
            for code in np.unique(key).tolist():
                at = some[key == code]
                best = at[np.lexsort((ids[at], -gain[at]))[0]]
                part = found.setdefault((code // BINS // k, code // BINS % k, code % BINS), [0, np.zeros(dim), (0.0, 0, [])])
                part[0] += len(at)
                part[1] += x[at].sum(0)
                part[2] = max(part[2], (float(gain[best]), -int(ids[best]), x[best].tolist()))
        flat = [(*key, n, -row, gain, best, total) for key, (n, total, (gain, row, best)) in found.items()] + [(-1, -1, -1, 0, 0, cost, [], np.zeros(dim))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        columns = [pa.array([r[c] for r in flat], kind) for c, kind in enumerate(kinds)] + [pa.array([float(r[7][i]) for r in flat], pa.float64()) for i in range(dim)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "band", "n", "row", "gain", "best", *names])

    names = [f"s{i}" for i in range(dim)]
    parts = rows.select("_row", "cluster", "_x").mapInArrow(run, "a int, b int, band int, n long, row long, gain double, best array<double>, " + ", ".join(f"{c} double" for c in names))
    top = F.max_by(F.struct("row", "best"), F.struct("gain", -F.col("row"))).alias("top")
    found = parts.groupBy("a", "b", "band").agg(F.sum("n").alias("n"), top, F.max("gain").alias("gain"), F.sum("gain").alias("total"), *[F.sum(c).alias(c) for c in names]).collect()
    bands: dict[Move, dict[int, tuple[int, np.ndarray]]] = {}
    single: dict[Move, tuple[int, float, np.ndarray]] = {}
    for r in found:
        if r.a >= 0:
            move = (r.a, r.b)
            bands.setdefault(move, {})[r.band] = (r.n, np.array([r[c] for c in names]))
            if move not in single or (r.gain, -r.top.row) > (single[move][1], -single[move][0]):
                single[move] = (r.top.row, r.gain, np.array(r.top.best))
    return bands, single, sum(r.total for r in found if r.a < 0)


def _explained(sizes: np.ndarray, sums: np.ndarray) -> float:
    """The part of the vectors' squares that the centres explain: the cost falls by as much as this grows."""
    some = sizes > 0
    return float(((sums[some] ** 2).sum(1) / sizes[some]).sum())


def _choose(bands: dict[Move, dict[int, tuple[int, np.ndarray]]], single: dict[Move, tuple[int, float, np.ndarray]], sizes: np.ndarray, sums: np.ndarray) -> tuple[dict[Move, int], dict[int, int], np.ndarray, np.ndarray]:
    """The moves of a round (the last band that moves, by move; where single rows go), and the sizes and sums after it.

    Either all moves up to one band, or for pairs of clusters that don't touch each other what is best for each: its rows up to a band, or its best
    row alone, which always gains. Gains are exact, from sizes and sums before and after.
    """

    def after(moves: dict[Move, int]) -> tuple[np.ndarray, np.ndarray]:
        size, total = sizes.copy(), sums.copy()
        for (a, b), last in moves.items():
            for n, t in [(1, single[a, b][2])] if last < 0 else [v for band, v in bands[a, b].items() if band <= last]:
                size[[a, b]] += (-n, n)
                total[a] -= t
                total[b] += t
        return size, total

    def gain(moves: dict[Move, int]) -> float:
        size, total = after(moves)
        return _explained(size, total) - now if ((size > 0) | (sizes <= 0)).all() else -np.inf

    now = _explained(sizes, sums)
    everywhere = max((dict.fromkeys(bands, last) for last in sorted({band for v in bands.values() for band in v})), key=gain)
    options = sorted(((max((single[m][1], -1), *((gain({m: last}), last) for last in sorted(bands[m]))), m) for m in bands), key=lambda o: (-o[0][0], o[1]))
    apart: dict[Move, int] = {}
    for (_, last), move in options:
        if not {c for m in apart for c in m} & set(move):
            apart[move] = last
    best = everywhere if gain(everywhere) > gain(apart) else apart
    return {m: last for m, last in best.items() if last >= 0}, {single[m][0]: m[1] for m, last in best.items() if last < 0}, *after(best)


def _moved(rows: DataFrame, centres: np.ndarray, sizes: np.ndarray, last: dict[Move, int], single: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.full((len(centres), len(centres)), -1)
        for move, band in last.items():
            limit[move] = band
        for batch in batches:
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            _, to, gain, band = _best_moves(_matrix(batch.column(2)), own, centres, sizes)
            new = np.where((gain > 0) & (band <= limit[own, to]), to, own).astype(np.int32)
            for i in np.flatnonzero(np.isin(ids, list(single))).tolist():
                new[i] = single[int(ids[i])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new), batch.column(2)], ["_row", "cluster", "_x"])

    return rows.select("_row", "cluster", "_x").mapInArrow(run, "_row long, cluster int, _x array<double>")


def kmeans(rows: DataFrame, vector: str, k: int, tables: Tables, seed: int = 1, iterations: int = 20, restarts: int = 3, rounds: int = 60) -> Clusters:
    """``rows`` in up to ``k`` clusters, no more than there are different vectors; vectors of one length, null ones are left out.

    The best of ``restarts`` runs of Lloyd's algorithm is improved by Hartigan's transfers until no row's move gains, or for ``rounds``. A round
    moves whole bands of rows at once where sizes and sums show that this gains, else single rows between pairs of clusters, so its cost always falls.
    Each round is two scans and one write of row numbers, clusters and vectors; the driver holds sums by pair of clusters and band, however many rows move.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = F.col(vector).cast("array<double>")
    base = tables.write(rows.where(F.col(vector).isNotNull()).withColumns({"_row": F.monotonically_increasing_id(), "_x": x}))
    k = min(k, base.select("_x").distinct().limit(k).count())
    if k < 2:
        return Clusters(base.withColumn("cluster", F.lit(0)).drop("_row", "_x"), np.zeros((0, 0)), 0.0, 0.0, "too_few_distinct_vectors")
    data = base.withColumn("_v", array_to_vector("_x"))
    fits = [KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol="_v", predictionCol="cluster").fit(data) for i in range(restarts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    k, dim, lloyd = len(model.clusterCenters()), len(model.clusterCenters()[0]), None
    state = tables.write(model.transform(data).select("_row", "cluster", "_x"))
    sizes, sums = _sums(state, dim, k)
    for step in range(rounds + 1):
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1e150)
        bands, single, cost = _transfers(state, centres, sizes)
        lloyd = cost if lloyd is None else lloyd
        if not bands or step == rounds:
            break
        last, alone, *later = _choose(bands, single, sizes, sums)
        old, state = state, tables.write(_moved(state, centres, sizes, last, alone))
        tables.drop(old)
        sizes, sums = later
    found = base.drop("_x").join(state.select("_row", "cluster"), "_row").select(*rows.columns, "cluster")
    return Clusters(found, centres, cost, lloyd)


def representatives(clusters: Clusters, vector: str, key: str, n: int = 5) -> DataFrame:
    """(cluster, key, rank): the ``n`` rows of each cluster nearest to its centre, smaller keys on ties."""
    spark = clusters.rows.sparkSession
    known = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(clusters.centres)], "cluster int, _c array<double>")
    far = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(far, key))
    return clusters.rows.join(F.broadcast(known), "cluster").select("cluster", key, rank.alias("rank")).where(F.col("rank") <= n)


def summaries(weights: DataFrame, assigned: DataFrame, id_col: str = "doc_id", terms: int = 12) -> DataFrame:
    """(cluster, n_docs, top_terms): each cluster's size and its leading terms, joined by " | "."""
    from citeloom.functions.text import top_terms

    clusters = assigned.select(id_col, "cluster")
    top = top_terms(weights, clusters, id_col, terms).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n_docs"))
    return sizes.join(top, "cluster", "left").select("cluster", "n_docs", F.array_join(F.transform("t", lambda x: x["term"]), " | ").alias("top_terms"))
