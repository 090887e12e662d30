"""Tiles of heavy keys, mid-ranks and pattern bootstraps against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import network, stats


def test_pairs_of_a_heavy_reference_are_tiled(spark):
    rng = np.random.default_rng(1)
    edges = [(w, 0) for w in range(300)] + [(int(w), int(r)) for w, r in rng.integers(1, 40, (600, 2))] + [(3, None), (None, 4)] + [(7, 0)] * 2
    df = spark.createDataFrame(edges, "w int, r int").repartition(4)
    want, by_ref = Counter(), {}
    for w, r in edges:
        if w is not None and r is not None:
            by_ref.setdefault(r, []).append(w)
    for ws in by_ref.values():
        want.update(tuple(sorted(p)) for p in combinations(ws, 2) if p[0] != p[1])
    assert {(x.work1, x.work2): x.n for x in network.coupling(df, "w", "r", tile=16).collect()} == want
    assert {(x.ref1, x.ref2): x.n for x in network.cocitation(df, "r", "w", tile=16).collect()} == {k: len({r for r, ws in by_ref.items() if set(k) <= set(ws)}) for k in want}


def test_no_tile_stands_out(spark):
    edges = spark.range(20_000).select(F.col("id").alias("w"), F.lit(1).alias("r"))
    low, high = network.tiles(edges, ["r"], "w")
    n = low.groupBy("_i", "_j").count().join(high.groupBy("_i", "_j").agg(F.count("*").alias("m")), ["_i", "_j"])
    pairs = sorted(r["count"] * r.m / (1 if r._i < r._j else 2) for r in n.collect())
    assert len(pairs) == 40 * 41 // 2 and pairs[-1] < 2 * pairs[len(pairs) // 2]


def brute_ordinal(units):
    n = Counter(v for u in units if len(u) >= 2 for v in u)
    order = sorted(n)
    at = np.cumsum([0] + [n[v] for v in order])
    mid = {v: at[i] + n[v] / 2 for i, v in enumerate(order)}
    total = sum(n.values())
    observed = sum((mid[a] - mid[b]) ** 2 / (len(u) - 1) for u in units if len(u) >= 2 for i, a in enumerate(u) for j, b in enumerate(u) if i != j)
    x = np.array([mid[v] for v in order for _ in range(n[v])])
    expected = 2 * (len(x) * (x * x).sum() - x.sum() ** 2)
    return 1 - (total - 1) * observed / expected


def test_ordinal_alpha_by_mid_ranks(spark):
    rng = np.random.default_rng(2)
    units = [[int(v)] * int(k) + [int(v) + int(rng.integers(-3, 4))] for v, k in zip(rng.integers(0, 60, 400), rng.integers(0, 3, 400), strict=True)]
    rows = [(i, str(c), float(v)) for i, u in enumerate(units) for c, v in enumerate(u)]
    got = stats.krippendorff(spark.createDataFrame(rows, "unit int, coder string, value double"), "ordinal").first()
    assert abs(got.alpha - brute_ordinal(units)) < 1e-5 and got.n_units == sum(len(u) >= 2 for u in units)


def test_ordinal_alpha_of_many_values(spark):
    """200,000 distinct values: neither joined with each other nor sorted in one task."""
    x = spark.range(100_000)
    a = x.select(F.col("id").alias("unit"), F.lit("a").alias("coder"), (F.col("id") * 2).alias("value"))
    b = x.select(F.col("id").alias("unit"), F.lit("b").alias("coder"), (F.col("id") * 2 + 1).alias("value"))
    got = stats.krippendorff(a.unionByName(b), "ordinal").first()
    assert got.n_values == 200_000 and got.alpha == 1.0


def test_ratio_values_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, c, float(i + (c == "b"))) for i in range(30) for c in "ab"], "unit int, coder string, value double")
    x = [v for i in range(30) for v in (i, i + 1)]
    delta = lambda a, b: ((a - b) / (a + b)) ** 2 if a + b else 0.0
    want = 1 - (len(x) - 1) * sum(2 * delta(i, i + 1) for i in range(30)) / sum(delta(a, b) for a in x for b in x)
    assert abs(stats.krippendorff(rows, "ratio").first().alpha - want) < 1e-5
    monkeypatch.setattr(stats, "RATIO_VALUES", 10)
    with pytest.raises(ValueError, match="distinct"):
        stats.krippendorff(rows, "ratio").collect()


@pytest.mark.parametrize("metric", ["nominal", "interval", "ordinal"])
def test_pattern_bootstrap_has_the_spread_of_resampled_units(spark, metric):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, 150)
    units = [[int(v), int(v) if rng.random() < 0.8 else int(rng.integers(0, 4))] for v in base]
    rows = [(i, str(c), float(v)) for i, u in enumerate(units) for c, v in enumerate(u)]

    def alpha(sample):
        v = np.array(sample, float)
        if metric == "ordinal":
            order, n = np.unique(v, return_counts=True)
            v = (np.cumsum(n) - n / 2)[np.searchsorted(order, v)]
        x = v.ravel()
        if metric == "nominal":
            n = np.unique(x, return_counts=True)[1]
            return 1 - (len(x) - 1) * 2 * (v[:, 0] != v[:, 1]).sum() / (len(x) ** 2 - (n * n).sum())
        return 1 - (len(x) - 1) * 2 * ((v[:, 0] - v[:, 1]) ** 2).sum() / (2 * (len(x) * (x * x).sum() - x.sum() ** 2))

    draws = [alpha([units[i] for i in rng.integers(0, 150, 150)]) for _ in range(2000)]
    low, high = np.percentile(draws, [2.5, 97.5])
    got = stats.bootstrap_alpha(spark.createDataFrame(rows, "unit int, coder string, value double"), metric, resamples=1000).first()
    assert got.resamples == 1000 and abs(got.low - low) < 0.04 and abs(got.high - high) < 0.04


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_partitions_follow_the_number_of_pairs(spark, monkeypatch, partitions):
    monkeypatch.setattr(network, "SHARE", 1000)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        edges = spark.range(300).select(F.col("id").alias("w"), F.lit(1).alias("r"))
        pairs = network.coupling(edges, "w", "r", tile=16)
        assert pairs.rdd.getNumPartitions() == 45 and pairs.count() == 300 * 299 // 2
        assert network.cocitation(edges, "r", "w", tile=16).rdd.getNumPartitions() == 45
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
