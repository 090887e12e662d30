"""Tf-idf is dealt by the texts' bytes, networks by their rows and pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import network


@pytest.mark.parametrize("vocabulary", [0, 2_000_000])
def test_more_text_makes_more_partitions(spark, monkeypatch, vocabulary):
    rows = [(i, "limits growth world " + " ".join(f"w{i % 9}x{j}" for j in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in X.tfidf(docs).collect())
    monkeypatch.setattr(X, "SHARE_BYTES", 1000)
    monkeypatch.setattr(X, "VOCABULARY", vocabulary)
    weights = X.tfidf(docs)
    assert weights.rdd.getNumPartitions() >= 20
    got = sorted(tuple(r) for r in weights.collect())
    assert [r[:4] for r in got] == [r[:4] for r in want] and all(abs(a[4] - b[4]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_a_few_million_rows_are_dealt_as_finely_as_more(spark):
    """3.6 million rows made tasks of 300,000 before, and 36 million tasks of a million."""
    rows = {n: n / network.shares(spark, n) for n in (3_600_000, 36_000_000, 216_000_000)}
    assert max(rows.values()) < 1.1 * min(rows.values()) and max(rows.values()) < 300_000


def test_pairs_of_a_partition_are_bounded(spark):
    edges = spark.range(2_400_000).select((F.col("id") / 4).cast("long").alias("w"), F.pmod(F.xxhash64("id"), F.lit(600_011)).alias("r"))
    pairs = network.cocitation(edges, "w", "r", rows=2_400_000)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) > 3_000_000 and max(sizes) < 300_000


def test_summary_counts_each_work_and_reference_once(spark):
    """A null is no reference and no work, though a row of one is an edge."""
    rows = [(w, w * 7 % 501 + k) for w in range(5000) for k in range(w % 4)] + [(9000, 1), (9000, 1), (9001, 700), (9001, None), (None, 701), (None, 702)]
    edges = spark.createDataFrame(rows, "w int, r int")
    got = {x.metric: x.value for x in network.network_summary(edges, network.cocitation(edges, "w", "r"), "w", "r").collect()}
    own = {}
    for w, r in rows:
        if w is not None and r is not None:
            own.setdefault(w, set()).add(r)
    assert got["citing_works"] == len(own) and got["references"] == len({r for _, r in rows if r is not None}) and got["edges"] == len(set(rows))
    assert got["pair_nodes"] == len({r for s in own.values() if len(s) > 1 for r in s})


@pytest.mark.parametrize("tile", [4, 1000])  # some references in tiles, none
@pytest.mark.parametrize("many", [40, 8])  # references that are cited a few times or by most works
def test_coupled_works_are_counted_where_they_meet(spark, tile, many):
    rng = random.Random(many)
    rows = [(w, rng.randrange(many)) for w in range(200) for _ in range(rng.choice([1, 1, 2, 4]))]
    rows += [(w, r) for w, r in rows if w % 9 == 0 for _ in range(w % 3 + 1)] + [(7, None), (None, 3), (900, 901)]
    df, own = spark.createDataFrame(rows, "w long, r int").repartition(3), {}
    for w, r in rows:
        if w is not None and r is not None:
            own.setdefault(w, Counter())[r] += 1
    want = {(a, b): n for a in own for b in own if a < b and (n := sum(own[a][r] * own[b][r] for r in own[a]))}
    pairs = network.coupling(df, "w", "r", tile=tile)
    got = pairs.collect()
    assert len(got) == len(want) and {(x.work1, x.work2): x.n for x in got} == want
    assert "hashpartitioning(work1" not in pairs._jdf.queryExecution().toString()  # no pair moves


def test_works_of_long_lists_are_coupled_by_pairs(spark):
    """Two works that share all of their hundred references and few others: lists of them would be longer than the pairs are many."""
    rows = [(w, w // 2 * 100 + k) for w in range(20) for k in range(100)]
    pairs = network.coupling(spark.createDataFrame(rows, "w long, r int"), "w", "r")
    assert "hashpartitioning(work1" in pairs._jdf.queryExecution().toString()
    assert {tuple(x) for x in pairs.collect()} == {(w, w + 1, 100) for w in range(0, 20, 2)}
