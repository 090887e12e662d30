"""Pairs, leaders and scores of rows with many copies: classes are compared once, members get what brute force gives them."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions.similarity import jaro_similarity
from citeloom.operators import copies
from citeloom.plans import registry


def _parts(spark, path, names, copies_of, sizes=(1, 2, 3, 9)):
    """Parts of few names, in a random order of keys: (key, name, brand, size)."""
    rng = random.Random(3)
    rows = [(name, rng.choice(["B1", "B2"]), rng.choice(sizes)) for name in names for _ in range(copies_of)]
    rng.shuffle(rows)
    rows = [(i * 3, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(k, n, b, "T", s, 1.0) for k, n, b, s in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.write.parquet(f"{path}/part.parquet")
    return rows


NAMES = ["large ring", "large rings", "larger ing", "hot bolt", "hot bolts", "gnir egral", "abcvwxyz lmnop", "abcvwxy zlmnpo"]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize(("name", "similarity", "least"), [("pair_scores_jaro", jaro_similarity, 0.6), ("pair_scores_lev", _levenshtein, 0.5)])
def test_pairs_of_copies_equal_brute_force(spark, tmp_path, monkeypatch, name, similarity, least):
    monkeypatch.setattr(copies, "CHUNK", 4)
    rng = random.Random(5)
    mixed = ["".join(rng.choice("aabbc") for _ in range(8)) for _ in range(12)]  # Jaro's similarity of some depends on their order
    rows = _parts(spark, tmp_path, [*NAMES, *mixed], 14)
    want = {(k, m): s for k, a, b, _ in rows for m, c, e, _ in rows if k < m and b == e and (s := round(similarity(a, c), 6)) >= least}
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want.keys()
    assert all(abs(r[2] - want[r[0], r[1]]) < 2e-6 for r in got)


def test_equal_titles_are_compared_once(spark, tmp_path, monkeypatch):
    """1600 parts of eight names and two authors: some 640,000 pairs, but no more than 36 of an author's names."""
    _parts(spark, tmp_path, NAMES, 200)
    seen, inner = [], registry.corpus_queries.with_jaro
    monkeypatch.setattr(registry.corpus_queries, "with_jaro", lambda pairs, *names: (seen.append(pairs.count()), inner(pairs, *names))[1])
    assert registry.QUERIES["pair_scores_jaro"](spark, str(tmp_path)).count() > 100_000
    assert seen and max(seen) <= 2 * 36


def test_a_large_class_is_many_rows(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit("x").alias("t"), F.lit(None).cast("string").alias("n"))
    groups = copies.classes(rows, "id", ["t", "n"])
    lists = copies.chunks(copies.membership(rows, groups, ["t", "n"]), "id", "id")
    sizes = [len(r.ids) for r in lists.collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) < 2 * copies.CHUNK
    pairs = groups.select(F.col("rep").alias("c"), F.col("rep").alias("d"), F.lit(1.0).alias("f"), F.lit(1.0).alias("g"))
    got = copies.member_pairs(pairs, lists, "f", "g", "s")
    assert got.where("a < b").distinct().count() == got.count() == 5000 * 4999 // 2


def _scored_by_hand(rows):
    """(a, b) -> score of parts of one brand and near sizes; brand and type are the author, all have one venue."""
    return {
        (k, m): score
        for k, a, b, y in rows for m, c, e, z in rows
        if k < m and b == e and abs(y - z) <= 1 and (score := round(0.70 * jaro_similarity(a, c) + 0.30, 6)) >= 0.86
    }


def test_copies_are_scored_led_and_attributed_as_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies, "CHUNK", 4)
    rows = _parts(spark, tmp_path, [*NAMES, "hot volt", "hot volts x", "large song"], 12)
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    scored = _scored_by_hand(rows)
    got = {(r.a, r.b): r.score for r in run("dedup_pair_scores")}
    assert got.keys() == scored.keys() and all(abs(got[p] - s) < 2e-6 for p, s in scored.items())

    def led(keys, scored):
        leader = {}
        for k in sorted(keys):
            leader[k] = min((a for (a, b), s in scored.items() if b == k and s >= 0.92 and leader[a] == a), default=k)
        return leader

    leader = led([r[0] for r in rows], scored)
    assert {r.id: r.leader for r in run("leader_clusters")} == leader
    want = {(a, b) for (a, b), s in scored.items() if s < 0.92 and leader[a] == a and leader[b] >= a}
    assert {(r.a, r.b) for r in run("ambiguous_pairs")} == want and want
    own = [r for r in rows if r[0] % 10]
    scored, brand = _scored_by_hand(own), {r[0]: r[2] for r in rows}
    leader = led([r[0] for r in own], scored)
    for r in run("attributed_parts"):
        k = r.p_partkey
        if k % 10 == 0:
            assert (r.cluster_id, r.dedup_confidence) == (f"doi:{brand[k]}", 1.0)
        else:
            assert r.cluster_id == f"fuzzy:{leader[k]}"
            assert abs(r.dedup_confidence - (0.75 if leader[k] == k else scored[leader[k], k])) < 2e-6


@pytest.mark.parametrize("name", ["leader_clusters", "ambiguous_pairs", "attributed_parts"])
def test_leaders_need_no_pairs_of_copies(spark, tmp_path, monkeypatch, name):
    """1600 parts of eight names, two authors and four years: pairs by representatives are at most 64 of them squared."""
    _parts(spark, tmp_path, NAMES, 200)
    seen, inner = [], registry.corpus_queries.linkage.leader_clusters
    monkeypatch.setattr(registry.corpus_queries.linkage, "leader_clusters", lambda nodes, pairs, tables: (seen.append(pairs.count()), inner(nodes, pairs, tables))[1])
    registry.QUERIES[name](spark, str(tmp_path)).count()
    assert seen and max(seen) <= 64 * 63 // 2


def test_works_without_an_author_lead_themselves(spark):
    linkage = registry.corpus_queries.linkage
    rows = [(1, "a title", None, 1, "v"), (2, "a title", None, 1, "v"), (3, "a title", "x", None, None), (4, "a title", "x", None, None), (5, "", "x", 1, "v"), (6, "", "x", 1, "v"), (7, None, "x", 1, "v")]
    df = spark.createDataFrame(rows, "id long, title string, author string, year int, venue string")
    held, scored, leaders = linkage.clusters_of_copies(df, "id", "title", "author", "year", "venue", linkage.Tables(spark, "alone"))
    assert {r.id: r.leader for r in linkage.of_members(held, leaders).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    assert [(r.a, r.b, r.score) for r in linkage.member_scores(held, leaders, scored).collect()] == [(3, 4, 0.95)]
