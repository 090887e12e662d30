"""The similarity join of titles against brute force."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeloom.functions.similarity import jaro_many, jaro_similarity, with_jaro
from citeloom.operators import linkage, titlejoin
from citeloom.plans.scratch import Tables


def titles(n, seed, long=0):
    rng = random.Random(seed)
    words = ["limits", "growth", "world", "model", "of", "the", "a", "new", "study", "zebra", "quiz", "é", "ab", "b"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 4, 6]))) for _ in range(n)]
    out += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(long)]
    for t in out[: n // 2] + out[n:]:
        chars = list(t)
        for _ in range(rng.choice([1, 1, 2, 3])):
            k = rng.randrange(len(chars)) if chars else 0
            chars[k : k + 1] = rng.choice(["", "x", *(c + d for c in chars[k : k + 1] for d in (c, ""))])
        out.append("".join(chars) or "b")
    return out


def plain_jaro(a, b):
    """By the definition, place by place."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(x)
                break
    other = [y for y, f in zip(b, free, strict=True) if not f]
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other, strict=True)) // 2) / m) / 3 if m else 0.0


def test_many_pairs_equal_single_ones():
    rng = random.Random(2)
    t = ["", "a", "ab", "ba", "\0", "a\0", *titles(60, 1, 5)]
    pairs = [(rng.choice(t), rng.choice(t)) for _ in range(3000)]
    want = [plain_jaro(x, y) for x, y in pairs]
    assert [jaro_similarity(x, y) for x, y in pairs] == want
    assert np.allclose(jaro_many([x for x, _ in pairs], [y for _, y in pairs]), want, atol=1e-12)
    assert np.allclose(jaro_many([x for x, _ in pairs], [y for _, y in pairs], cells=100), want, atol=1e-12)


def test_nulls_have_no_similarity(spark):
    df = spark.createDataFrame([("ab", "ab"), ("ab", None), (None, None), ("", "")], "a string, b string")
    assert [r.s for r in with_jaro(df, "a", "b", "s").collect()] == [1.0, None, None, 0.0]


@pytest.mark.parametrize("least", [0.7, 0.8, 0.92])
def test_similar_titles_equal_brute_force(spark, least):
    t = dict(enumerate(sorted(set(titles(150, 5, 12)))))
    rows = spark.createDataFrame([(i, x, i % 2) for i, x in t.items()] + [(9999, None, 0), (9998, "", 0)], "id long, t string, g int")
    keyed = titlejoin.title_keys(rows, "t", least).drop("t")
    pairs = titlejoin.candidate_pairs(keyed, keyed, "id", "id", ["g"], least)
    got = {(r.a, r.b): r.sim for r in titlejoin.similar_pairs(pairs, rows, "id", "t", least).collect()}
    want = {(i, j): s for i in t for j in t if i < j and i % 2 == j % 2 and (s := jaro_similarity(t[i], t[j])) >= least}
    assert got.keys() == want.keys() and len(want) > 10
    share = {0.7: 0.8, 0.8: 0.5, 0.92: 0.1}[least]  # low thresholds bound little
    assert pairs.count() < share * sum(1 for i in t for j in t if i < j and i % 2 == j % 2)


@pytest.mark.parametrize("block", [7, 64, 1000])
@pytest.mark.parametrize("open_", [0, 3, 1])  # no year, a third of the years or all unknown
def test_tiles_of_titles_equal_brute_force(spark, block, open_):
    t = [*titles(120, 6, 8), "a" * 700, "a" * 690 + "b" * 9, "".join(map(chr, range(200, 330))), "".join(map(chr, range(204, 330)))]
    rows = sorted({(x, None if open_ and i % open_ == 0 else i * i % 4) for i, x in enumerate(t)}, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    rows = [(i, *r) for i, r in enumerate(rows, 1)]
    got = [tuple(r) for r in titlejoin.numbered_pairs(spark.createDataFrame(rows, "id long, t string, y int"), 0.92, block).collect()]
    want = {(i, j): s for i, x, y in rows for j, z, w in rows if i < j and (w is None or w == y) and (s := jaro_similarity(x, z)) >= 0.92}
    assert len(got) == len(want) > 10 and all(abs(want[a, b] - s) < 1e-12 for a, b, s in got)


def test_no_titles_make_no_pairs(spark):
    assert titlejoin.numbered_pairs(spark.createDataFrame([], "id long, t string, y int"), 0.92).collect() == []
    assert titlejoin.numbered_pairs(spark.createDataFrame([(1, "", 3), (2, "", None)], "id long, t string, y int"), 0.92).collect() == []


def test_many_titles_of_unknown_years_are_compared_in_tiles():
    """Words of few letters have frequent tokens only: keys of them thin nothing, tiles need a second for 36 million pairs."""
    rng = np.random.default_rng(3)
    words = np.array(["the", "an", "on", "in", "er", "es", "ed", "th", "re", "and", "ha", "of"])
    side = lambda k: pd.DataFrame({"id": np.arange(6000) + k, "t": [" ".join("".join(w) for w in words[rng.integers(0, 12, (6, 3))]) for _ in range(6000)], "y": np.nan})
    one, two = side(1), side(6001)
    two.loc[0, "t"] = one.loc[5999, "t"]
    began = time.process_time()
    got = titlejoin.tile_pairs(one, two, 0.92)
    assert time.process_time() - began < 60 and (6000, 6001, 1.0) in set(got.itertuples(index=False, name=None))
    some = [(i, j, s) for i in range(0, 6000, 97) for j in range(0, 6000, 101) if (s := jaro_similarity(one["t"][i], two["t"][j])) >= 0.92]
    assert {(i + 1, j + 6001) for i, j, _ in some} == {(a, b) for a, b in zip(got["a"], got["b"], strict=True) if (a - 1) % 97 == 0 and (b - 6001) % 101 == 0}


def word_titles(n, seed):
    """Six words of two or three of 26 syllables each, as a page of text begins."""
    rng = np.random.default_rng(seed)
    parts = np.array("the an on in er es ed th re and ha of at en to it is ou ar as he hi le se me qu".split())
    return [" ".join("".join(parts[rng.integers(0, 26, k)]) for k in rng.integers(2, 4, 6)) for _ in range(n)]


def test_a_tile_of_many_titles_costs_few_seconds():
    """400 million pairs; comparing them by products of counts took 98 CPU seconds."""
    one, two = (pd.DataFrame({"id": np.arange(20000) + k, "t": word_titles(20000, k), "y": np.nan}) for k in (1, 20001))
    two.loc[0, "t"] = one.loc[19999, "t"] + "x"
    began = time.process_time()
    got = titlejoin.tile_pairs(one, two, 0.92)
    assert time.process_time() - began < 15 and (20000, 20001) in set(zip(got["a"], got["b"], strict=True))


def test_equal_titles_are_compared_once_and_stand_for_all_their_rows(monkeypatch):
    seen = []
    similar = titlejoin._Tile.similar
    monkeypatch.setattr(titlejoin._Tile, "similar", lambda self, x, y: seen.append(len(x) * len(y)) or similar(self, x, y))
    one = pd.DataFrame({"id": np.arange(1, 3001), "t": ["limits to growth", "limits to growths", "other"] * 1000, "y": np.arange(3000) // 3})
    two = pd.DataFrame({"id": [3001, 3002], "t": ["limits to growth", "a world model"], "y": np.nan})
    got = titlejoin.tile_pairs(one, two, 0.92)
    assert sum(seen) == 6 and len(got) == 2000 and set(got["b"]) == {3001} and set(got["a"] % 3) == {1, 2}


def test_bits_of_words_equal_plain_comparisons():
    """Long titles, many letters and ends of words of 64 bits."""
    rng = random.Random(11)
    t = [*dict.fromkeys([*titles(200, 12, 10), *word_titles(40, 3), "a" * 63, "a" * 64, "a" * 65, "ab" * 32, "ba" * 32, "".join(map(chr, range(300, 364))), "".join(map(chr, range(301, 366)))])]
    tile = titlejoin._Tile(t, 0.92)
    i, j = (np.array([rng.randrange(len(t)) for _ in range(4000)]) for _ in range(2))
    short = np.flatnonzero((tile.size[i] <= 64) & (tile.size[j] <= 64))
    i, j = i[short], j[short]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
        return row[-1]

    exact = tile.exact[i] & tile.exact[j]
    got = tile._in_order(i, j)
    assert all(g == common(t[a], t[b]) if e else g >= common(t[a], t[b]) for a, b, g, e in zip(i[:800], j[:800], got[:800], exact[:800], strict=True))
    assert np.array_equal(tile._jaro(i[exact], j[exact]), [plain_jaro(t[a], t[b]) for a, b in zip(i[exact], j[exact], strict=True)]) and 0 < exact.sum()
    everything = np.arange(len(t))
    assert {(a, b) for a, b, _ in zip(*tile.similar(everything, everything), strict=True)} == {(a, b) for a in everything for b in everything if jaro_similarity(t[a], t[b]) >= 0.92}


def test_low_thresholds_raise():
    with pytest.raises(ValueError):
        titlejoin.share_needed(0.6)


def brute_groups(rows, least=0.92):
    """Greedy leaders in the order of year, unknown ones last, and title."""
    order = sorted({(y, t) for _, t, y in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    group, n = {}, 0
    for i, (y, t) in enumerate(order):
        if i in group:
            continue
        n += 1
        group[i] = n
        for j in range(i + 1, len(order)):
            u, s = order[j]
            if j not in group and (y is None or u is None or u == y) and jaro_similarity(t, s) >= least:
                group[j] = n
    return {order[i]: f"title:{g}" for i, g in group.items()}


def test_title_groups_are_numbered_by_their_leaders(spark):
    rng = random.Random(7)
    rows = [(i, t, rng.choice([None, 1999, 2000, 2001])) for i, t in enumerate(titles(120, 9, 6))] + [(500, None, 2000)]
    df = spark.createDataFrame(rows, "id long, title string, year int")
    got = {(r.y, r.t): r.group for r in linkage.title_groups(df, "title", "year", Tables(spark, "groups")).collect()}
    assert got == brute_groups(rows) and len(set(got.values())) < len(got)


def test_scored_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["x", "y", None]), rng.choice([None, 1999, 2000, 2003]), rng.choice(["v one", "v two", None])) for i, t in enumerate(titles(150, 3))]
    df = spark.createDataFrame(rows, "id long, title string, author string, year int, venue string").withColumn("ord", F.col("id"))
    got = {(r.a, r.b): r.score for r in linkage.scored_pairs(df, "id", "title", "author", "year", "venue", "ord").collect()}
    want = {}
    for i, t, a, y, v in rows:
        for j, s, b, z, w in rows:
            if i < j and a == b and a is not None and (y is None or z is None or abs(y - z) <= 1):
                score = round(0.70 * jaro_similarity(t, s) + 0.25 + (0.05 * jaro_similarity(v, w) if v and w else 0), 6)
                if score >= 0.86:
                    want[i, j] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 20


def plain_leaders(n, pairs):
    smaller = {}
    for a, b in pairs:
        smaller.setdefault(b, []).append(a)
    leader = {}
    for i in range(n):
        own = [a for a in sorted(smaller.get(i, ())) if leader[a] == a]
        leader[i] = own[0] if own else i
    return leader


def test_a_chain_ends_after_a_block_a_job(spark, monkeypatch):
    """Each node hangs on the one before, so rounds alone would be as many as nodes."""
    monkeypatch.setattr(linkage, "LOCAL", 10_000)
    n = 40_000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tables = Tables(spark, "chain")
    before = tables.written
    found = linkage.leader_clusters(spark.range(n), pairs, tables)
    wrong = found.where(F.col("leader") != F.col("id") - F.col("id") % 2).count()
    assert found.count() == n and wrong == 0
    assert tables.written - before < 60  # some for the components, whose rounds grow with the logarithm


@pytest.mark.parametrize("local", [1, 7, 100_000])
def test_blocks_equal_a_plain_visit(spark, monkeypatch, local):
    monkeypatch.setattr(linkage, "LOCAL", local)
    monkeypatch.setattr(linkage, "ROUNDS", 1)
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.leader for r in linkage.leader_clusters(spark.range(40), df, Tables(spark, "blocks")).collect()}
    assert got == plain_leaders(40, pairs)
