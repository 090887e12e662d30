"""Hard negatives, exact deduplication and vector codes: brute force and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import exact_index, hard_negatives, kdtree_codes
from citeloom.llm.common import meet_groups

VECTORS = "vec_id long, embedding array<float>, label int, row string, v string, _label string, h int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "clash", "clash", "clash", 1) for i, v, g in rows], VECTORS)


def odd_vectors(dim):
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [None] * dim, 1), (9003, [nan] + [0.0] * (dim - 1), 2), (9004, [inf] * dim, 2), (9005, [], 1), (9006, [0.5] * (dim - 1), 3)]


# exact deduplication


def brute_groups(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    return sorted(
        (str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["", " ", "a", "A", "a ", "é", "é", "x" * 200_000, "x" * 199_999 + "y", "\0", "\n"] + [f"text {i}" for i in range(60)]
    out = [(i, rng.choice(base)) for i in range(600)] + [(1000 + i, "hot") for i in range(400)]
    return out + [(2000, None), (None, "a"), (None, None), (None, "alone"), (None, "alone"), (3000, "twice"), (3000, "twice"), (3000, "other")]


@pytest.mark.parametrize("bits,capacity", [(64, 1 << 20), (64, 2), (4, 3), (1, 1)])
def test_exact_groups_equal_brute_force(spark, texts, bits, capacity):
    docs = spark.createDataFrame([(i, t, "clash", 1, "k", 2) for i, t in texts], "doc_id long, text string, key string, n int, sha string, row int").repartition(7)
    index = exact_index.build_index(spark, docs, capacity=capacity, bits=bits)
    got = exact_index.exact_groups(index).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_groups(texts)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    # the directory covers all slots, buckets are prefixes, and none is overfull that could split
    slots = sorted((r.slot, r.bucket, r.local_depth) for r in index.directory.collect())
    assert [s[0] for s in slots] == list(range(1 << index.depth))
    assert all(b == s >> (index.depth - d) << (index.depth - d) for s, b, d in slots)
    full = index.entries.groupBy("bucket").count().where(F.col("count") > capacity).select("bucket").collect()
    assert bits < 8 or not full
    chains = index.entries.groupBy("key").agg(F.count("*").alias("n"), F.max("chain").alias("last")).collect()
    assert all(r["last"] == r["n"] - 1 for r in chains) and (bits > 8 or max(r["n"] for r in chains) > 1)
    # every key lies in its bucket
    spans = {b: d for _, b, d in slots}
    for r in index.entries.collect():
        slot = (r.key & (2**64 - 1)) >> (64 - index.depth) if index.depth else 0
        d = index.depth - spans[r.bucket]
        assert slot >> d << d == r.bucket


def test_exact_dedup_and_edges(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, _mark string")
    out = exact_index.exact_dedup(spark, docs)
    assert out.columns == docs.columns
    want = {}
    for i, t in texts:
        want[t or ""] = max(want.get(t or "", -1), -1 if i is None else i)
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in out.collect()) == sorted(want.items())
    assert exact_index.exact_groups(exact_index.build_index(spark, docs.limit(0))).count() == 0
    assert exact_index.exact_dedup(spark, docs.limit(0)).count() == 0


def test_equal_digests_of_different_texts_raise(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "b")], "doc_id long, text string")
    monkeypatch.setattr(exact_index, "digest", lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    monkeypatch.setattr(exact_index, "text_key", lambda text, bits=64: F.length(text).cast("long") * 0)
    with pytest.raises(ValueError, match="different texts"):
        exact_index.build_index(spark, docs)


def test_exact_plan_has_no_python(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    plan = exact_index.exact_groups(exact_index.build_index(spark, docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_groups_are_broadcast_and_small_ones_shuffled(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    met = meet_groups(rows, groups, ["k"], "n", 50_000)
    assert met.count() == 50_000 and met.where("k = 0").select("n").distinct().collect()[0].n == 16_667


# vector codes


def brute_codes(rows, dim):
    kept = [(i, v, g) for i, v, g in rows if v is not None and len(v) == dim and None not in v and all(math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], g) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d, far = dim // 8, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[r[1][p * d : (p + 1) * d] for r in kept[:16]] for p in range(8)]
    for step in range(7):
        codes = []
        for _, y, _ in kept:
            codes.append([min((far(y[p * d : (p + 1) * d], e), k) for k, e in enumerate(books[p])) for p in range(8)])
        if step == 6:
            break
        for p in range(8):
            for k in range(len(books[p])):
                own = [r[1][p * d : (p + 1) * d] for r, c in zip(kept, codes, strict=True) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c[1]:02x}" for c in code), sum(c[0] for c in code), str(r[2])) for r, code in zip(kept, codes, strict=True)), sha


@pytest.mark.parametrize("case", ["groups", "few", "ties", "narrow"])
def test_codes_equal_brute_force(spark, tmp_path, monkeypatch, case):
    rng = np.random.default_rng(4)
    dim = 8 if case == "narrow" else 32
    n = 9 if case == "few" else 700
    centres = rng.normal(size=(12, dim))
    rows = [(int(i), (centres[i % 12] + 0.2 * rng.normal(size=dim)).tolist(), [None, 0, 1, 2][i % 4]) for i in rng.permutation(n)]
    if case == "ties":  # few distinct values, so that many distances are equal; repeated rows and ids
        rows = [(i // 2, np.floor(rng.normal(size=dim)).clip(-1, 1).tolist(), 0) for i in range(n)] + [(5, [0.0] * dim, 1)] * 200 + [(None, [1.0] * dim, None)]
    rows += odd_vectors(dim)
    monkeypatch.setattr(kdtree_codes, "CHUNK", 100)
    vector_frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = kdtree_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    want, sha = brute_codes(rows, dim)
    label = {}
    made = kdtree_codes.compress(spark, spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    for r in made.codes.collect():
        label[r.label] = label.get(r.label, 0) + r.error
    assert sorted((str(r.vec_id), r.code, r.error, str(r.label)) for r in made.codes.collect()) == want
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == [w[:3] for w in want]
    assert {r.codebooks_sha256 for r in got} == {sha} and {r.label_error for r in got} == set(label.values())


def test_filtering_skips_points_and_is_exact():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(5000, 2)) * 500).astype(np.int64)
    entries = points[:16]
    tree = kdtree_codes.Tree.unpack(kdtree_codes.Tree.of(points).pack(), 5000, 2)
    sums, counts, code, compared = tree.assign(entries, codes=True)
    want = kdtree_codes.nearest(points, entries)
    own = np.zeros(5000, np.int64)
    own[tree.order] = code
    assert (own == want).all() and compared < 2500  # most points are assigned with their subtree
    assert (counts == np.bincount(want, minlength=16)).all() and (sums == np.stack([points[want == k].sum(0) for k in range(16)])).all()


def test_codes_edges(spark):
    empty = vector_frame(spark, odd_vectors(16)[:5])
    made = kdtree_codes.compress(spark, empty)
    assert made.codes.count() == 0 and made.codebooks == []
    with pytest.raises(ValueError, match="divide"):
        kdtree_codes.compress(spark, vector_frame(spark, [(1, [1.0] * 12, 0)]))
    with pytest.raises(Exception, match="too large"):
        kdtree_codes.compress(spark, vector_frame(spark, [(1, [1e30] * 8, 0)]))


# hard negatives


def brute_negatives(rows, anchors, dim, low=80):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if i is not None and g is not None and v is not None and len(v) == dim and None not in v and all(math.isfinite(x) for x in v)]
    out = []
    for at, (i, q, g) in enumerate(kept):
        if i % anchors:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r[1], strict=True)), r[0], r[2]) for k, r in enumerate(kept) if k != at]
        scores.sort(key=lambda s: s[:2])
        for s, p, _ in [x for x in scores if x[2] == g][:5]:
            hard = [x for x in scores if x[2] != g and low * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "common", "ties"])
def test_negatives_equal_brute_force(spark, monkeypatch, case):
    rng = np.random.default_rng(6)
    dim, n = 19, 900
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), (centres[i % 5] + 0.6 * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    if case == "common":  # a third of the rows are one vector
        rows += [(int(2000 + i), centres[0].tolist(), i % 2) for i in range(450)]
    if case == "ties":
        rows = [(i, np.floor(rng.normal(size=dim)).clip(-1, 1).tolist(), i % 3) for i in range(500)] + [(40, [1.0] * dim, 1), (40, [1.0] * dim, 1), (40, [-1.0] * dim, None), (None, [1.0] * dim, 2)]
    rows += odd_vectors(dim)
    monkeypatch.setattr(hard_negatives, "HELD", 150)
    monkeypatch.setattr(hard_negatives, "CHUNK", 64)
    monkeypatch.setattr(hard_negatives, "FIRST", 5)
    df = vector_frame(spark, rows).repartition(6)
    got = hard_negatives.mine_negatives(spark, df, F.col("vec_id") % 20 == 0, slice_size=17)
    found = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    assert found == brute_negatives(rows, 20, dim) and len(found) > 50


def test_score_bounds_hold_and_filter():
    rng = np.random.default_rng(9)
    q = np.floor(256 * (rng.normal(size=(8, 24))[rng.integers(0, 8, 3000)] + 0.1 * rng.normal(size=(3000, 24)))).astype(np.int64)
    books = hard_negatives.fit_codebooks(q[:1000])
    codes, norms = hard_negatives.quantise(q, books)
    score, off = hard_negatives.score_bounds(q[:50], books, codes, norms)
    exact = q[:50] @ q.T
    assert (np.abs(score - exact) <= off).all()
    top = np.sort(exact, axis=1)[:, -5:-4]
    assert ((score + off) >= top).mean() < 0.35  # most rows can't be among the best five


def test_negatives_edges(spark):
    assert hard_negatives.mine_negatives(spark, vector_frame(spark, odd_vectors(8)[:5]), F.lit(True)).count() == 0
    assert hard_negatives.mine_negatives(spark, vector_frame(spark, [(7, [1.0] * 8, 1)]), F.col("vec_id") % 100 == 0).count() == 0
    alone = vector_frame(spark, [(100, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [-1.0] * 8, 2)])
    assert hard_negatives.mine_negatives(spark, alone, F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine_negatives(spark, vector_frame(spark, [(100, [1e30] * 8, 1)]), F.lit(True))
    score = np.array([7, -7, 0, 2**62, -(2**62), 99, 100], np.int64)
    assert hard_negatives._floor_share(score, 20).tolist() == [20 * x // 100 for x in score.tolist()]
