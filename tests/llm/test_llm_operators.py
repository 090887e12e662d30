"""Brute-force checks and edge cases of the training-data operators."""

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest
from oracle import compare, rows_of
from pyspark.sql import functions as F

from citeloom.llm import bpe, cdc_dedup, chat_format, decontam, embed_dedup, html_template, license_scan, ngram_join, quality_cnn, queries, url_tree
from citeloom.llm.common import Bloom, Scratch, components, without

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string"
RNG = random.Random(11)
VOCAB = ["w" + "".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(800)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, one-word, long, unbroken, repeated and equal texts."""
    base = prose(120)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, base), (6, base), (7, prose(30_000)), (8, "x" * 50_000), (9, base + " end"), (5, base), (10, "é" * 3000 + " ü")]
    return docs_frame(spark, texts).cache()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("hot", [100_000, 3])
def test_ngram_join_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_LIST", hot)  # at 3 nearly all lists are spread
    monkeypatch.setattr(ngram_join, "PAIR_BLOCK", 2 if hot == 3 else 2048)
    monkeypatch.setattr(ngram_join, "BLOCK", 1 if hot == 3 else 256)  # nothing is clustered beforehand
    rng = random.Random(5)
    texts = []
    shared = prose(40, rng)
    for g in range(12):
        words = prose(rng.choice([4, 8, 60, 150]), rng).split()
        for k in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(k % 4 * len(words) // 60):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            texts.append((len(texts) * 3 + 1, " ".join(copy) + (" " + shared if g % 2 else "")))
    texts += [(997, None), (998, ""), (999, "One two"), (1000, "one  TWO")]
    got = ngram_join.ngram_jaccard_join(spark, docs_frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_ngram_borderline_and_tail():
    assert ngram_join.links(3, 3, 4) and not ngram_join.links(2, 3, 3)
    for n in (1, 4, 37, 400, 9000):
        assert 1 <= ngram_join.least_shared(n) <= ngram_join.posted(n) <= ngram_join.prefix_length(n)
        assert ngram_join.sketch_length(n, 0) == ngram_join.prefix_length(n) >= ngram_join.sketch_length(n, n)
    rng = np.random.default_rng(8)
    for n in (40, 300, 3000):  # partners at the threshold, of equal and of the most unequal sizes
        for extra in (0, n // 3):
            for _ in range(100):
                size = n + extra
                common = -(-3 * (n + size) // 7)
                x = rng.integers(0, 1 << 63, n + size - common, dtype=np.uint64)
                a, b = x[:n], x[n - common :]
                first = [set(np.sort(ngram_join._key(y))[: ngram_join.posted(len(y))].tolist()) for y in (a, b)]
                assert len(first[0] & first[1]) >= max(ngram_join.least_shared(n), ngram_join.least_shared(size))


def test_ngram_join_of_long_texts(spark, monkeypatch):
    """Sets beyond the exact prefix, with a passage that all hold, near the threshold and across clusters."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    monkeypatch.setattr(ngram_join, "HOT", 6)
    rng, shared, texts = random.Random(9), prose(200, random.Random(1)), []
    for g in range(10):
        words = prose(1500, rng).split()
        for k in range(4):
            copy = list(words)
            for at in rng.sample(range(1500), (0, 20, 46, 70)[k]):
                copy[at] = rng.choice(VOCAB)
            texts.append((len(texts), " ".join(copy) + " " + shared))
    got = ngram_join.ngram_jaccard_join(spark, docs_frame(spark, texts)).collect()
    want = brute_components(texts)
    assert len({c for _, c in want.values()}) > 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_ngram_candidates_stay_in_proportion(spark, monkeypatch):
    """Unrelated long texts that share a line: no rows that grow with the pairs."""
    made = {}
    write = Scratch.write

    def counted(self, df, *rest):
        out = write(self, df, *rest)
        made[tuple(out.columns)] = made.get(tuple(out.columns), 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rng, line = random.Random(4), prose(30, random.Random(2))
    for n in (50, 200):
        made.clear()
        docs = docs_frame(spark, [(i, prose(8000, rng) + "\n" + line) for i in range(n)])
        got = ngram_join.ngram_jaccard_join(spark, docs).collect()
        assert all(r.component_id == r.doc_id for r in got)
        assert made["job", "sid", "comp"] == 0 and sum(made.values()) <= 80 * n


def test_rtree_finds_every_possible_partner():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 200).astype(np.uint64)) for _ in range(150)]
    points = np.stack([ngram_join.point(s) for s in sets])
    tree = ngram_join.CountRTree(points)
    for i in range(0, 150, 10):
        found = set(tree.search(points[i])[0].tolist())
        for j in range(150):
            if ngram_join.links(ngram_join.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                assert j in found


def test_ngram_edges(spark, edge):
    rows = {(r.doc_id): r for r in ngram_join.ngram_jaccard_join(spark, edge).collect()}
    assert {rows[i].component_id for i in (5, 6, 9)} == {5}
    assert all(rows[i].n_shingles == 0 and rows[i].component_id == i for i in (1, 2, 3))
    assert ngram_join.ngram_jaccard_join(spark, edge.limit(0)).count() == 0


def test_components_and_without(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (2, 1)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 140)}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (3, "c")], "doc_id long, text string")
    gone = spark.createDataFrame([(3,), (None,)], "doc_id long")
    assert sorted(str(r.doc_id) for r in without(df, gone, once=True).collect()) == ["1", "2", "None"]
    assert sorted(str(r.doc_id) for r in without(df, gone).collect()) == ["1", "2", "2", "None"]
    assert Bloom.of(df.select("doc_id")).where(df, 0).count() == 4


def test_bpe_equals_the_library(spark, edge):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    own = bpe.Bpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    hard = ["", "a<|endoftext|>b", "it's  we'll\n\n x", "日本語 é😀", "0123 ½", "\x00", "zz" * 3000, prose(500)]
    for t in hard:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    rows = bpe.bpe_digests(spark, edge, bpe.default_vocabulary()).collect()
    assert len(rows) == edge.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, empty, empty)}
    kept = bpe.bpe_encode(spark, edge, bpe.default_vocabulary())
    assert kept.columns.count("ids") == 1 and bpe.bpe_decode(spark, kept.limit(0), bpe.default_vocabulary()).count() == 0


def test_bpe_equals_the_library_on_a_whole_table(spark, sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_bpe_codec"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(back.encode()).hexdigest())


def test_license_scan(spark, edge):
    texts = [(1, "Intro.\nLicensed under the APACHE License, Version 2.0.\nCC  by"), (2, "apache licenses cc bye"), (3, None), (4, ""), (5, "mit license mit-license"), (6, "Licensed under the Apache, version 2"), (7, "THIS WOR\u212a IS LICENSED UNDER THE GNU GENERAL PUBLIC L\u0130CENSE VERSION 3")]
    rows = {r.doc_id: r for r in license_scan.license_scan(docs_frame(spark, texts)).collect()}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word) == (11, 2, 4, 9)
    assert (rows[1].base_labels, rows[1].labels, rows[1].score) == ("apache,cc-by", "apache,apache-2.0,cc-by", 1.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].labels) == (0, None, "")
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word) == (2, 0, 2)
    assert rows[3].n_words == rows[4].n_words == 0 and rows[3].score == 0.0
    assert (rows[7].n_words, rows[7].n_base, rows[7].base_labels) == (12, 0, "")
    assert license_scan.license_scan(edge).count() == edge.count() and license_scan.license_scan(edge.limit(0)).count() == 0


def test_license_notices_of_further_licenses(spark):
    """Each statement in its usual spelling, wrapped, inside other text; a text without one has no label."""
    own = {
        "lgpl-notice": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; version 2.1.",
        "agpl-notice": "You should have received a copy of the GNU Affero General Public License\nalong with this program.",
        "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a binary.",
        "cc0-1.0": "To the extent possible under law, the author has waived all copyright and\nrelated or neighboring rights to this work.",
        "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
        "epl-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0",
    }
    own["unlicense"] = own["unlicense"].replace("\n\n", "\n")
    rng = random.Random(6)
    texts = [(i, f"{prose(20, rng)}\n\n{t}\n\n{prose(20, rng)}") for i, t in enumerate(own.values())] + [(99, prose(200, rng))]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.license_scan(docs_frame(spark, texts)).collect()}
    assert all(label in got[i] for i, label in enumerate(own)) and got[99] == {""}


def test_license_statements_that_are_wrapped(spark):
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that\n"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License\n"
    code = "\n".join(f"x{i} = y{i}" for i in range(400)) + "\n"
    apart = "redistribution and use in source\n" + code + "binary forms with or without modification are permitted\n"
    texts = [(1, bsd), (2, gpl), (3, code + bsd + code), (4, apart), (5, "redistribution and use in source\n *\nbinary forms without modification permitted"), (6, code + bsd)]
    rows = {r.doc_id: r for r in license_scan.license_scan(docs_frame(spark, texts)).collect()}
    assert all(rows[i].labels == "bsd" and rows[i].score == 1.0 for i in (1, 3, 6))
    assert "gpl-notice" in rows[2].labels and rows[2].score == 1.0 and rows[4].labels == rows[5].labels == ""


def test_license_filters_drop_nothing(spark):
    """The prefix, length and positional filters against plain containment."""
    rng = random.Random(2)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    texts = [(i, " ".join(rng.sample(words, rng.randint(3, len(words) - 5)))) for i in range(60)] + [(100 + i, " ".join(t.split()[: max(2, len(t.split()) - rng.randint(0, 4))])) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    norm = docs_frame(spark, texts).select("doc_id", "text").withColumn("s", license_scan.spaced(F.col("text")))
    got = license_scan.template_matches(norm, license_scan.word_frequencies(norm)).collect()
    for r in got:
        held = set(dict(texts)[r.doc_id].split())
        want = {(k, len(held & set(w)) / len(w)) for k, w, need in license_scan.template_sets() if len(held & set(w)) >= need}
        assert {(m.label, m.held) for m in r.matches} == want


def brute_links(rows):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {i: [0, i] for i, _ in rows}
    ids = sorted(good)
    unit = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    for k, i in enumerate(ids):
        out[i] = [int(near[k].sum()), ids[root(k)]]
    return out


def test_embeddings_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(150):
        base = rng.normal(size=24)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25])]))
    extra = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24]
    rows += [(5000 + i, v) for i, v in enumerate(extra)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, code string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_near_dedup(spark, df).collect()}
    want = brute_links(rows)
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.9 * total
    assert all(got[i][0] <= want[i][0] for i in got)
    assert all(got[5000 + i] == (0, 5000 + i, True) for i in range(len(extra)))
    assert np.mean([got[i][1] == want[i][1] for i in got]) >= 0.95
    assert embed_dedup.embedding_near_dedup(spark, df.limit(0)).count() == 0


def test_embeddings_of_shared_ids_and_extreme_sizes(spark):
    """A row in, a row out: several vectors of one id, rows without an id, and squares that over- or underflow."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [(5, a), (5, b), (7, a * 1e200), (9, b * 1e-200), (9, b * 5e-324), (None, -a), (None, b), (11, -b), (11, -b), (12, np.zeros(8))]
    df = spark.createDataFrame([(i, x.tolist(), None) for i, x in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.embedding_near_dedup(spark, df).collect())
    want = [("5", 1, "5", True), ("5", 3, "5", True), ("7", 1, "5", False), ("9", 3, "5", False), ("9", 3, "5", False), ("None", 0, "None", True), ("None", 3, "5", False)]
    assert got == sorted([*want, ("11", 1, "11", True), ("11", 1, "11", True), ("12", 0, "12", True)])


@pytest.mark.parametrize("common", [0.5, 0.8])
def test_embeddings_with_a_common_direction(spark, common):
    """Lone pairs at the threshold among vectors whose mean cosine is far from zero."""
    rng = np.random.default_rng(12)
    n, dim, pairs = 12_000, 64, 150
    axis = np.eye(dim)[0] * np.sqrt(common)

    def apart(k):
        x = rng.normal(size=(k, dim))
        x[:, 0] = 0
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x, y = apart(n), apart(pairs)
    x[n - pairs :] = x[:pairs] * (c := (0.905 - common) / (1 - common)) + (y - (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]) * np.sqrt(1 - c * c)
    x[n - pairs :] = x[n - pairs :] / np.linalg.norm(x[n - pairs :], axis=1, keepdims=True)
    v = axis + x * np.sqrt(1 - common)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in embed_dedup.embedding_near_dedup(spark, df).collect()}
    linked = [(i, n - pairs + i) for i in range(pairs) if v[i] @ v[n - pairs + i] / np.linalg.norm(v[i]) / np.linalg.norm(v[n - pairs + i]) >= 0.9]
    assert len(linked) > 100 and np.mean([got[i] == got[j] for i, j in linked]) >= 0.95


def test_rounded_vectors_bound_cosines():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 48)) * rng.choice([0.01, 1, 30], size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, error = embed_dedup._restored(embed_dedup.rounded(x))
    assert (np.linalg.norm(x - y, axis=1) <= error + 1e-6).all()
    slack = error[:, None] + (1 + error[:, None]) * error[None, :] + 1e-5
    assert (np.abs(x @ x.T - y @ y.T) <= slack).all()


def test_embeddings_near_the_threshold(spark):
    """Pairs on both sides of the cosine, closer to it than rounding can tell."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(120, 24))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = 0.9 + rng.choice([-0.004, -0.0005, 0.0005, 0.004], size=(120, 1))
    vectors = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * other))
    rows = list(enumerate(vectors.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: [r.n_links, r.component_id] for r in embed_dedup.embedding_near_dedup(spark, df).collect()}
    want = brute_links(rows)
    assert got == want and 40 < sum(n for n, _ in want.values()) // 2 < 80


def test_embeddings_lone_pairs_in_a_large_background(spark):
    # a narrow window is to a small table what the usual one is to a table ten times as large
    rng = np.random.default_rng(3)
    base, other = rng.normal(size=(2, 800, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.901 * base + np.sqrt(1 - 0.901**2) * other
    vectors = np.concatenate((rng.normal(size=(8000, 32)), base, near))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embed_dedup.embedding_near_dedup(spark, df, window=4).collect()}
    assert np.mean([got[8000 + i] == got[8800 + i] for i in range(800)]) >= 0.97
    counts = [embed_dedup.passes_for(10**k, window=48) for k in range(9)]
    assert counts == sorted(counts) and counts[0] == embed_dedup.PASSES and counts[6] >= 38 and counts[7] >= 65
    wide = [embed_dedup.passes_for(10**k) for k in range(9)]
    assert wide == sorted(wide) and wide[6] >= 22 and wide[7] >= 38


def test_quality_network(spark, edge):
    rng = random.Random(9)
    good = [(i, prose(rng.randint(20, 400), rng)) for i in range(0, 300, 2)]
    bad = [(i, "*** ".join(prose(rng.randint(20, 400), rng).split()).upper()) for i in range(1, 300, 2)]
    docs = docs_frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_cnn.fit_quality(docs, labels)
    rows = quality_cnn.score_quality(spark, docs, model).where(quality_cnn.held_out()).collect()
    assert rows and np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows]) > 0.95
    scored = quality_cnn.score_quality(spark, edge, model)
    assert scored.columns[:-1] == edge.columns and scored.count() == edge.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality_cnn.score_quality(spark, edge, quality_cnn.fit_quality(docs, labels.limit(0))).first().score == 0.5
    # one text alone scores as it does among others
    data = [t.encode() for _, t in good[:7]] + [b""]
    starts = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    alone = [model.score(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data]
    assert np.allclose(model.score(flat, starts), alone)


def test_quality_gradient_equals_differences():
    """Each parameter's gradient against the numeric one, with the same pieces."""
    rng = np.random.default_rng(3)
    net = quality_cnn.ByteCnn()
    for k in ("mean", "most", "bias"):
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    doc, y = np.array([0, 0, 1, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.integers(0, 256, (4, quality_cnn.PIECES * quality_cnn.PIECE + 1, quality_cnn.BLOCK)).astype(np.uint8)
    real = np.array([256, 90, 256, 7])

    def loss():
        e = net.p["embed"][x].reshape(4, -1, quality_cnn.BLOCK * quality_cnn.DIM)
        z = e @ net.p["filters"]
        out = np.maximum(z[:, :-1, : quality_cnn.FILTERS] + z[:, 1:, quality_cnn.FILTERS :] + net.p["bias"], 0)
        pooled = np.stack([out[i, : real[i]].max(0) for i in range(4)])
        mean = np.stack([pooled[doc == d].mean(0) for d in range(3)])
        most = np.stack([pooled[doc == d].max(0) for d in range(3)])
        p = 1 / (1 + np.exp(-(mean @ net.p["mean"] + most @ net.p["most"] + net.p["base"])))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = net._gradient(x, real, doc, y)
    for k, p in net.p.items():
        flat, g = p.reshape(-1), np.asarray(grad[k], np.float64).reshape(-1)
        top = np.argsort(-np.abs(g))[:6]
        for i in [*top.tolist(), *rng.integers(0, len(flat), 6).tolist()]:
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-5 + 1e-3 * abs(g[i]), (k, i)


def test_quality_score_equals_plain_loops():
    model = quality_cnn.ByteCnn(3)
    rng = np.random.default_rng(2)
    for name in ("mean", "most", "bias"):
        model.p[name] = rng.normal(0, 0.3, quality_cnn.FILTERS).astype(np.float32)
    for size in (0, 1, 7, 900, 1024, 1025, 2500):
        text = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        blocks = [text[i : i + 4].ljust(4, b"\0") for i in range(0, size, 4)]
        vector = lambda b: model.p["embed"][list(b)].ravel()
        half = quality_cnn.FILTERS
        out = []
        for i, b in enumerate(blocks):
            nxt = blocks[i + 1] if i + 1 < len(blocks) else b"\0" * 4
            z = vector(b) @ model.p["filters"][:, :half] + model.p["bias"]
            if i + 1 < len(blocks) or True:
                z = z + vector(nxt) @ model.p["filters"][:, half:]
            out.append(np.maximum(z, 0))
        pooled, step, wide = [], quality_cnn.STEP * quality_cnn.PIECE, quality_cnn.PIECES * quality_cnn.PIECE
        for c in range(len(quality_cnn.chunks_of(text.decode("latin-1"))) if size else 0):
            part = out[c * step : c * step + wide]
            if part:
                pooled.append(np.max(part, axis=0))
        n_chunks = max(0, -(-(-(-size // 128) - 8) // 7)) + 1 if size else 0
        pooled = pooled[:n_chunks]
        logit = float(model.p["base"][0])
        if pooled:
            logit += float(np.mean(pooled, axis=0) @ model.p["mean"] + np.max(pooled, axis=0) @ model.p["most"])
        got = model.score(np.frombuffer(text, np.uint8), np.array([0, size]))[0]
        assert got == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4), size


def test_quality_sample_is_bounded_by_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality_cnn, "SAMPLE_BYTES", 3000)
    monkeypatch.setattr(quality_cnn.ByteCnn, "fit", lambda self, texts, labels: taken.append(texts) or self)
    docs = docs_frame(spark, [(i, "x" * 500) for i in range(30)] + [(40, "y" * 5000)])
    quality_cnn.fit_quality(docs, spark.createDataFrame([(i, 1, 0) for i in range(41)], "doc_id long, quality int, toxic int"))
    assert len(taken[0]) == 6 and all(len(b"".join(t)) == 500 for t in taken[0])
    long = "z" * 5000  # all chunks of a text, on the grid that scoring uses
    assert len(quality_cnn.chunks_of(long)) == 6 and quality_cnn.chunks_of(long)[-1][-1:] == b"z"


def brute_hits(text, items):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            win = x[k : k + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(n, rng)) for i, n in enumerate([3, 9, 10, 11, 25, 40])] + [(7, None), (8, "!!"), (10, "alpha")]
    texts = [(1, None), (2, ""), (3, items[0][1] + "," + items[0][1]), (4, prose(50, rng) + " " + items[4][1].upper() + ". " + prose(9, rng)), (5, "alpha Alpha beta")]
    texts += [(10 + k, prose(20, rng) + " " + " ".join(items[5][1].split()[k : k + 10]) + " " + prose(5, rng)) for k in range(6)]
    docs, bench = docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in texts}
    pick = lambda rows: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert pick(decontam.decontaminate(spark, docs, bench).collect()) == want
    monkeypatch.setattr(decontam, "SLICE_BYTES", 100)  # several passes
    assert pick(decontam.decontaminate(spark, docs, bench).collect()) == want
    rows = decontam.decontaminate(spark, docs_frame(spark, [(None, texts[3][1]), (None, "clean"), (7, texts[3][1]), (7, texts[2][1])]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == sorted([(0, want[4][1]), (0, 0), (7, want[4][1]), (7, want[3][1])])
    monkeypatch.undo()
    assert not any(r.contaminated for r in decontam.decontaminate(spark, docs, bench.limit(0)).collect())
    assert decontam.decontaminate(spark, docs.limit(0), bench).count() == 0


def test_near_matches(spark):
    item = " ".join(VOCAB[:10])
    moved = item.split()
    moved.insert(5, "extra")
    rows = decontam.decontaminate(spark, docs_frame(spark, [(1, item), (2, " ".join(moved)), (3, prose(30))]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: (r.contaminated, r.n_near_items) for r in rows.collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0)}


def test_windows_are_packed():
    import pickle

    rng = random.Random(3)
    win = decontam.Windows([(str(i), prose(2000, rng)) for i in range(100)])
    win.rank(np.zeros(len(win.terms), np.int64))
    assert len(pickle.dumps(win)) < 12 * 100 * 2000 * 7  # a bounded number of bytes for each of the text


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passage = prose(60, rng)
    clean = [(i, prose(rng.randint(80, 300), rng)) for i in range(40)]
    holders = [(100 + i, prose(rng.randint(5, 90), rng) + f"\n{passage} " + prose(rng.randint(5, 90), rng)) for i in range(30)]
    whole = [(200, clean[3][1]), (201, clean[3][1])]
    docs = docs_frame(spark, clean + holders + whole)
    spans = cdc_dedup.repeated_spans(docs).collect()
    flagged = {r.doc_id for r in spans}
    assert flagged >= {101 + i for i in range(29)} | {200, 201}
    assert not flagged & {i for i, _ in clean} and 100 not in flagged
    text = dict(clean + holders + whole)
    for r in spans:
        part = text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes].decode()
        assert any(part in text[s] for s in r.source_doc_ids)
    kept = {r.doc_id: r.text for r in cdc_dedup.substring_dedup(spark, docs).collect()}
    assert 200 not in kept and kept[5] == text[5] and passage in kept[100]
    assert all(passage[80:-80] not in kept[101 + i] for i in range(29))


def test_repeated_spans_equal_brute_force(spark):
    """Chunks by plain loops, the first place of each chunk by a dictionary, runs by a walk over each text."""
    rng = random.Random(18)
    parts = [prose(n, rng) for n in (30, 60, 90, 25)]
    texts = []
    for i in range(30):
        body = [prose(rng.randint(5, 60), rng)]
        for _ in range(rng.choice([0, 1, 2])):
            body += [rng.choice(parts), prose(rng.randint(1, 30), rng)]
        texts.append((i, "\n".join(body)))
    texts += [(50, texts[3][1]), (51, None), (52, "")]

    def cut(data):
        """Ends where the rating of a place is the largest of those REACH before and after it."""
        space = [b in b" \t\n\r\x0b\x0c" for b in data]
        rate = []
        for i in range(len(data)):
            h = 0
            for b in [0] * 16 + list(data[max(0, i - 15) : i + 1]):
                h = (2 * h + int(cdc_dedup._GEAR[b])) & 0xFFFF
            ends = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
            rate.append(h + 1025 if space[i] else (h >> 6) + 1 if ends else 0)
        at = [i + 1 for i, r in enumerate(rate) if r > max(rate[max(0, i - cdc_dedup.REACH) : i], default=0) and r >= max(rate[i + 1 : i + 1 + cdc_dedup.REACH], default=0)]
        return sorted({0, len(data), *at})

    pieces, first = {}, {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        data = (t or "").encode()
        at = cut(data) if data else []
        pieces[i] = [(a, b, data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        for a, _, chunk in pieces[i]:
            first.setdefault(chunk, (i, a))
    want = set()
    for i, own in pieces.items():
        data = (dict(texts)[i] or "").encode()
        starts = {k for k in range(len(data)) if not data[k : k + 1].isspace() and (k == 0 or data[k - 1 : k].isspace())}
        words = lambda a, b: len([k for k in starts if a <= k < b])  # noqa: E731, B023
        runs, run = [], []
        for a, b, chunk in [*own, (-1, -1, None)]:
            if chunk is not None and first[chunk] != (i, a):
                run.append((a, b, first[chunk][0], first[chunk][1] - a))
            elif run:
                runs.append(run)
                run = []
        for run in runs:
            line = {}
            for a, b, doc, away in run:
                x = line.setdefault((doc, away), [0, 0])
                x[0] += words(a, b)
                x[1] += b - a
            strong = [line[d, w][0] >= cdc_dedup.STRONG_WORDS or line[d, w][1] >= cdc_dedup.STRONG_BYTES for _, _, d, w in run]
            if any(strong):
                low, high = strong.index(True), len(run) - 1 - strong[::-1].index(True)
                a, b = run[low][0], run[high][1]
                if words(a, b) >= cdc_dedup.MIN_WORDS or b - a >= cdc_dedup.MIN_BYTES:
                    want.add((i, a, b - a, words(a, b), tuple(sorted({d for (_, _, d, _), ok in zip(run[low : high + 1], strong[low : high + 1], strict=True) if ok}))))
    got = {(r.doc_id, r.start_byte, r.n_bytes, r.n_words, tuple(r.source_doc_ids)) for r in cdc_dedup.repeated_spans(docs_frame(spark, texts)).collect()}
    assert got - want == set() and want - got == set() and len(want) > 15


def test_cdc_texts_without_spaces(spark):
    rng = random.Random(9)
    signs = lambda n, low, high: "".join(chr(rng.randint(low, high)) for _ in range(n))
    han, thai, code = signs(600, 0x4E00, 0x9FA5), signs(600, 0x0E01, 0x0E2E), signs(900, 65, 90)
    docs = [(1, han), (2, thai), (3, code), (11, han), (12, signs(300, 0x0E01, 0x0E2E) + thai), (13, "a key " + code), (20, signs(500, 0x4E00, 0x9FA5)), (21, han[:40])]
    frame = docs_frame(spark, docs)
    spans = {r.doc_id: r for r in cdc_dedup.repeated_spans(frame).collect()}
    assert set(spans) == {11, 12, 13} and spans[11].n_bytes == 1800 and spans[12].n_bytes >= 1600 and spans[13].n_bytes >= 750
    assert all(spans[10 + i].source_doc_ids == [i] for i in (1, 2, 3))
    kept = {r.doc_id: r.text for r in cdc_dedup.substring_dedup(spark, frame).collect()}
    assert 11 not in kept and all(kept[i] == t for i, t in docs if i not in (11, 12, 13)) and len(kept[12]) < 370


def test_cdc_edges(spark, edge):
    rows = cdc_dedup.substring_dedup(spark, edge).collect()
    assert {r.doc_id for r in rows} >= {1, 2, 4, 5, 7, 10} and 6 not in {r.doc_id for r in rows}
    assert cdc_dedup.repeated_spans(edge.limit(0)).count() == 0
    data = ("ab cd " * 50 + prose(300)).encode()
    _, start, length, words, _ = cdc_dedup.chunks(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert (start[1:] == (start + length)[:-1]).all() and length.sum() == len(data) and words.sum() == len(data.split())


def test_chunks_resist_shifts():
    digests = lambda d: set(cdc_dedup.chunks(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[4].tolist())
    for seed in range(20):  # an insertion moves the chunks of the next 64 bytes at most, whatever the text
        a = prose(400, random.Random(seed)).encode()
        assert len(digests(a) & digests(b"some words before " + a)) >= len(digests(a)) - 4


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "no-scheme/en/1", "http://A.Example.COM/en/7?x=1#y", "http://com/en/", "http://xcom/en/1", "https://example.net/de/85", "https://e.net/de/8", "http://x.org", "http://x.org?q=/es/", "http://a/b://c/en/", "http://\nh.com/en/2"]
    urls += [f"http://big.com/{RNG.choice(['a', 'b'])}/{i}" for i in range(60)] + ["http://x.com" + "/d" * 40]
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, template string")
    for r in url_tree.url_verdicts(df).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[2])
    assert url_tree.url_verdicts(df.limit(0)).count() == 0


def test_url_templates_merge_and_reject(spark):
    rows = [f"http://s.example.com/en/{w}/{i}" for i, w in enumerate(["red", "blue"] * 30)] + [f"http://s.example.com/shop/{i}x/p.html" for i in range(20)]
    rows += [f"http://m.net/{w}/1" for w in VOCAB[:40]]
    got = url_tree.url_verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    by = {r.page_id: r.template for r in got}
    assert by[0] == by[1] and by[0].endswith("/~/<number>") and by[60].endswith("<mixed>/p.html") and by[80] == "/*/<number>"


def test_url_sections_that_part_deep(spark):
    bad = ("block", "deep.org", "/a/b/c/d/e/f/bad/1")
    good = ("allow", "deep.org", "/a/b/c/d/e/f/good/1")
    paths = [f"/a/b/c/d/e/f/{k}/{i}" for k in ("bad", "good") for i in range(40)]
    paths += ["/a/b", "/a/b/c/d/e/f", "/" + "/".join("x" * 40), "/" + "/".join("x" * 12 + "y"), ""]
    rows = [(i, f"http://deep.org{p}") for i, p in enumerate(paths)]
    got = {r.path: r for r in url_tree.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), [bad, good]).collect()}
    assert len(got) == len(paths)
    for i in range(40):
        assert got[f"/a/b/c/d/e/f/bad/{i}"].verdict == "block" and got[f"/a/b/c/d/e/f/good/{i}"].verdict == "allow"
    assert got["/a/b"].template == "/~/b" and got[""].template == "/" and got["/" + "/".join("x" * 40)].template == "/" + "/".join("x" * 40)


def brute_templates(urls, rules):
    """The tree by plain loops over one dictionary of counts for each level."""

    def shape(x):
        stem, end = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z]{1,5})?", x).groups()
        for pattern, name in ((r"\d{4}-\d{1,2}(-\d{1,2})?", "<date>"), (r"\d+", "<number>"), (r"[0-9a-fA-F-]{8,}", "<hex>")):
            if re.fullmatch(pattern, stem):
                return name + (end or "")
        return ("<mixed>" if re.search(r"\d", stem) else stem) + (end or "")

    tree, own = {}, []
    for u in urls:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        key = (host, tuple(shape(x) for x in path.split("/") if x))
        n = tree.setdefault(key, [0, 0, 0])
        n[0] += 1
        n[1] += bool(fits)
        n[2] += bool(fits) and max(fits)[1] == "block"
        own.append((key, max(fits)[1] if fits else None))
    done, now, level = {}, {k: () for k in tree}, 0
    while now:
        level += 1
        places = {}
        for k, t in now.items():
            places.setdefault((k[0], t), []).append(k)
        step = {}
        for (host, t), keys in places.items():
            if len(keys) == 1:
                done[keys[0]] = t + keys[0][1][level - 1 :]
                continue
            branch = {}
            for k in keys:
                if len(k[1]) < level - 1:
                    done[k] = t
                    continue
                b = branch.setdefault(k[1][level - 1] if len(k[1]) >= level else "", [0, 0, 0, []])
                for i in range(3):
                    b[i] += tree[k][i]
                b[3].append(k)
            total = [sum(b[i] for b in branch.values()) for i in range(3)]
            named = [b for s, b in branch.items() if s]
            for seg, b in branch.items():
                literal = seg and not seg.startswith("<")
                name = seg
                share = total[2] / total[1] if total[1] else 0
                if literal and len(named) > url_tree.MANY and max(x[0] for x in named) < url_tree.LARGE * total[0]:
                    name = "*"
                elif literal and len(named) > 1 and b[1] and abs(b[2] / b[1] - share) <= url_tree.SIMILAR * (share * (1 - share) / b[1]) ** 0.5 + 1e-12:
                    name = "~"
                for k in b[3]:
                    step[k] = t + ((name,) if name else ())
        if not any(len(k[1]) >= level for k in step):
            done |= step
            break
        now = step
    leaf, hosts = {}, {}
    for k, t in done.items():
        for d, key in ((leaf, (k[0], t)), (hosts, k[0])):
            x = d.setdefault(key, [0, 0])
            x[0] += tree[k][1]
            x[1] += tree[k][2]
    known, bad = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    out = []
    for k, verdict in own:
        towards = (hosts[k[0]][1] + url_tree.WEIGHT * (bad + 1) / (known + 2)) / (hosts[k[0]][0] + url_tree.WEIGHT)
        x = leaf[k[0], done[k]]
        purity = (x[1] + url_tree.WEIGHT * towards) / (x[0] + url_tree.WEIGHT)
        out.append(("/" + "/".join(done[k]), verdict or ("block" if purity >= url_tree.REJECT else "allow"), round(purity, 9)))
    return out


def test_url_trees_equal_brute_force(spark, sf_dir):
    rng = random.Random(6)
    urls = [f"http://{rng.choice(['a.com', 'b.net', 'c.b.net', 'd.org'])}/" + "/".join(rng.choice(["en", "de", "es", "x1", "2020-01-02", "7", "shop", "p.html", rng.choice(VOCAB)]) for _ in range(rng.randint(0, 5))) for _ in range(800)]
    urls += [None, "", "none"] + [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.template, r.verdict, round(r.purity, 9)) for r in url_tree.url_verdicts(df).collect()}
    assert [got[i] for i in range(len(urls))] == brute_templates(urls, RULES)


def test_url_sql_on_many_and_similar_branches(spark, tmp_path):
    rng = random.Random(12)
    urls = [f"http://{rng.choice(['a.com', 'b.net', 'c.b.net', 'd.org'])}/" + "/".join(rng.choice(["en", "de", "es", "x1", "2020-01-02", "7", "shop", "p.html", "cafe-12345", rng.choice(VOCAB)]) for _ in range(rng.randint(0, 6))) for _ in range(900)]
    urls += [f"http://m.net/{w}/{i}" for i, w in enumerate(VOCAB[:40])] + [f"http://Deep.ORG/{'/'.join('x' * k)}" for k in (0, 1, 12, 12, 40)]
    urls += [f"http://t.com/{k}/{i}?q#f" for k in ("en", "de") for i in range(15)] + [None, "", "none", "http://", "x://h?a/b", "http://a.com/en/7/a//b.html"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.QUERIES["op8_url_verdicts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    result = con.execute(queries.ORACLE_SQL["op8_url_verdicts"])
    names = [x[0] for x in result.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, result.fetchall())


PAGE = "<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a>Menu</a></ul></nav><!-- c --><div class='ad'>Buy</div>{main}<aside>Side</aside><div class=\"comments\"><p>Nice</p></div><footer>&copy; x</footer></body></html>"


def test_html_main_text(spark):
    main = "<article><h1>A &amp; B</h1><p><b>Bold  text<br><p>Next\n line&nbsp;end</p><div class='share'>Share</div><form>f</form></article>"
    plain = "<div id='content'><p>{}</p><p>More words of it {}</p></div>"
    pages = [(1, "http://a.com/1", PAGE.format(main=main)), (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/4", "<article><p>cut off"), (5, "http://a.com/5", "just text")]
    pages += [(10 + i, f"http://b.com/{i}", PAGE.format(main=plain.format(prose(30), i))) for i in range(12)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(df).collect()}
    assert got[1] == "A & B\nBold text\nNext line end" and got[2] == got[3] == "" and got[4] == "cut off" and got[5] == "just text"
    for i in range(12):
        assert got[10 + i].endswith(f"More words of it {i}") and "Menu" not in got[10 + i] and "Nice" not in got[10 + i] and "Side" not in got[10 + i]
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def test_html_names_that_mark_no_side_matter():
    shapes = [
        "<body class='single no-sidebar'><article class='post comments-open'><p>{}</p></article></body>",
        "<body><main id='main' class='has-header search'><p>{}</p></main></body>",
        "<body><div class='has-header no-share'><p>{}</p></div></body>",
    ]
    for shape in shapes:
        texts = [prose(20) for _ in range(4)]
        side = "<div class='sidebar-left'>S</div><div id='site-header'>H</div>"
        pages = [shape.format(t).replace("</body>", side + "</body>") for t in texts]
        assert html_template.main_texts(pages) == texts and html_template.main_texts(pages[:1]) == texts[:1]


def test_html_slots_without_template_text():
    def page(n, k, notice):
        records = "".join(f"<li><b>Author:</b> {prose(2, rng)} <i>on</i> {prose(1, rng)}</li>" for _ in range(n))
        more = "<div class='hint'>Sign up today</div>" if notice else ""
        return PAGE.format(main=f"<article><h1>{k}</h1><p>{prose(30, rng)}</p>{more}<p>Read <a>more</a></p><ul>{records}</ul><p>All rights kept</p></article>")

    rng = random.Random(5)
    pages = [page(rng.randint(1, 6), k, k % 2) for k in range(20)]
    for k, text in enumerate(html_template.main_texts(pages)):
        assert text.split("\n")[0] == str(k) and len(text.split("\n")[1].split()) == 30
        assert not any(x in text for x in ("Author:", "Read", "more", "rights", "Sign up", " on "))
        assert len(text.split("\n")) == 2 + pages[k].count("Author:") and all(len(x.split()) == 3 for x in text.split("\n")[2:])
    for own in (pages[:1], pages[:1] * 5, [p.replace("<h1>", f"<h1><!-- {i} -->") for i, p in enumerate(pages[:1] * 5)]):
        assert all("Author:" in t and "Read more" in t for t in html_template.main_texts(own))


def test_html_classes_are_ordered_and_nested():
    shape = "<html><body><main><ul>{}</ul><ol>{}</ol></main></body></html>"
    pages = [html_template.Page(shape.format("<li><div>a</div><h3>T</h3></li>" * k, "<li>x</li>" * (k % 2))) for k in range(2, 8)]
    classes = html_template.valid_classes(pages)
    ul = "html/body/main/ul/li"
    assert classes[0] == ["html", "html/body", "html/body/main", "html/body/main/ul", "html/body/main/ol"]
    assert [ul, f"{ul}/div", f"{ul}/div  a", f"{ul}/h3", f"{ul}/h3  T"] in classes
    # one order on some pages, the other on the rest: not a class
    mixed = [html_template.Page(shape.format(("<li><b>a</b></li><dl>x</dl>" if k % 2 else "<dl>x</dl><li><b>a</b></li>") * 2, "")) for k in range(6)]
    assert not any(ul in c and "html/body/main/ul/dl" in c for c in html_template.valid_classes(mixed))


def test_html_scan_is_one_pass():
    """Broken markup of a million characters takes seconds; pieces are the page's characters, each once and in order."""
    import time

    bad = ["<a ", '<a"', "<a '\"", "<div>", "<b>x", "<li>x", "<!-- ", "<", "<script>", "</div>", '<div class="', "<a<b", "&amp"]
    for piece in bad:
        begin = time.process_time()
        html_template.main_texts([piece * (1_000_000 // len(piece))])
        assert time.process_time() - begin < 15, piece
    assert list(html_template.scan('<p class="a>b" x=\'<\'>t<i >u</i')) == [("open", "p", ' class="a>b" x=\'<\''), ("text", "t", ""), ("open", "i", " "), ("text", "u", ""), ("close", "i", "")]
    assert list(html_template.scan("a<b c<d>e")) == [("text", "a", ""), ("open", "b", " c<d"), ("text", "e", "")]
    assert html_template.main_texts(["<div class='search-results-story'>Real article text...</div><div>x</div>"]) == ["Real article text..."]
    page = "<body><header><h1>Site</h1></header><article><header><h1>Headline</h1></header><p>x <div class='modal-verbs'>y</div></article></body>"
    assert html_template.main_texts([page]) == ["Headline\nx\ny"]


def test_html_groups_ignore_partitions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame([(10_000 + i, f"http://big.com/{i}", PAGE.format(main=f"<article><p>{prose(20)}</p></article>")) for i in range(300)], "page_id long, url string, html string"))
    a, b = ({r.page_id: r.text for r in html_template.extract_main_text(pages.repartition(n)).collect()} for n in (1, 7))
    assert a == b and len(a) == pages.count()


def test_html_templates_equal_what_pages_were_made_of(spark):
    """Sites of random templates: the slots that were filled in come back, and nothing of the template."""
    rng = random.Random(14)
    for site in range(6):
        menu, note, foot = ("".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(VOCAB, 5)), prose(6, rng), prose(5, rng))
        wrap = rng.choice(["<article>{}</article>", "<main><div class='c'>{}</div></main>", "<div id='content'>{}</div>"])
        block = rng.choice(["<p>{}</p>", "<section><p>{}</p></section>", "<div class='t'>{}</div>"])
        pages, want = [], []
        for _ in range(12):
            slots = [prose(rng.randint(5, 40), rng) for _ in range(rng.randint(1, 5))]
            want.append("\n".join(slots))
            body = wrap.format("".join(block.format(x) for x in slots))
            pages.append(f"<html><body><nav><ul>{menu}</ul></nav><div class='notice'>{note}</div>{body}<footer>{foot}</footer></body></html>")
        assert html_template.main_texts(pages) == want, site


def _site(n, body, rng):
    """Pages whose names say nothing: unmarked boxes around a changing one."""
    box = "<html><body><div class=x1>Open hours and prices</div><div class=x2><p>{}</p></div><div class=x3>Made by us in one town</div></body></html>"
    return [box.format(body(i)) for i in range(n)]


def test_html_slots_where_no_names_help():
    rng = random.Random(3)
    texts = [prose(60, rng) for _ in range(12)]
    assert html_template.main_texts(_site(12, lambda i: texts[i], rng)) == texts


def test_html_sections_that_some_pages_share_stay():
    """Every third page has a section, word for word: it is no template."""
    rng = random.Random(4)
    texts = [prose(50, rng) for _ in range(30)]
    section = "</p><h2>Method</h2><p>All values were measured twice."
    pages = ["<html><body><article><h1>{}</h1><p>{}</p></article></body></html>".format(f"Title {i}", t + (section if i % 3 == 0 else "")) for i, t in enumerate(texts)]
    want = [f"Title {i}\n{t}" + ("\nMethod\nAll values were measured twice." if i % 3 == 0 else "") for i, t in enumerate(texts)]
    assert html_template.main_texts(pages) == want


def test_html_near_copies_keep_their_text():
    rng = random.Random(5)
    base = [prose(30, rng) for _ in range(5)]
    page = "<html><body><article><p>{}</p>" + "".join(f"<p>{p}</p>" for p in base) + "</article><div class=f>All rights kept</div></body></html>"
    firsts = [f"Edition {i}" for i in range(10)]
    assert html_template.main_texts([page.format(f) for f in firsts]) == ["\n".join([f, *base]) for f in firsts]
    others = [prose(80, rng) for _ in range(20)]
    mixed = [page.format(f) for f in firsts] + [f"<html><body><article><p>{t}</p></article><div class=f>All rights kept</div></body></html>" for t in others]
    assert html_template.main_texts(mixed) == ["\n".join([f, *base]) for f in firsts] + others


def test_html_skeleton():
    pages = [html_template.Page(PAGE.format(main=f"<main><h2>{i}</h2>" + "<section>x</section>" * i + "</main>")) for i in range(1, 5)]
    order = html_template.skeleton(pages)
    assert "html/body/main" in order and not any("section" in r for r in order)
    assert html_template.main_role(pages, order) == "html/body/main"


def test_chat_format_reads_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a &lt; <s>[user]&amp;"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "system", "s"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    turns = df.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    formatted = chat_format.chat_format(turns)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", rows[0][3]), ("assistant", rows[1][3])] and back[1].loss == rows[1][3]
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("assistant", "")] and back[2].loss == ""
    assert len(back[3].turns) == 2 and back[3].loss == "bb" and back[None].turns[0].role == "system"
    for r in formatted.collect():
        for span in r.loss_spans:
            if span:
                assert r.formatted[span.start : span.end] == html.unescape(r.formatted[span.start : span.end]).replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lsqb;").replace("]", "&rsqb;")
    assert chat_format.chat_format(turns.limit(0)).count() == 0
    # a mask that starts at a wrong place shows
    moved = F.transform("loss_spans", lambda s: F.when(s.isNotNull(), F.struct((s["start"] - 2).alias("start"), (s["end"] - 2).alias("end"))))
    wrong = {r.conv_id: r for r in chat_format.read_back(formatted.withColumn("loss_spans", moved)).collect()}
    assert wrong[3].loss == "tt" and wrong[1].loss != back[1].loss


def test_chat_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat_format.text_parts(F.lit("<a")).alias("parts"))
    r = chat_format.read_back(chat_format.chat_format(turns)).first()
    assert len(r.turns) == 20_000 and r.loss == "<a" * 10_000


def test_chat_attachments(spark):
    parts = [("text", "see ", None, None), ("image", None, "u1", 2), ("document", None, "d", None), ("other", "x", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.chat_format(df).first()
    assert r.formatted == "<s>[user]see <|image|><|document|>x</s><s>[assistant]</s>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "u1", 512), (0, "document", "d", 512)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])
