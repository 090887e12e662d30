import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import normalize as N
from citeloom.functions import text as X
from citeloom.functions.similarity import jaro_similarity
from citeloom.operators import audit, linkage, rules, sampling, stats
from citeloom.plans.scratch import Tables
from citeloom.sources import io
from citeloom.streaming import windows


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_normalisers(spark):
    x = F.col("x")
    assert one(spark, "https://doi.org/10.1000/ABC", N.normalize_doi(x), N.safe_doi_id(x))[:] == ("10.1000/abc", "10_1000_abc")
    assert one(spark, "doi: 10.1000/ABC", N.normalize_doi(x))[0] == "10.1000/abc"
    assert one(spark, "  ", N.normalize_doi(x), N.normalize_title(x), N.venue_key(x))[:] == (None, None, None)
    assert one(spark, "The Growth-of & Things!", N.normalize_title(x))[0] == "the growth of and things"
    assert one(spark, "10_1000_abc_d", N.doi_from_safe_id(x))[0] == "10.1000/abc.d"
    assert one(spark, "Smith, Ann; Doe, Bob", N.first_author_name(x), N.first_author_surname(x))[:] == ("Smith, Ann", "smith")
    assert one(spark, "Ann Lee-Smith | B", N.first_author_surname(x))[0] == "leesmith"
    assert one(spark, "A 1999; B 2000", X.split_references(x))[0] == ["A 1999", "B 2000"]
    assert one(spark, "see https://openalex.org/W123", N.openalex_id(x))[0] == "W123"
    assert one(spark, "ocr-\n text  is‚Ä¶ fine", N.repair_text(x))[0] == "ocrtext is... fine"
    assert one(spark, "1999.0", N.lenient_int(x), N.decade_of(N.lenient_int(x)))[:] == (1999, "1990s")
    assert one(spark, "soon", N.lenient_int(x))[0] is None
    assert one(spark, "a|none||b|a", N.split_flags(x))[0] == ["a", "b"]
    assert one(spark, "a0|none|| 2b1 |a0|4", N.split_flags(x))[0] == ["a0", "2b1", "4"]
    assert one(spark, "0 A 1990; 1 B 2001; C 2", X.split_references(x))[0] == ["0 A 1990", "1 B 2001", "C 2"]
    assert one(spark, "1590", N.display_count(x.cast("int")), N.display_share(F.lit(0.5364)), N.display_interval(F.lit(0.58), F.lit(0.919)))[:] == ("1,590", "53.6%", "[0.58, 0.92]")


def test_harmonize_is_tolerant_of_columns(spark):
    df = spark.createDataFrame([("10.1/A", "T one", "Doe, J", "1999"), (None, None, None, None)], "di string, ti string, au string, py string")
    a, b = N.harmonize(df, F.lit("savedrecs.csv"), F.monotonically_increasing_id() + 1).orderBy(F.desc("doi")).collect()
    assert (a.work_key, a.database, a.year) == ("doi:10.1/a", "web_of_science_or_clarivate", 1999)
    assert b.work_key.startswith("row:") and b.title is None


@pytest.mark.parametrize(
    "text,at,before,citing,after",
    [
        ("One is here. Two cites it. Three ends.", 15, "One is here.", "Two cites it.", "Three ends."),
        ("Only this cites.", 3, "", "Only this cites.", ""),
        ("As Smith et al. Show this. Next one. Last.", 20, "", "As Smith et al. Show this.", "Next one."),
        ("Katso Smith ym. Tutkimus on. Next one.", 20, "", "Katso Smith ym. Tutkimus on.", "Next one."),
        ("", 0, "", "", ""),
    ],
)
def test_three_sentence_window(spark, text, at, before, citing, after):
    df = spark.createDataFrame([(text,)], "t string")
    w = X.window_at(df, "t", F.lit(at), F.lit(at + 2)).first()
    assert (w.sentence_before, w.citing_sentence, w.sentence_after) == (before, citing, after)
    assert w.context_window_complete == bool(before and citing and after)


def brute_sentences(text):
    """Character by character: a mark, up to two closing quotes, white space, then a plausible start; no abbreviation before the mark."""
    short = {"al", "etal", "ym", "fig", "eq", "e.g", "i.e", "no", "pp", "vol", "vs", "cf", "dr", "mr", "mrs", "ms", "prof", "inc", "jr", "sr", "st"}
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?":
            j = i + 1
            while j < min(i + 3, len(text)) and text[j] in "\"'\u201d\u2019)]":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            opening = k
            while opening < len(text) and text[opening] in "\"'\u201c\u2018([":
                opening += 1
            word = text[start:i].split()[-1].lstrip("([\"'").lower() if text[start:i].split() else ""
            last = word.rsplit(".", 1)[-1] if word not in short else word
            plausible = opening < len(text) and opening - k <= 7 and (text[opening] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
            is_short = text[i] == "." and (word in short or last in short or (len(last) == 1 and last.isascii() and last.isalpha()))
            if k > j and plausible and not is_short:
                out.append((start, i + 1))
                start = i = k
                continue
        i += 1
    out.append((start, len(text)))
    return [(a, b, " ".join(text[a:b].split())) for a, b in out if text[a:b].strip()]


def test_sentences_equal_brute_force(spark, sf_dir):
    texts = ['He said "Go." Then left. E.g. This one. See J. R. Doe et al. Here. (Yes.) No? "Why!" 3 more.', "A b. c D.\n\n  E", "x" * 30, "  ", "Ends. ", "One!? Two"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [(-1 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.select("doc_id", X.sentence_spans(F.col("text")).alias("s"), X.sentences(F.col("text")).alias("t")).collect()
    got = {r.doc_id: [(x.start, x.end, x.text) for x in r.s] for r in rows}
    assert got == {i: brute_sentences(t) for i, t in docs}
    assert all([x.text for x in r.s] == r.t for r in rows)
    long = {r.doc_id: [w for _, _, w in brute_sentences(dict(docs)[r.doc_id])] for r in rows}
    hit = lambda s: F.contains(F.lower(s), F.lit("the"))
    want = sorted((i, k, s[k - 1] if k else "", x, s[k + 1] if k + 1 < len(s) else "") for i, s in long.items() for k, x in enumerate(s) if "the" in x.lower())
    assert want == sorted((r.doc_id, r.pos, r.sentence_before, r.citing_sentence, r.sentence_after) for r in X.sentence_windows(df, hit).collect())


def test_page_windows_and_hits(spark):
    from citeloom.operators import contexts

    text = "First one here. As Doe et al. (1972) say so. The last one."
    df = spark.createDataFrame([(text, text.index("Doe") + 1, text.index("Doe") + 3)], "t string, a int, b int")
    w = X.page_sentence_windows(df, "t", "a", "b").first()
    assert (w.sentence_before, w.citation_sentence, w.sentence_after) == ("First one here.", "As Doe et al. (1972) say so.", "The last one.")
    cues = rules.SeedCues(author=r"\bdoe\b", title=r"\bgreat book\b", year=r"\b1972\b", group="club")
    entry = "References. Doe J 1972, Vol. 3, pp. 4, A, B, C doi 10.1000/x great book. 1999 1998"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text), (1, 3, "nothing"), (2, 1, None), (2, 2, entry.replace("Doe J 1972", "X"))], "doc_id long, page int, text string")
    rows = contexts.page_hits(pages, r"\bdoe\b|great\s+book", cues).collect()
    assert [(r.doc_id, r.page, r.match, r.semantic_label) for r in rows] == [(1, 1, "Doe", "SEED_WORK")]
    s = X.snippet_window(spark.createDataFrame([("  One  is. Two. ",), (None,)], "x string"), "x").collect()
    assert [(r.context_text, r.context_sentence_count, r.context_window_complete) for r in s] == [("One is. Two.", 2, False), ("", 0, False)]


def test_early_duplicates_equal_the_greedy_loop(spark):
    rng = random.Random(5)
    base = ["the growth of cities and towns", "limits of small things", "a theory of everything else", "on rivers"]
    rows = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        rows.append((i, None if i % 9 else f"10.1/{i % 2}", "".join(t) if i % 11 else None, rng.choice([None, 1999, 2000, 2000]), f"key{i}"))
    df = spark.createDataFrame(rows, "id int, doi string, title string, year int, work_key string")
    got = {r.id: r for r in linkage.early_duplicates(df, "doi", "title", "year", "work_key", Tables(spark, "e"), "id").collect()}
    order = sorted({(y is None, y or 0, t) for _, d, t, y, _ in rows if d is None and t})
    leader = {}
    for i, a in enumerate(order):
        if a not in leader:
            for b in order[i:]:
                if b not in leader and (a[0] or b[0] or a[1] == b[1]) and jaro_similarity(a[2], b[2]) >= 0.92:
                    leader[b] = a
    for i, d, t, y, key in rows:
        if d or not t:
            assert got[i].duplicate_group == (f"doi:{d}" if d else key)
    some = [r for r in rows if r[1] is None and r[2]]
    for x in some:
        for y in some:
            same = leader[(x[3] is None, x[3] or 0, x[2])] == leader[(y[3] is None, y[3] or 0, y[2])]
            assert same == (got[x[0]].duplicate_group == got[y[0]].duplicate_group)
    firsts = {}
    assert all(r.is_duplicate == (firsts.setdefault(r.duplicate_group, i) != i) for i, r in sorted(got.items()))


def test_a_long_chain_of_works_keeps_all_rows(spark):
    nodes = spark.range(200).select(F.col("id"))
    pairs = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.leader for r in linkage.leader_clusters(nodes, pairs, Tables(spark, "chain")).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


def test_seed_matches(spark):
    seed = X.Seed(author=r"\bDoe\b", title=r"Great\s+Book", year=r"\b1972\b")
    text = "Intro here. As Doe et al. (1972) say. The Great Book is cited. " + "X " * 300 + "end. A Great Book again."
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")
    rows = X.seed_matches(df, seed).orderBy("start").collect()
    assert [r.match_kind for r in rows] == ["author_year_combo", "title_phrase_attributed", "title_phrase_unattributed"]


def test_jaro_known_values():
    assert jaro_similarity("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert jaro_similarity("dixon", "dicksonx") == pytest.approx(0.766667, abs=1e-6)
    assert jaro_similarity("", "") == 0 and jaro_similarity(None, "a") is None


def test_wilson():
    for k, n, low, high in ((16, 20, 0.58398, 0.91934), (15, 28, 0.358, 0.705), (0, 11, 0, 0.2588), (11, 11, 0.7412, 1)):
        _, a, b = stats.wilson_value(k, n)
        assert (a, b) == (pytest.approx(low, abs=5e-4), pytest.approx(high, abs=5e-4))
    for bad in ((5, 0, 0.95), (-1, 10, 0.95), (11, 10, 0.95), (1, 2, 0), (1, 2, 1)):
        with pytest.raises(ValueError):
            stats.wilson_value(*bad)


# The published reliability example of four observers, twelve units.
EXAMPLE = [
    [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
    [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
    [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
    [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
]


@pytest.mark.parametrize("metric,alpha", [("nominal", 0.7434), ("ordinal", 0.8154), ("interval", 0.8491), ("ratio", 0.7974)])
def test_krippendorff(spark, metric, alpha):
    rows = [(u, c, v) for c, row in enumerate(EXAMPLE) for u, v in enumerate(row)]
    out = stats.krippendorff(spark.createDataFrame(rows, "unit int, coder int, value int"), metric).first()
    assert out.alpha == pytest.approx(alpha, abs=5e-4)


def test_bootstrap_alpha(spark, sf_dir):
    from citeloom.plans import registry

    # 40 units, a tenth of them disagree: 0.8 within its interval; a thousand draws by default and in the query
    rows = [(u, c, (u % 2) ^ (c == 1 and u % 10 == 0)) for u in range(40) for c in range(2)]
    ratings = spark.createDataFrame(rows, "unit int, coder int, value int")
    out = stats.bootstrap_alpha(ratings).first()
    assert out.resamples == 1000 and 0.45 < out.low < 0.72 and 0.9 < out.high <= 1.0
    assert registry.QUERIES["kripp_bootstrap"](spark, sf_dir).first().resamples == 1000


def test_krippendorff_perfect_and_constant(spark):
    same = spark.createDataFrame([(u, c, u % 2) for u in range(6) for c in "ab"], "unit int, coder string, value int")
    assert stats.krippendorff(same).first().alpha == 1.0
    flat = same.withColumn("value", F.lit(1))
    assert stats.krippendorff(flat).first().alpha is None


def test_logistic_recovers_a_separated_effect(spark):
    rng = random.Random(3)
    rows = [(x, int(rng.random() < (0.8 if x else 0.3))) for x in [0, 1] * 800]
    out = stats.logistic(spark.createDataFrame(rows, "x int, y int"), F.col("y"), {"x": F.col("x")})
    assert out[1]["beta"] == pytest.approx(2.2, abs=0.35) and out[1]["low"] > 1


def greedy(nodes, pairs):
    leader, linked = {}, {}
    for a, b in pairs:
        linked.setdefault(a, set()).add(b)
    for i in sorted(nodes):
        if i not in leader:
            leader[i] = i
            for j in sorted(linked.get(i, ())):
                if j > i:
                    leader.setdefault(j, i)
    return leader


def test_leader_clusters_equal_the_greedy_loop(spark):
    rng = random.Random(7)
    nodes = list(range(60))
    pairs = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(90)})
    got = linkage.leader_clusters(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(pairs, "a long, b long"), Tables(spark, "t"))
    assert {r.id: r.leader for r in got.collect()} == greedy(nodes, pairs)


def test_ambiguous_pairs_are_of_leaders_and_rows_not_taken_earlier(spark):
    rng = random.Random(12)
    nodes = list(range(40))
    scored = [(*sorted(rng.sample(nodes, 2)), rng.choice([0.87, 0.9, 0.93, 0.99])) for _ in range(120)]
    scored = sorted({(a, b): s for a, b, s in scored}.items())
    merge = [ab for ab, s in scored if s >= 0.92]
    lead = greedy(nodes, merge)
    want = sorted((a, b) for (a, b), s in scored if 0.86 <= s < 0.92 and lead[a] == a and lead[b] >= a)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in scored], "a long, b long, score double")
    clusters = spark.createDataFrame(list(lead.items()), "id long, leader long")
    assert sorted((r.a, r.b) for r in linkage.ambiguous_pairs(df, clusters).collect()) == want


def test_quota_level(spark):
    pools = spark.createDataFrame([("s", "a", 2), ("s", "b", 50), ("s", "c", 7), ("s", "d", 50), ("t", "a", 1), ("t", "b", 1)], "by string, stratum string, size long")
    out = {(r["by"], r.stratum): r.target for r in sampling.allocate_quotas(pools, "by", "stratum", "size", 30).collect()}
    assert out == {("s", "a"): 2, ("s", "c"): 7, ("s", "b"): 11, ("s", "d"): 10, ("t", "a"): 1, ("t", "b"): 1}


def test_sampling_ignores_partitioning(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    a, b = (sampling.stratified_sample(df.repartition(n), ["g"], 5, "id") for n in (1, 7))
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_latest_prefers_missing_times(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", None, 5), ("j", 3, 1)], "k string, t int, v int")
    assert {r.k: r.v for r in audit.latest(df, ["k"], "t", "v").collect()} == {"k": 5, "j": 1}


def test_routing_precedence(spark):
    rows = [("", "", ""), ("The simulation model shows much and more of what was known before in this field of work", "b", "a"), ("A policy is needed.", "b", "a"), ("This was (published.", "", "")]
    df = spark.createDataFrame(rows, "s string, b string, a string")
    out = [r.decision for r in rules.route(df, rules.Lexicons(), "s", "b", "a").select("route.*").collect()]
    assert out == ["deterministic_unclear", "deterministic_modeling", "llm_gray_zone", "deterministic_unclear"]


def test_validator_accepts_and_rejects(spark):
    good = {
        "context_id": "c", "context_group_id": "g", "citation_function": "critique", "topic": "unclear", "stance": "critical", "quote_function": "is wrong",
        "quote_topic": rules.ABSTAIN, "quote_stance": "is wrong", "confidence_function": 0.9, "confidence_topic": 0.5, "confidence_stance": 0.5,
        "needs_human_review": False, "reasoning_summary": "short",
    }

    def errors(flags=("none",), **change):
        lits = {k: F.lit(v) for k, v in (good | change).items()} | {"flags": F.array(*[F.lit(f) for f in flags])}
        code = rules.validate_result(lits, F.lit("it is wrong here"), F.lit("c"), F.lit("g"), F.lit(False), ("unclear",), ("none", "ocr_noise"))
        return spark.range(1).select(code.alias("e")).first().e

    assert errors() == []
    assert errors(citation_function="other") == ["invalid_category"]
    assert errors(confidence_topic=1.5) == ["invalid_confidence"]
    assert errors(context_id="x") == ["identifier_mismatch"]
    assert errors(quote_function="not there") == ["non_exact_evidence"]
    assert errors(flags=("ocr_noise",)) == ["review_policy_failure"]
    assert errors(stance="supportive") == ["stance_evidence_failure"]
    assert errors(flags=("none", "ocr_noise"), needs_human_review=True) == ["invalid_uncertainty_flags"]


def test_withheld_columns_raise(spark):
    df = spark.range(1).withColumn("label", F.lit(1))
    with pytest.raises(ValueError):
        rules.allowed_payload(df, ["id", "label"], ("label",))
    with pytest.raises(ValueError):
        rules.allowed_payload(df, ["id", "Human_role"])
    assert rules.withheld_columns(["id", "v1_role", "manual_note", "text"]) == ["manual_note", "v1_role"]
    assert rules.allowed_payload(df, ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        rules.require_columns(df, ["other"], "id")


def test_sources(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("﻿DI,Article Title\n10.1/x,One\n", encoding="utf-8")
    b.write_text("DI,Year\n10.1/y,2000\n")
    both = io.union_exports([io.read_export(spark, str(p)) for p in (a, b)])
    rows = {r.di: r for r in both.collect()}
    assert rows["10.1/x"].article_title == "One" and rows["10.1/x"].year is None and rows["10.1/y"].source_file == "b.csv"
    with pytest.raises(ValueError):
        io.read_export(spark, "x.xls")
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("# note\n# more\nitem_id,function\nF1,Uses\nF2,Extends\n")
    got = io.read_after_preamble(spark, str(sheet), "item_id,", "item_id string, function string")
    assert [tuple(r) for r in got.orderBy("item_id").collect()] == [("F1", "Uses"), ("F2", "Extends")]
    blobs = io.read_blobs(spark, str(tmp_path))
    assert blobs.count() == 3 and io.verify_manifest(io.manifest(blobs), io.manifest(blobs)).count() == 0
    io.write_csv(got, str(tmp_path / "out"))
    with pytest.raises(Exception):  # noqa: B017  a named run isn't overwritten
        io.write_csv(got, str(tmp_path / "out"))
    big = tmp_path / "big"
    big.mkdir()
    (big / "x.bin").write_bytes(b"a" * (9 << 20))
    frozen = io.manifest(io.read_blobs(spark, str(big))).collect()
    frozen = spark.createDataFrame([tuple(r) for r in frozen], "path string, length long, sha256 string")
    assert len(io.read_blobs(spark, str(big)).first().content) == 8 << 20
    (big / "x.bin").write_bytes(b"a" * ((9 << 20) - 1) + b"b")  # a change beyond what a fetch keeps
    assert [r.status for r in io.verify_manifest(io.manifest(io.read_blobs(spark, str(big))), frozen).collect()] == ["changed"]
    io.write_union_csv([got, got.select("item_id", F.lit("n").alias("note"))], str(tmp_path / "union"))
    assert spark.read.csv(str(tmp_path / "union"), header=True).columns == ["item_id", "function", "note"]
    listed = tmp_path / "l.yml"
    listed.write_text("a:\n  - x\n  - y\nb:\n- z\nc: 1\n")
    assert io.read_config(str(listed)) == {"a.1": "x", "a.2": "y", "b.1": "z", "c": "1"}
    conf = tmp_path / "c.yml"
    conf.write_text("a:\n  b: 1\n  c:\n    d: x\ne: 2\n")
    assert io.read_config(str(conf)) == {"a.b": "1", "a.c.d": "x", "e": "2"} == io.flatten_config({"a": {"b": 1, "c": {"d": "x"}}, "e": 2})


def test_stream_matches_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(folder)
    stream = windows.read_events(spark, folder, events.schema)
    log = windows.append_log(windows.without_repeats(stream, ["event_id"], "ts", "30 days"), out, str(tmp_path / "check"), "parquet")
    log.awaitTermination()
    got = windows.tumbling(spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "1 day", ["event_type"], "value")
    want = windows.tumbling(events, "ts", "1 day", ["event_type"], "value")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_html_options(spark):
    html = "<p>A &amp; B</p><script>x</script>"
    assert one(spark, html, X.html_to_text(F.col("x")))[0] == "A &amp; B x"
    assert one(spark, html, X.html_to_text(F.col("x"), decode=True, drop_scripts=True))[0] == "A & B"
