"""Payload table function, attempt states, ledgered appends, seeds, repairs and small operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.payloads import payload_schema, register_payload_items
from citeloom.operators import rules as R
from citeloom.operators import sampling, seeds
from citeloom.operators import triage as T
from citeloom.plans import record_queries
from citeloom.sources import io
from citeloom.streaming import attempts, ledger


def test_payload_items_take_any_schema(spark):
    register_payload_items(spark)
    rows = [(1, 1, '[{"a": 1, "b": "x"}, 7, {"b": 2, "c": [1, "2"]}]'), (1, 2, '{"a": "no", "d": {"e": true}}'), (1, 3, None), (1, 4, "{broken"), (2, 1, "[]"), (None, 1, '{"a": 9000000000}')]
    df = spark.createDataFrame(rows, "g int, at int, payload string")
    schema = "a int, b string, c array<int>, d struct<e:boolean>"
    out = spark.sql("SELECT * FROM payload_items(TABLE({t}) PARTITION BY (g) ORDER BY (at), 'payload', {kind})", t=df, kind=payload_schema(schema)).collect()
    got = sorted((str(r.g), r.at, r.item_index, r.a, r.b, r.c, None if r.d is None else r.d.e) for r in out)
    assert got == [("1", 1, 0, 1, "x", None, None), ("1", 1, 2, None, "2", [1, None], None), ("1", 2, 3, None, None, None, True), ("None", 1, 0, None, None, None, None)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM payload_items(TABLE({t}) PARTITION BY (g), 'other', {kind})", t=df, kind=payload_schema("a int")).collect()


def test_attempts_end_alike_in_batch_and_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = record_queries.reply_log(events)
    want = {r.context: (r.status, r.replies) for r in attempts.final_statuses(log).collect()}
    # three files in the order of the replies, read one at a time
    for k in range(3):
        low, high = [log.agg(F.expr(f"percentile(seq, {q / 3})")).first()[0] for q in (k, k + 1)]
        part = log.where((F.col("seq") > low if k else F.lit(True)) & (F.col("seq") <= high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    seen = {}

    def keep(batch, _):
        seen.update({r.context: (r.status, r.replies) for r in batch.collect()})

    attempts.stream_statuses(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == want and len({s for s, _ in want.values()}) >= 4


def test_steps_are_one_machine(spark):
    rng = random.Random(1)
    rows = [(c, i, c % 6 == 0, rng.choice(["valid", "invalid", "error"])) for c in range(200) for i in range(rng.randint(1, 6))]
    want = {}
    for c, _, router, kind in rows:
        want[c] = attempts.after_reply(*want.get(c, (attempts.PENDING, 0, False)), kind, router)
    got = {r.context: r.status for r in attempts.final_statuses(spark.createDataFrame(rows, "context long, seq int, by_router boolean, kind string")).collect()}
    assert got == {c: s[0] for c, s in want.items()}
    assert set(got.values()) == {"router_valid", "rejected_router_validation", "api_error", "initial_valid", "repaired_valid", "rejected_after_repair", "pending"}


def test_a_batch_that_failed_before_its_entry_counts_once(spark, tmp_path):
    src, path, mark = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/mark"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    assert ledger.committed(spark, path, "id long").count() == 0

    def fail(number):
        if number == 1:
            raise RuntimeError("lost between data and ledger")

    with pytest.raises(Exception, match="lost between"):
        ledger.append_once(stream, path, mark, fail).awaitTermination()
    assert ledger.committed(spark, path, "id long").count() == 10  # batch 1 is written, but doesn't count
    ledger.append_once(stream, path, mark).awaitTermination()
    ledger.append_once(stream, path, mark).awaitTermination()
    assert sorted(r.id for r in ledger.committed(spark, path, "id long").collect()) == list(range(30))


def test_editions_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["limits", "to", "growth", "the", "new", "Worlds", "of", "world"]
    works = [(i, rng.choice([None, f"10.1/{i % 9}"]), " ".join(rng.choice(words) for _ in range(5)) if i % 11 else None, rng.choice([["Ann Lee"], ["bo Kay", "ANN lee"], None]), rng.choice([None, 1890, 1972, 1990, 2024, 2030]), rng.choice([None, 0, 5, 9])) for i in range(400)]
    known = [("a", None, "Limits to growth", "ann Lee", 1970, 1975), ("b", "10.1/3", "x y", "nobody", 1970, 1975), ("c", "10.9/9", "World", "Kay", 1900, 2000), ("d", None, "missing words", "ann", 1900, 2030)]
    w = spark.createDataFrame(works, "id long, doi string, title string, authors array<string>, year int, cited int")
    s = spark.createDataFrame(known, "seed_id string, doi string, title string, author string, year_from int, year_to int")
    got = {r.seed_id: (r.id, r.method) for r in seeds.resolve_seeds(w, s).collect()}
    editions = {}
    for r in seeds.other_editions(w, s, seeds.resolve_seeds(w, s)).collect():
        editions.setdefault(r.seed_id, []).append((r["rank"], r.id))
    for seed, doi, title, author, low, high in known:
        fit = [x for x in works if x[2] and all(p in x[2].lower() for p in title.lower().split() if len(p) > 2) and author.lower() in " ".join(x[3] or []).lower()]
        by_doi = [x[0] for x in works if doi and x[1] and x[1].lower() == doi]
        best = sorted((-(x[5] or 0), x[0]) for x in fit if x[4] is not None and low <= x[4] <= high)
        want = (min(by_doi), "doi_lookup") if by_doi else (best[0][1], "title_search_then_get") if best else None
        assert got.get(seed) == want
        more = sorted((-(x[5] or 0), x[0]) for x in fit if x[4] is not None and max(1900, low - 5) <= x[4] <= 2025 and x[0] != (want or (None,))[0])[:15]
        assert [i for _, i in sorted(editions.get(seed, []))] == [i for _, i in more]
    with pytest.raises(ValueError, match="too many"):
        seeds.title_candidates(w, spark.range(seeds.SEEDS + 1).select(F.col("id").cast("string").alias("seed_id"), F.lit("t").alias("title"), F.lit("a").alias("author")))


def test_repairs_keep_the_text_and_tell_the_effect(spark):
    rows = [
        (1, "It grew ~5 % by Lee et al. in 1972. The limits were seen, e.g. here. After that, more.", None, None, None, False),
        (2, "  ", None, None, None, True),
        (3, None, "Own sentence.", "Before.", None, False),
        (4, "short", "Given limits.", "B.", "A.", True),
        (5, "short", "Given limits.", "B.", "A.", False),
    ]
    df = spark.createDataFrame(rows, "k int, w string, c string, b string, a string, g boolean")
    got = {r.k: r for r in T.repair_context(df, "w", "c", "b", "a", "limits", F.lit(False), F.col("g")).collect()}
    assert got[1].repaired_before == "It grew ~5 % by Lee et al. in 1972." and got[1].repaired_citing == "The limits were seen, e.g. here." and got[1].repaired_after == "After that, more."
    assert (got[1].recoverability, got[1].recovery_method, got[1].quality_before, got[1].quality_after, got[1].expected_effect) == ("recovered", "sentence split from available raw context", "low_short_context", "high", "likely_improves")
    assert got[2].recoverability == "source_missing" and got[2].expected_effect == "unknown" and got[2].recovery_method == "no source context available"
    assert got[3].original_text == "Before. Own sentence." and got[3].recoverability == "recovered"
    assert got[4].expected_effect == "likely_improves" and got[5].expected_effect == "no_change" and got[5].quality_before == "high"
    noisy = T.repair_context(df, "w", "c", "b", "a", "limits", F.lit(True)).where("k = 1").first()
    assert noisy.quality_before == noisy.quality_after == "low_ocr_risk" and noisy.expected_effect == "no_change"


def test_small_operators(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", " "), (2, "a", None), (3, "z", "")], "k int, c string, sheet string")
    assert [r.c for r in T.ordered_by(rows, "c", ["b", "a"], "k").collect()] == ["b", "a", "z"]
    assert T.blank_sheet(rows, ["sheet"]) and not T.blank_sheet(rows, ["sheet", "c"])
    filled = sampling.fill_up(rows.select("k"), rows.where("k = 2").select("k"), "k", 3)
    assert sorted(r.k for r in filled.collect()) == [1, 2, 3] and sampling.fill_up(rows, rows.limit(2), "k", 1).count() == 2
    assert io.place_columns(rows, {"n": F.lit(1), "m": F.lit(2)}, "k").columns == ["k", "n", "m", "c", "sheet"]
    for name, text in (("a.html", "<html><p>x  y</p></html>"), ("b.csv", "p,q"), ("c.py", "z"), ("d.pdf", "%PDF-1.4"), ("e.md", "m")):
        (tmp_path / name).write_text(text)
    blobs = io.read_blobs(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in io.blob_text(blobs).collect()}
    assert found["a.html"].text == "x y" and found["b.csv"].text == "p,q" and found["d.pdf"].text is None and found["d.pdf"].format == "pdf"
    roles = {r.name: (r.role, r.recommendation) for r in io.inventory(blobs).collect()}
    assert roles == {"a.html": ("source_document", "keep"), "b.csv": ("data", "keep"), "c.py": ("script", "keep"), "d.pdf": ("source_document", "keep"), "e.md": ("documentation", "keep")}
    s = spark.createDataFrame([("One here. The Match is it! Three.", "match"), ("A. B. C.", "none"), (" ", "x")], "s string, m string")
    assert [r[0] for r in s.select(X.sentence_containing(F.col("s"), F.col("m"))).collect()] == ["The Match is it!", "B.", None]


def test_context_quality_flags(spark):
    cues = R.SeedCues(author=r"\bmeadow\b", title=r"\bgreen fields\b", year=r"\b1972\b", group=r"\bclub\b")
    rows = [
        (1, 0.2, False, "Meadow argued in 1972 that fields matter for all of us, as many have said since then in long texts.", "", "author_year", True),
        (2, 0.9, True, "[12] Meadow, Green Fields, 1972, 1973.", "Green Fields", "author_year", True),
        (3, 0.2, False, "They said that green fields are fine and nothing else was said about it by anyone at that time or later on.", "", "title_phrase_unattributed", False),
    ]
    df = spark.createDataFrame(rows, "k int, f double, h boolean, s string, n string, kind string, c boolean")
    out = df.select("k", *[v.alias(n) for n, v in R.context_quality(F.col("f"), F.col("h"), F.col("s"), F.col("s"), F.col("n"), F.col("kind"), F.col("c"), cues).items()])
    got = {r.k: r for r in out.collect()}
    assert got[1].quality_flags == "" and got[1].annotation_eligible
    assert "likely_bibliography_only" in got[2].quality_flags and not got[2].annotation_eligible
    assert got[3].quality_flags.split("|") == ["seed_attribution_ambiguous", "citing_sentence_missing_seed_attribution"] and json.dumps(got[3].annotation_eligible) == "false"
