"""Audit tables, set operations and window extensions over events, documents, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import audit, rules, sampling
from citeloom.plans.registry import query, table
from citeloom.sources.io import row_counts
from citeloom.streaming import windows


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, CASE WHEN lang = 'de' THEN -n_chars ELSE 0 END, doc_id) AS r FROM documents) WHERE r = 1""")
def priority_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars")
    return audit.upsert(docs, "source", F.col("lang") == "de", F.col("n_chars"), "doc_id").select("source", "doc_id", "lang")


@query("""SELECT source, arg_max(doc_id, (n_chars * 1000000 - doc_id)) AS doc_id, arg_max(lang, (n_chars * 1000000 - doc_id)) AS lang, count(*) AS members, count(DISTINCT lang) > 1 AS label_conflict FROM documents GROUP BY 1""")
def canonical_member(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars")
    return audit.canonical_member(docs, "source", [F.col("n_chars"), -F.col("doc_id")], ["doc_id", "lang"], "lang")


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS k FROM events)
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS n FROM r) WHERE n = 1""")
def best_label(spark: SparkSession, d: str) -> DataFrame:
    out = audit.best_label(table(spark, d, "events", "event_id", "user_id", "event_type"), "user_id", "event_type", "event_type", {"purchase": 3, "click": 2, "view": 1}, "event_id")
    return out.select("user_id", "event_type", "event_id")


@query("""WITH p AS (SELECT user_id, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY 1), s AS (SELECT user_id, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(p.user_id, s.user_id) AS user_id, coalesce(p.total, s.total) AS total, concat_ws('|', CASE WHEN p.user_id IS NOT NULL THEN 'click' END, CASE WHEN s.user_id IS NOT NULL THEN 'purchase' END) AS routes,
  ((p.user_id IS NOT NULL)::INT + (s.user_id IS NOT NULL)::INT) AS n_routes FROM p FULL JOIN s ON p.user_id = s.user_id""")
def route_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type", "value")
    of = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return audit.merge_routes(of("click"), of("purchase"), ["user_id"], ("click", "purchase"))


@query("""SELECT user_id, min_by(event_type, event_id) AS first_edition, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS editions, count(DISTINCT event_type) AS n_editions FROM events GROUP BY 1""")
def edition_union(spark: SparkSession, d: str) -> DataFrame:
    return audit.edition_union(table(spark, d, "events", "user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_pool(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels", "doc_id", "quality").where("quality = 1")
    return table(spark, d, "documents", "doc_id", "lang").join(good, "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_worklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels)) AS in_union, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)) AS in_both,
(SELECT count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')) AS only_b""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    return audit.set_algebra(table(spark, d, "documents", "doc_id", "lang").where("lang = 'en'").select("doc_id"), table(spark, d, "labels", "doc_id"))


@query("""WITH a AS (SELECT CASE WHEN quality = 1 THEN 'good' END AS k, count(*) AS n FROM labels GROUP BY 1), b AS (SELECT CASE WHEN toxic = 0 THEN 'good' END AS k, count(*) AS m FROM labels GROUP BY 1)
SELECT coalesce(a.k, 'none') AS k, n, m FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels", "quality", "toxic")
    a = lab.groupBy(F.when(F.col("quality") == 1, "good").alias("k")).agg(F.count("*").alias("n"))
    b = lab.groupBy(F.when(F.col("toxic") == 0, "good").alias("k2")).agg(F.count("*").alias("m"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "left").select(F.coalesce("k", F.lit("none")).alias("k"), "n", "m")


_METRICS = {
    "n": "count(*)", "mean_value": "avg(value)", "median_value": "median(value)", "sum_value": "sum(value)", "users": "count(DISTINCT user_id)",
    "clicks": "count(*) FILTER (WHERE event_type = 'click')", "max_value": "max(value)", "sd_value": "stddev_pop(value)",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS metric, round(({e})::DOUBLE, 6) AS value FROM events" for n, e in _METRICS.items()))
def metric_long(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type", "value")
    return audit.metric_table(
        e,
        {
            "n": F.count("*"), "mean_value": F.avg("value"), "median_value": F.median("value"), "sum_value": F.sum("value"), "users": F.count_distinct("user_id"),
            "clicks": F.count_if(F.col("event_type") == "click"), "max_value": F.max("value"), "sd_value": F.stddev_pop("value"),
        },
    )


@query("""WITH x AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS n, round(avg(quality), 6) AS good, round(avg(1 - toxic), 6) AS clean,
count(*) >= 15 AND round(avg(quality), 6) >= 0.85 AND round(avg(1 - toxic), 6) >= 0.8 AS safe_for_scale FROM x GROUP BY 1""")
def stratum_scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "source"), "doc_id")
    return audit.scorecard(rows, "source", {"good": F.col("quality"), "clean": 1 - F.col("toxic")}, 15, {"good": 0.85, "clean": 0.8})


@query("""WITH x AS (SELECT l.doc_id, source, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id) SELECT doc_id, source, round(sum(quality) OVER w / count(*) OVER w, 6) AS running_rate FROM x WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def running_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "source"), "doc_id")
    return audit.running_rate(rows, "source", ["doc_id"], F.col("quality") == 1).select("doc_id", "source", "running_rate")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
h AS (SELECT doc_id, line_no, p.name AS pattern, len(regexp_extract_all(line, p.rx)) AS hits FROM l, (VALUES ('license', '[Ll]icense'), ('year', '\b(19|20)\d{2}\b'), ('stars', '\*{3}')) p(name, rx) WHERE regexp_matches(line, p.rx))
SELECT doc_id, pattern, sum(hits)::BIGINT AS hits, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS lines FROM h GROUP BY 1, 2""")
def pattern_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    return audit.pattern_scan(table(spark, d, "documents", "doc_id", "text"), {"license": "[Ll]icense", "year": r"\b(19|20)\d{2}\b", "stars": r"\*{3}"})


@query("""WITH b AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS n_full, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_audit FROM orders)
SELECT s AS scenario, round((n_full * f + n_audit * a) / 3600.0, 4)::DOUBLE AS hours FROM b, (VALUES ('fast', 60.0, 20.0), ('usual', 90.0, 30.0), ('slow', 120.0, 45.0)) v(s, f, a)""")
def effort_scenarios(spark: SparkSession, d: str) -> DataFrame:
    partial = F.col("o_orderstatus") == "P"
    base = table(spark, d, "orders", "o_orderstatus").agg(F.count_if(partial).alias("n_full"), F.count_if(~partial).alias("n_audit"))
    return audit.scenarios(base, [("fast", 60.0, 20.0), ("usual", 90.0, 30.0), ("slow", 120.0, 45.0)])


@query("""WITH e AS (SELECT * FROM (VALUES ('F', 5000.0), ('O', 5000.0), ('P', 5000.0), ('X', 0.0)) v(status, expected)), f AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT e.status, expected::DOUBLE AS expected, n::DOUBLE AS found, coalesce(abs(expected - n) < 1e-9, false) AS matches FROM e LEFT JOIN f ON e.status = f.status""")
def reconcile_expected(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return audit.reconcile_expected([("F", 5000.0), ("O", 5000.0), ("P", 5000.0), ("X", 0.0)], found, "status", "n")


@query("""SELECT count(*) FILTER (WHERE o_totalprice < 100000) AS small, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_totalprice < 250000) AS middle, count(*) FILTER (WHERE o_totalprice >= 250000) AS large, 0::BIGINT AS in_none, 0::BIGINT AS in_several, count(*) AS total FROM orders""")
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return audit.partition_check(table(spark, d, "orders", "o_totalprice"), {"small": p < 100000, "middle": (p >= 100000) & (p < 250000), "large": p >= 250000})


@query("""SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'agree' WHEN quality = 1 THEN 'toxic_only' WHEN toxic = 1 THEN 'both_bad' ELSE 'quality_only' END AS kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1""")
def disagreement_summary(spark: SparkSession, d: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    kind = rules.cascade([(good & ~toxic, "agree"), (good, "toxic_only"), (toxic, "both_bad")], "quality_only")
    lab = table(spark, d, "labels", "quality", "toxic")
    n = lab.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = lab.agg(F.count("*").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id), doc_id) AS r FROM documents), g AS (SELECT source, count(*) AS n FROM c WHERE r <= 20 GROUP BY 1)
SELECT d.source, count(*) AS pool_size, any_value(g.n) AS realized_n FROM documents d JOIN g ON d.source = g.source GROUP BY 1""")
def sampling_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source")
    return sampling.sampling_manifest(docs, sampling.stratified_sample(docs, ["source"], 20, "doc_id"), ["source"])


@query("""WITH p AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN 1 WHEN n_chars > 3000 THEN 2 WHEN doc_id % 2 = 0 THEN 3 END AS pass FROM documents)
SELECT source, doc_id, pass FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass, doc_id) AS r FROM p WHERE pass IS NOT NULL) WHERE r = 1""")
def selection_passes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars")
    return sampling.first_pass(docs, [F.col("lang") == "de", F.col("n_chars") > 3000, F.col("doc_id") % 2 == 0], "source", "doc_id").select("source", "doc_id", "pass")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "documents", "labels")))
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return row_counts({t: table(spark, d, t) for t in ("orders", "lineitem", "documents", "labels")})


@query("""SELECT coalesce(event_type, 'ALL') AS event_type, coalesce(day, 'ALL') AS day, n, total FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d')))""")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "ts", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), F.coalesce("day", F.lit("ALL")).alias("day"), "n", "total")


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(table(spark, d, "events", "event_type", "ts", "value"), "ts", "1 day", ["event_type"], "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(table(spark, d, "events", "user_id", "ts"), "ts", "6 hours", "user_id")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
