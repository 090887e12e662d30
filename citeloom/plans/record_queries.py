"""Lookups, matching, attempts, payloads, seeds and orders: queries over events, parts, labels, lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import normalize as N
from citeloom.functions import text as X
from citeloom.functions.payloads import payload_schema, register_payload_items
from citeloom.operators import audit, linkage, sampling, seeds, stats
from citeloom.operators import rules as R
from citeloom.operators import triage as T
from citeloom.plans.context_queries import CUES
from citeloom.plans.corpus_queries import _LEADERS, _SCORED, _WORK, _titles
from citeloom.plans.registry import query, table
from citeloom.plans.scratch import Tables
from citeloom.plans.text_queries import LEX
from citeloom.sources import io
from citeloom.streaming import attempts, windows

_SIX = "l_returnflag, l_linestatus, nullif(l_linenumber, 7) AS line, l_suppkey % 3 AS s, year(l_shipdate)::INTEGER AS y, nullif(l_quantity > 25, false) AS large"


@query(f"""WITH x AS (SELECT {_SIX}, l_discount FROM lineitem), a AS (SELECT l_returnflag, l_linestatus, line, s, y, large, count(*) AS n FROM x GROUP BY ALL),
b AS (SELECT l_returnflag, l_linestatus, line, s, y, large, count(*) AS discounted FROM x WHERE l_discount > 0.09 GROUP BY ALL)
SELECT a.l_returnflag, a.l_linestatus, coalesce(a.line, -1) AS line, a.s, a.y, coalesce(a.large, false) AS large, n, coalesce(discounted, 0) AS discounted FROM a LEFT JOIN b ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag
  AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus AND a.line IS NOT DISTINCT FROM b.line AND a.s IS NOT DISTINCT FROM b.s AND a.y IS NOT DISTINCT FROM b.y AND a.large IS NOT DISTINCT FROM b.large""")
def six_key_join(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    keys = ["l_returnflag", "l_linestatus", "line", "s", "y", "large"]
    x = x.select(
        "l_returnflag", "l_linestatus", F.nullif("l_linenumber", F.lit(7)).alias("line"), (F.col("l_suppkey") % 3).alias("s"), F.year("l_shipdate").alias("y"),
        F.when(F.col("l_quantity") > 25, True).alias("large"), "l_discount",
    )
    right = x.where("l_discount > 0.09").groupBy(*keys).agg(F.count("*").alias("discounted"))
    out = audit.null_safe_left(x.groupBy(*keys).agg(F.count("*").alias("n")), right, keys)
    return out.select("l_returnflag", "l_linestatus", F.coalesce("line", F.lit(-1)).alias("line"), "s", "y", F.coalesce("large", F.lit(False)).alias("large"), "n", F.coalesce("discounted", F.lit(0)).alias("discounted"))


@query("""SELECT doc_id, 'missing' AS difference FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def id_differences(spark: SparkSession, d: str) -> DataFrame:
    return audit.id_differences(table(spark, d, "documents", "doc_id"), table(spark, d, "labels", "doc_id"), "doc_id")


@query("""SELECT annotator, doc_id, row_number() OVER (PARTITION BY annotator ORDER BY md5('9|' || annotator || '|' || doc_id), doc_id)::INTEGER AS place FROM labels, (SELECT unnest(['A', 'B', 'C']) AS annotator)""")
def annotator_orders(spark: SparkSession, d: str) -> DataFrame:
    return sampling.annotator_orders(table(spark, d, "labels", "doc_id"), "doc_id", ["A", "B", "C"], 9)


@query("""SELECT p_partkey, contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget') AS fits, contains(lower(p_brand || ' ' || p_type), 'brand#2') AS by_author FROM part""")
def title_author_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", N.title_match(F.col("p_name"), "Red a Widget").alias("fits"), N.has_author(F.array("p_brand", "p_type"), "BRAND#2").alias("by_author"))


_KEY = r"substring(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), 1, 240)"


@query(rf"""WITH c AS (SELECT conv_id, turn, {_KEY} AS sentence_key, text, role FROM conversations), p AS (SELECT * FROM c WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, sentence_key ORDER BY turn DESC) = 1),
s AS (SELECT * FROM c WHERE role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, sentence_key ORDER BY turn DESC) = 1)
SELECT coalesce(p.conv_id, s.conv_id) AS conv_id, coalesce(p.sentence_key, s.sentence_key) AS sentence_key, coalesce(p.text, s.text) AS text, array_to_string(list_filter([CASE WHEN p.conv_id IS NOT NULL THEN 'user' END, CASE WHEN s.conv_id IS NOT NULL THEN 'other' END], lambda x: x IS NOT NULL), '|') AS routes,
  ((p.conv_id IS NOT NULL)::INT + (s.conv_id IS NOT NULL)::INT) AS n_routes FROM p FULL JOIN s ON p.conv_id = s.conv_id AND p.sentence_key = s.sentence_key""")
def merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    side = lambda rows: rows.select("conv_id", "turn", "text")
    return audit.merge_contexts(side(c.where("role = 'user'")), side(c.where("role <> 'user'")), ["conv_id"], "text", "turn", ("user", "other"))


_B = r"(?:^|[^\p{L}\p{N}_])"


@query(rf"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, 'license\s+et\s+al\.?\s*,?\s*(2\.0|version)') THEN 'author_et_al_year' WHEN regexp_matches(t, '\(\s*license[^)]*(2\.0|version)\s*\)') THEN 'parenthetical_author_year'
  WHEN NOT regexp_matches(t, '{_B}(apache|mit)(?:[^\p{{L}}\p{{N}}_]|$)') THEN 'unknown_variant' WHEN regexp_matches(t, '{_B}released(?:[^\p{{L}}\p{{N}}_]|$)') THEN 'title_and_group' ELSE 'title_only' END AS variant FROM t""")
def seed_variants(spark: SparkSession, d: str) -> DataFrame:
    cues = R.SeedCues(author="license", title=CUES.title, year=r"2\.0|version", group=CUES.group)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", R.seed_variant(F.col("text"), cues).alias("variant"))


def _topic_sql() -> str:
    held = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    cases = " ".join(f"WHEN {held(words)}{f' AND f = {only!r}' if only else ''} THEN '{topic}'" for topic, words, only in LEX.topics)
    return f"WITH x AS (SELECT doc_id, lower(text) AS t, CASE WHEN doc_id % 2 = 0 THEN 'historical_framing' ELSE 'other' END AS f FROM documents) SELECT doc_id, CASE {cases} ELSE 'unclear' END AS topic FROM x"


@query(_topic_sql())
def context_topics(spark: SparkSession, d: str) -> DataFrame:
    function = F.when(F.col("doc_id") % 2 == 0, "historical_framing").otherwise("other")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", R.topic_of(F.col("text"), LEX, function).alias("topic"))


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'click')::INT DESC, value DESC, event_id) = 1""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    return T.best_reextraction(e, "user_id", F.col("event_type") == "click", F.col("value"), "event_id").select("user_id", "event_id", "value")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS item_index, event_id, event_type FROM events""")
def payload_pages(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one cached result page, and its items as rows again."""
    one = F.to_json(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))))
    pages = table(spark, d, "events", "user_id", "event_id", "event_type").groupBy("user_id").agg(one.alias("payload"))
    rows = io.pages_of(pages, "payload", "struct<event_id:bigint,event_type:string>")
    return rows.select("user_id", F.col("item_index").cast("long").alias("item_index"), "item.event_id", "item.event_type")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS item_index, json_extract_string(props, '$.k')::INTEGER AS k FROM events""")
def payload_items(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events by the table function, numbered within each user."""
    register_payload_items(spark)
    e = table(spark, d, "events", "user_id", "event_id", "props")
    items = "payload_items(TABLE({e}) PARTITION BY (user_id) ORDER BY (event_id), 'props', {kind})"
    return spark.sql(f"SELECT user_id, event_id, item_index, k FROM {items}", e=e, kind=payload_schema("k int"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 4 <> 0 THEN p_type END) AS ext_id, greatest(CASE WHEN p_size % 5 = 0 THEN 0.95 ELSE 0 END, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 0.98 ELSE 0.90 END)::DOUBLE AS metadata_confidence FROM part""")
def reconciled_works(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size")
    works = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("ext_id"), F.when(F.col("p_size") % 5 == 0, 0.95).alias("metadata_confidence"))
    external = p.where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_type").alias("ext_id"), F.when(F.col("p_partkey") % 2 == 0, "doi").otherwise("title").alias("source"))
    return linkage.reconcile(works, external, "p_partkey", ["ext_id"])


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY (lang = 'en')::INT, md5('1|' || doc_id), doc_id) <= 12""")
def preferred_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.preferred_fill(table(spark, d, "documents", "doc_id", "source", "lang"), "source", F.col("lang") != "en", 12, "doc_id").select("doc_id", "source")


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN doc_id % 2 = 0 THEN 'bad' ELSE 'poor' END AS a, CASE WHEN doc_id % 7 = 0 THEN 'poor' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS b FROM labels),
x AS (SELECT k AS class, count(*) AS n, count(*) FILTER (WHERE (a = k) <> (b = k)) AS differ, sum((a = k)::INT + (b = k)::INT) AS g FROM r, (SELECT unnest(['good', 'bad', 'poor']) AS k) GROUP BY 1)
SELECT class, n AS n_units, 2 * n AS n_values, round(1 - (2 * differ) * (2 * n - 1) / (2.0 * g * (2 * n - g)), 6) AS alpha FROM x""")
def alpha_by_class(spark: SparkSession, d: str) -> DataFrame:
    lab, k = table(spark, d, "labels", "doc_id", "quality"), F.col("doc_id")
    good = F.col("quality") == 1
    sides = {"a": F.when(good, "good").when(k % 2 == 0, "bad").otherwise("poor"), "b": F.when(k % 7 == 0, "poor").when(good, "good").otherwise("bad")}
    both = [lab.select(k.alias("unit"), F.lit(c).alias("coder"), v.alias("value")) for c, v in sides.items()]
    return stats.per_class_alpha(both[0].unionByName(both[1]), ["good", "bad", "poor"])


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT doc_id, term, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term)),
t AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM r),
m AS (SELECT lang AS cluster, term, round(sum(v) / any_value(n), 6) AS mean_tfidf FROM t JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang) GROUP BY 1, 2)
SELECT cluster, mean_tfidf, row_number() OVER (PARTITION BY cluster ORDER BY mean_tfidf DESC)::INTEGER AS rank FROM m QUALIFY rank <= 12""")
def language_terms(spark: SparkSession, d: str) -> DataFrame:
    """The weights of each language's leading terms (terms of equal rounded weight could change places)."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    top = X.top_terms(X.tfidf(docs), docs.select("doc_id", F.col("lang").alias("cluster")))
    return top.select("cluster", F.round("mean_tfidf", 6).alias("mean_tfidf"), "rank")


@query("""SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1""")
def attempt_latency(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "events", "user_id", "ts").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select("user_id", F.round(io.latency_seconds(F.col("a"), F.col("b")), 3).alias("seconds"))


@query("""SELECT date_trunc('minute', ts) AS minute, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS rate FROM events GROUP BY 1""")
def error_rate_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return windows.rate_per_minute(table(spark, d, "events", "ts", "event_type"), "ts", F.col("event_type") == "error")


def reply_log(events: DataFrame) -> DataFrame:
    """Events as stored replies of a context's attempt: errors, small values as invalid replies, all others as valid ones."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 25, "invalid").otherwise("valid")
    return events.select(F.col("user_id").alias("context"), F.col("event_id").alias("seq"), (F.col("user_id") % 5 == 0).alias("by_router"), kind.alias("kind"))


@query("""WITH l AS (SELECT user_id AS context, user_id % 5 = 0 AS router, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 25 THEN 'invalid' ELSE 'valid' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
g AS (SELECT context, any_value(router) AS router, count(*) AS replies, min(r) FILTER (WHERE kind <> 'error') AS first, max(kind) FILTER (WHERE r = 1) AS k1 FROM l GROUP BY 1),
x AS (SELECT g.*, a.kind AS ka, b.kind AS kb FROM g LEFT JOIN l a ON a.context = g.context AND a.r = g.first LEFT JOIN l b ON b.context = g.context AND b.r = g.first + 1)
SELECT context, replies, CASE WHEN router THEN CASE WHEN k1 = 'valid' THEN 'router_valid' ELSE 'rejected_router_validation' END WHEN first IS NULL OR first > 3 THEN CASE WHEN replies >= 3 THEN 'api_error' ELSE 'pending' END
  WHEN ka = 'valid' THEN 'initial_valid' WHEN kb IS NULL THEN 'pending' WHEN kb = 'error' THEN 'api_error' WHEN kb = 'valid' THEN 'repaired_valid' ELSE 'rejected_after_repair' END AS status FROM x""")
def attempt_states(spark: SparkSession, d: str) -> DataFrame:
    return attempts.final_statuses(reply_log(table(spark, d, "events", "user_id", "event_id", "event_type", "value")))


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand || '/' || p_partkey END AS url, p_partkey % 3 = 0 AS cached, p_partkey % 7 AS k FROM part)
SELECT p_partkey, url, CASE WHEN cached AND trim(url) <> '' THEN '{"n": ' || p_partkey || '}' WHEN trim(url) <> '' AND k = 1 THEN '{"k": 1}' END AS payload,
  CASE WHEN trim(url) = '' THEN 'skipped_no_query' WHEN cached THEN 'cache_hit' WHEN k = 0 THEN 'pending_fetch' WHEN k = 1 THEN 'fetched' WHEN k = 2 THEN 'json_error' WHEN k = 3 THEN 'request_error:timeout' ELSE 'http_' || (400 + k) END AS status FROM w""")
def fetch_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Wanted keys with the cache's payloads and stored responses: brands stand for urls, numbers decide what was stored."""
    k = F.col("p_partkey") % 7
    url = F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.concat_ws("/", "p_brand", "p_partkey"))
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", url.alias("url"), k.alias("k"))
    known = p.where("trim(url) <> ''")
    cache = known.where("p_partkey % 3 = 0").select("url", F.concat(F.lit('{"n": '), "p_partkey", F.lit("}")).alias("payload"))
    code = F.when(k.isin(1, 2), 200).when(k == 3, F.lit(None)).otherwise(400 + k).cast("int")
    body = F.when(k == 1, '{"k": 1}').when(k == 2, "{broken")
    stored = known.where("k > 0").select("url", code.alias("code"), body.alias("body"), F.when(k == 3, "timeout").alias("error"))
    return io.with_responses(io.cached_lookup(p.select("p_partkey", "url"), cache, "url", enabled=True), stored, "url").select("p_partkey", "url", "payload", "status")


_WORKS = """c AS (SELECT l_partkey, count(*) AS cited FROM lineitem GROUP BY 1), w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 7 THEN '10.' || lower(p_brand) END AS doi, lower(p_name) AS t, lower(p_brand || ' ' || p_type) AS names, 1950 + p_size AS year, coalesce(cited, 0) AS cited FROM part LEFT JOIN c ON l_partkey = p_partkey),
s AS (SELECT p_brand || '/' || p_type AS seed_id, CASE WHEN p_type = 'PROMO' THEN '10.' || lower(p_brand) END AS doi, min_by(lower(p_name), p_partkey) AS title, lower(p_brand) || ' ' AS author, 1950 AS y0, 1980 AS y1 FROM part GROUP BY p_brand, p_type),
f AS (SELECT seed_id, id, year, cited, y0, y1 FROM s JOIN w ON contains(names || ' ', author) AND len(list_filter(string_split(title, ' '), lambda x: length(x) > 2 AND NOT contains(t, x))) = 0),
bydoi AS (SELECT seed_id, min(id) AS id FROM s JOIN w ON s.doi = w.doi GROUP BY 1), r AS (SELECT seed_id, id, 'doi_lookup' AS method FROM bydoi UNION ALL
  SELECT seed_id, id, 'title_search_then_get' FROM (SELECT * FROM f WHERE year BETWEEN y0 AND y1 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY cited DESC, id) = 1) WHERE seed_id NOT IN (SELECT seed_id FROM bydoi))"""


def _works_and_seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as works, cited by their lines; the first name of each brand and type is a seed's title."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    cited = table(spark, d, "lineitem", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("cited"))
    works = p.join(cited, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 7, F.concat(F.lit("10."), "p_brand")).alias("doi"), F.col("p_name").alias("title"),
        F.array("p_brand", "p_type", F.lit("")).alias("authors"), (F.col("p_size") + 1950).alias("year"), F.coalesce("cited", F.lit(0)).alias("cited"),
    )
    named = p.groupBy("p_brand", "p_type").agg(F.min_by("p_name", "p_partkey").alias("title"))
    known = named.select(
        F.concat_ws("/", "p_brand", "p_type").alias("seed_id"), F.when(F.col("p_type") == "PROMO", F.concat(F.lit("10."), "p_brand")).alias("doi"), "title",
        F.concat("p_brand", F.lit(" ")).alias("author"), F.lit(1950).alias("year_from"), F.lit(1980).alias("year_to"),
    )
    return works, known


@query(f"WITH {_WORKS} SELECT seed_id, id, method FROM r")
def seed_resolution(spark: SparkSession, d: str) -> DataFrame:
    return seeds.resolve_seeds(*_works_and_seeds(spark, d))


@query(f"""WITH {_WORKS} SELECT seed_id, id, year, cited, row_number() OVER (PARTITION BY seed_id ORDER BY cited DESC, id)::INTEGER AS rank FROM f WHERE year BETWEEN greatest(1900, y0 - 5) AND 2025 AND (seed_id, id) NOT IN (SELECT seed_id, id FROM r) QUALIFY rank <= 15""")
def seed_editions(spark: SparkSession, d: str) -> DataFrame:
    works, known = _works_and_seeds(spark, d)
    return seeds.other_editions(works, known, seeds.resolve_seeds(works, known))


@query("""SELECT doc_id, CASE WHEN (doc_id % 3 = 0 AND doc_id % 4 = 0) OR (doc_id % 3 = 1 AND doc_id % 4 = 1) OR (doc_id % 3 = 2 AND doc_id % 4 = 2) THEN '' ELSE 'stance_evidence_failure' END AS errors FROM documents""")
def stance_validator(spark: SparkSession, d: str) -> DataFrame:
    """Judging stances whose quotes hold cues for, against, for both or for neither."""
    docs, k = table(spark, d, "documents", "doc_id", "source"), F.col("doc_id")
    quote = F.when(k % 4 == 0, "it proved useful").when(k % 4 == 1, "the critics refuted it").when(k % 4 == 2, "useful but mistaken").otherwise("it was read")
    fixed = {"citation_function": "unclear", "topic": "unclear", "quote_function": R.ABSTAIN, "quote_topic": R.ABSTAIN, "reasoning_summary": "short"}
    result = {n: F.lit(v) for n, v in fixed.items()} | {
        "context_id": k.cast("string"), "context_group_id": k.cast("string"), "stance": F.when(k % 3 == 0, "supportive").when(k % 3 == 1, "critical").otherwise("mixed"), "quote_stance": quote,
        "confidence_function": F.lit(0.9), "confidence_topic": F.lit(0.5), "confidence_stance": F.lit(0.7), "flags": F.array(F.lit("none")), "needs_human_review": F.lit(False),
    }
    found = R.validate_result(result, F.concat_ws(" said: ", "source", quote), k.cast("string"), k.cast("string"), F.lit(False), ("unclear",), ("none",))
    return docs.select("doc_id", F.array_join(found, "|").alias("errors"))


_OWN = _SCORED.replace("p_size AS year FROM part)", "p_size AS year FROM part WHERE p_partkey % 10 <> 0)")


@query(f"""WITH RECURSIVE {_OWN}, {_LEADERS} SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'doi:' || p_brand WHEN leader IS NOT NULL THEN 'fuzzy:' || leader ELSE 'singleton:' || p_partkey END AS cluster_id,
  CASE WHEN p_partkey % 10 = 0 THEN 1.0 WHEN leader = p_partkey THEN 0.75 WHEN leader IS NOT NULL THEN score ELSE 0.5 END::DOUBLE AS dedup_confidence,
  CASE WHEN p_partkey % 10 = 0 THEN 'exact_doi' WHEN leader = p_partkey THEN 'title_author_year_singleton' WHEN leader IS NOT NULL THEN 'fuzzy_title_author_year' ELSE 'insufficient_metadata_singleton' END AS dedup_method
FROM part LEFT JOIN l ON l.id = p_partkey LEFT JOIN s ON s.a = l.leader AND s.b = l.id""")
def attributed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of parts with confidence and method, from their scored pairs and leaders."""
    works = _titles(spark, d).withColumn("doi", F.when(F.col("p_partkey") % 10 == 0, F.element_at(F.split("author", "_"), 1)))
    tables, own = Tables(spark, "attributed"), works.where("doi is null")
    held, scored, leaders = linkage.clusters_of_copies(own, *_WORK, tables)
    leaders = tables.write(leaders)
    out = linkage.attributed_clusters(works, "p_partkey", "doi", "title", linkage.of_members(held, leaders), linkage.member_scores(held, leaders, scored))
    return out.select("p_partkey", "cluster_id", "dedup_confidence", "dedup_method")
