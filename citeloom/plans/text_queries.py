"""Normalisation, extraction, rule cascades and validation over parts, pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import normalize as N
from citeloom.functions import text as X
from citeloom.operators import rules as R
from citeloom.plans.registry import query, table
from citeloom.sources.io import pick_json

#: Terms that occur in the driver's documents stand for the domain's lexicons.
CUES = R.SeedCues(author=r"\blicense\b", title=r"\bapache\b|\bmit\b", year=r"\b(2\.0|version)\b", group=r"\breleased\b")
LEX = R.Lexicons(
    modeling=("model", "license", "thing"), foundational=("food", "and the", "sch"), historical=("published", "seminal", "released", "der"), policy=("policy", "gnu", "les")
)


@query(r"""SELECT p_partkey, nullif(trim(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '') AS title_norm,
  nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), '') AS venue_norm,
  nullif(regexp_replace(lower(string_split(p_name, ' ')[-1]), '[^a-z]+', '', 'g'), '') AS surname,
  '10_' || regexp_replace(lower(p_brand), '[^A-Za-z0-9]+', '_', 'g') AS doi_safe FROM part""")
def normalize_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return p.select(
        "p_partkey",
        N.normalize_title(F.col("p_name")).alias("title_norm"),
        N.venue_key(F.col("p_type")).alias("venue_norm"),
        N.first_author_surname(F.col("p_name")).alias("surname"),
        N.safe_doi_id(F.concat(F.lit("https://doi.org/10/"), "p_brand")).alias("doi_safe"),
    )


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', ' ', 'g')), '') AS ref_key FROM pages""")
def page_reference_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", N.reference_key(F.regexp_replace("url", "^https?://", "")).alias("ref_key"))


@query("""SELECT o_orderkey, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, CASE WHEN year(o_orderdate) < 2000 THEN 'pre2000' WHEN year(o_orderdate) < 2010 THEN '2000s' ELSE '2010onward' END AS band,
  CASE WHEN b <= 0 THEN '0' WHEN b < 5 THEN '1-4' WHEN b < 25 THEN '5-24' WHEN b < 100 THEN '25-99' WHEN b < 500 THEN '100-499' ELSE '500+' END AS cited_bin,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status
FROM (SELECT *, floor(o_totalprice / 1000)::BIGINT AS b FROM orders)""")
def decade_band_bins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    year = F.year("o_orderdate")
    return o.select(
        "o_orderkey",
        N.decade(year).alias("decade"),
        N.band_of(N.decade_of(year)).alias("band"),
        N.cited_by_bin(F.floor(F.col("o_totalprice") / 1000)).alias("cited_bin"),
        N.recode(F.col("o_orderstatus"), {"F": "final", "O": "open"}).alias("status"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, CASE WHEN json_extract_string(props, '$.missing') IS NULL THEN 'none' ELSE 'some' END AS missing FROM events""")
def json_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "props")
    missing = F.when(pick_json(F.col("props"), "$.missing").isNull(), "none").otherwise("some")
    return e.select("event_id", N.lenient_int(pick_json(F.col("props"), "$.k")).alias("k"), missing.alias("missing"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s ]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "html").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, sha1(lower(lang) || '||' || source)[1:12] AS group_hash, substring(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 240) AS context_key FROM documents""")
def context_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    return docs.select("doc_id", N.short_hash(F.lower("lang"), F.col("source")).alias("group_hash"), N.context_key(F.col("text")).alias("context_key"))


_COUNT = "len(regexp_extract_all({c}, '{p}'))"


@query(r"""WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents), s AS (SELECT doc_id,
  CASE WHEN regexp_matches(t, '\b(references|bibliography|works\s+cited|literature\s+cited)\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\bdoi\b|\b10\.\d{4,9}/') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(t, '\bpp\.?\s*\d+\b|\bvol\.?\b|\bno\.?\b|\bed\.?\b') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '\b(19|20)\d{2}\b')) >= 2 THEN 1 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(text, ',')) >= 4 THEN 1 ELSE 0 END AS score FROM d) SELECT doc_id, score, score >= 3 AS bib_like FROM s""")
def bibliography_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", R.bibliography_score(F.col("text")).alias("score"))
    return docs.withColumn("bib_like", F.col("score") >= 3)


_CASCADE = r"""WITH d AS (SELECT doc_id, lower(text) AS t, text FROM documents), h AS (SELECT doc_id, t,
  regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(?:apache|mit)(?:[^\p{L}\p{N}_]|$)') AS has_title, regexp_matches(t, '(?:^|[^\p{L}\p{N}_])license(?:[^\p{L}\p{N}_]|$)') AS has_author, regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(2\.0|version)(?:[^\p{L}\p{N}_]|$)') AS has_year, regexp_matches(t, '(?:^|[^\p{L}\p{N}_])released(?:[^\p{L}\p{N}_]|$)') AS has_group,
  regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(model|models|simulation|system\s+dynamics|scenario|forecast)(?:[^\p{L}\p{N}_]|$)') AS has_modeling, regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(critique|criticis|refut|controvers|wrong|failed|debate)(?:[^\p{L}\p{N}_]|$)') AS has_critique,
  regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(policy|governance|planning|regulation|development\s+strategy|sustainable\s+development)(?:[^\p{L}\p{N}_]|$)') AS has_policy,
  regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(historical|history|early|classic|seminal|landmark|foundational)(?:[^\p{L}\p{N}_]|$)') AS has_history, regexp_matches(t, '(?:^|[^\p{L}\p{N}_])(sustainab|ecological\s+limits|planetary\s+boundaries|overshoot|collapse|growth)(?:[^\p{L}\p{N}_]|$)') AS has_sustainability FROM d),
c AS (SELECT *, CASE WHEN has_author AND has_year THEN 'SEED_WORK' WHEN has_title AND (has_group OR has_modeling OR has_critique OR has_sustainability) THEN 'SEED_DISCOURSE' ELSE 'LOW_CONFIDENCE' END AS semantic_label,
  CASE WHEN has_critique THEN 'critique' WHEN has_modeling THEN 'modeling_simulation_reference' WHEN has_policy THEN 'policy_governance_framing' WHEN has_history THEN 'historical_framing'
  WHEN has_sustainability THEN 'sustainability_discourse' WHEN has_author AND has_year THEN 'foundational_citation' ELSE 'background_or_ambiguous' END AS citation_function,
  has_author::INT * 3 + has_year::INT * 2 + has_title::INT * 2 + has_group::INT AS score FROM h) """


@query(
    _CASCADE
    + r"""SELECT doc_id, score, semantic_label, citation_function,
  CASE WHEN semantic_label = 'SEED_WORK' THEN 'low' WHEN has_title AND NOT (has_author OR has_group) THEN 'high_generic_limits_phrase' WHEN semantic_label = 'LOW_CONFIDENCE' THEN 'medium_low_confidence' ELSE 'medium' END AS risk,
  has_title, has_author, has_year, has_group FROM c"""
)
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    c = R.classify_context(docs, "text", CUES, F.lit(False))
    return c.select("doc_id", "score", "semantic_label", "citation_function", "risk", "has_title", "has_author", "has_year", "has_group")


@query(
    _CASCADE
    + r""", r AS (SELECT *, CASE WHEN semantic_label = 'SEED_WORK' THEN 'low' WHEN has_title AND NOT (has_author OR has_group) THEN 'high' ELSE 'medium' END AS risk FROM c),
b AS (SELECT *, least(1.0, greatest(0.1, score / 8.0)) AS b0 FROM r), b1 AS (SELECT *, CASE WHEN risk = 'high' THEN least(b0, 0.45) ELSE b0 END AS b1 FROM b),
b2 AS (SELECT *, CASE WHEN length(t) < 80 THEN least(b1, 0.65) ELSE b1 END AS b2 FROM b1) SELECT doc_id, round(CASE WHEN length(t) >= 160 THEN least(1.0, b2 + 0.05) ELSE b2 END, 3)::DOUBLE AS confidence FROM b2"""
)
def context_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    c = R.classify_context(docs, "text", CUES, F.lit(False))
    conf = R.context_confidence(F.col("score"), F.lit("BODY"), F.col("risk"), F.lit(False), F.lit(0), F.col("text"))
    return c.select("doc_id", conf.alias("confidence"))


_TURNS = """WITH w AS (SELECT conv_id, turn, coalesce(lag(text) OVER o, '') AS sentence_before, coalesce(text, '') AS citing_sentence, coalesce(lead(text) OVER o, '') AS sentence_after
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), n AS (SELECT *, (sentence_before <> '')::INT + (citing_sentence <> '')::INT + (sentence_after <> '')::INT AS n FROM w)
SELECT conv_id, turn, sentence_before, citing_sentence, sentence_after, concat_ws(' ', nullif(sentence_before, ''), nullif(citing_sentence, ''), nullif(sentence_after, '')) AS context_text,
  n = 3 AS context_window_complete, n::BIGINT AS context_sentence_count,
  CASE n WHEN 0 THEN 'no_sentence_detected' WHEN 3 THEN 'complete_three_sentence_window' ELSE 'partial_document_edge_window' END AS context_window_status FROM n"""


@query(_TURNS)
def turn_window(spark: SparkSession, d: str) -> DataFrame:
    return X.three_windows(table(spark, d, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")


@query()
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows around every sentence with a license word; splitting sentences has a state that SQL lacks."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return X.sentence_windows(docs.where(F.contains(F.lower("text"), F.lit("license"))), lambda s: F.contains(F.lower(s), F.lit("license")))


@query()
def seed_match_windows(spark: SparkSession, d: str) -> DataFrame:
    seed = X.Seed(author=r"\bLicense\b", title=r"\b(?:MIT|Apache)\b", year=r"\b2\.0\b|\bversion\b")
    return X.seed_matches(table(spark, d, "documents", "doc_id", "text"), seed)


@query(r"""WITH d AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents), k AS (SELECT *, ceil(greatest(0, 350 - 7) / 2.0)::INT AS g FROM d WHERE p > 0),
w AS (SELECT doc_id, text, greatest(1, p - g) AS lo, least(length(text), p + 6 + g) AS hi FROM k)
SELECT doc_id, trim(regexp_replace(substring(text, lo, hi - lo + 1), '\s+', ' ', 'g')) AS snippet FROM w""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("p", F.instr(F.lower("text"), F.lit("license"))).where("p > 0")
    return docs.select("doc_id", X.char_window(F.col("text"), F.col("p"), F.col("p") + 6).alias("snippet"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents)
SELECT term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ('the', 'and') GROUP BY 1 ORDER BY n DESC, term LIMIT 200""")
def tokenize_topterms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "text").select(F.explode(X.tokens(F.col("text"), 3, ("the", "and"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(200)


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 3 GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT doc_id, term, tf, df, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term))
SELECT doc_id, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM r""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return X.tfidf(table(spark, d, "documents", "doc_id", "text")).withColumn("tfidf", F.round("tfidf", 6))


@query(r"""WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS text, lag(text) OVER o AS b, lead(text) OVER o AS a FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, trim(text) AS main, trim(concat_ws(' ', nullif(trim(text), ''), nullif(trim(b), ''), nullif(trim(a), ''))) AS whole FROM d),
h AS (SELECT *, lower(main) AS low, contains(lower(main), 'model') OR contains(lower(main), 'license') OR contains(lower(main), 'thing') AS m, contains(lower(main), 'food') OR contains(lower(main), 'and the') OR contains(lower(main), 'sch') AS f,
  contains(lower(main), 'published') OR contains(lower(main), 'seminal') OR contains(lower(main), 'released') OR contains(lower(main), 'der') AS h, contains(lower(main), 'policy') OR contains(lower(main), 'gnu') OR contains(lower(main), 'les') AS p,
  (length(whole) - length(replace(whole, '(', ''))) <> (length(whole) - length(replace(whole, ')', ''))) AND len(regexp_extract_all(whole, '[A-Za-z]{2,}')) < 25 AS noisy FROM m)
SELECT conv_id, turn, CASE WHEN main = '' THEN 'deterministic_unclear' WHEN noisy THEN 'deterministic_unclear' WHEN m THEN 'deterministic_modeling' WHEN f AND NOT p THEN 'deterministic_foundational' WHEN p AND NOT f THEN 'llm_gray_zone' WHEN h THEN 'deterministic_historical' ELSE 'llm_gray_zone' END AS decision,
  CASE WHEN main = '' THEN 'unclear' WHEN noisy THEN 'unclear' WHEN m THEN 'modeling_simulation_reference' WHEN f AND NOT p THEN 'foundational_citation' WHEN p AND NOT f THEN 'policy_governance_framing' WHEN h THEN 'historical_framing' ELSE 'unclear' END AS citation_function,
  CASE WHEN main = '' THEN 0.35 WHEN noisy THEN 0.42 WHEN m THEN 0.88 WHEN f AND NOT p THEN 0.86 WHEN p AND NOT f THEN 0.62 WHEN h THEN 0.84 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN main = '' OR noisy THEN false WHEN m OR (f AND NOT p) THEN false WHEN p AND NOT f THEN true WHEN h THEN false ELSE true END AS undecided FROM h""")
def router_struct(spark: SparkSession, d: str) -> DataFrame:
    routed = R.route(_turn_windows(spark, d), LEX, "citing_sentence", "sentence_before", "sentence_after")
    return routed.select("conv_id", "turn", "route.decision", "route.citation_function", "route.confidence", "route.undecided")


def _turn_windows(spark: SparkSession, d: str) -> DataFrame:
    return X.three_windows(table(spark, d, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")


_FIRST = lambda c, terms: "coalesce(" + ", ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN substring({c}, strpos(lower({c}), '{t}'), {len(t)}) END" for t in terms) + ", '')"


@query(rf"""WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS text, lag(text) OVER o AS b, lead(text) OVER o AS a FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
w AS (SELECT *, trim(text) AS main, trim(concat_ws(' ', nullif(trim(text), ''), nullif(trim(b), ''), nullif(trim(a), ''))) AS whole, trim(coalesce(b, '')) = '' AND trim(coalesce(a, '')) = '' OR trim(text) = '' AS limited FROM d),
h AS (SELECT *, {_FIRST('main', LEX.modeling)} AS m, {_FIRST('main', LEX.foundational)} AS f, {_FIRST('main', LEX.historical)} AS h, {_FIRST('main', LEX.policy)} AS p, len(regexp_split_to_array(whole, '\s+')) AS n,
  len(regexp_extract_all(whole, '\(')) <> len(regexp_extract_all(whole, '\)')) AND len(regexp_extract_all(whole, '[A-Za-z]{{2,}}')) < 25 AS noisy FROM w),
k AS (SELECT *, CASE WHEN main = '' THEN 0 WHEN noisy THEN 2 WHEN m <> '' THEN 4 WHEN f <> '' AND p = '' THEN 5 WHEN p <> '' AND f = '' THEN 6 WHEN h <> '' THEN 7 ELSE 8 END AS k FROM h),
r AS (SELECT *, CASE WHEN k = 0 THEN 'missing_surrounding_context' WHEN k = 2 THEN 'ocr_noise' WHEN k IN (4, 5, 7) AND n < CASE WHEN k = 4 THEN 16 ELSE 14 END THEN 'snippet_too_short' ELSE 'none' END AS flag,
  concat_ws(' | ', CASE WHEN m <> '' THEN 'modeling' END, CASE WHEN f <> '' THEN 'foundational' END, CASE WHEN h <> '' THEN 'historical' END, CASE WHEN p <> '' THEN 'policy' END) AS hits FROM k)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'missing_context' WHEN 2 THEN 'ocr_noise' WHEN 8 THEN CASE WHEN hits = '' THEN 'gray_zone' ELSE hits END ELSE hits END AS rule_hits, k IN (6, 8) OR limited OR flag <> 'none' OR k IN (0, 2) AS needs_human_review,
  CASE WHEN k NOT IN (6, 8) THEN flag END AS flag, CASE k WHEN 4 THEN m WHEN 5 THEN f WHEN 7 THEN h WHEN 0 THEN 'insufficient_evidence' WHEN 2 THEN 'insufficient_evidence' END AS quote_function, CASE WHEN k IN (6, 8) THEN NULL WHEN k IN (0, 2) THEN 0.45 WHEN k = 4 AND regexp_matches(lower(whole), 'success(ful)?') THEN 0.78 ELSE 0.84 END::DOUBLE AS confidence_stance FROM r""")
def router_result(spark: SparkSession, d: str) -> DataFrame:
    """What the router says beside its decision, and the classification row of decided contexts."""
    routed = R.route(_turn_windows(spark, d), LEX, "citing_sentence", "sentence_before", "sentence_after")
    r = F.col("route.result")
    return routed.select("conv_id", "turn", "route.rule_hits", "route.needs_human_review", F.get(r["flags"], F.lit(0)).alias("flag"), r["quote_function"].alias("quote_function"), r["confidence_stance"].alias("confidence_stance"))


@query(r"""WITH r AS (SELECT l.doc_id, d.text, l.doc_id % 13 AS v, regexp_extract(d.text, '\S+') AS q FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, concat_ws('|', CASE WHEN v = 11 THEN 'missing_required_fields' END, CASE WHEN v = 1 THEN 'invalid_category' END, CASE WHEN v = 2 THEN 'invalid_confidence' END, CASE WHEN v = 3 THEN 'invalid_uncertainty_flags' END, CASE WHEN v = 4 THEN 'invalid_schema_fields' END,
  CASE WHEN v = 5 THEN 'identifier_mismatch' END, CASE WHEN v = 6 OR v <> 7 AND v <> 8 AND q = '' THEN 'empty_evidence' END, CASE WHEN v IN (6, 7, 8) OR q = '' THEN 'non_exact_evidence' END, CASE WHEN v = 8 THEN 'category_token_as_evidence' END, CASE WHEN v = 9 THEN 'unsupported_label_without_evidence' END,
  CASE WHEN v IN (3, 10) THEN 'review_policy_failure' END, CASE WHEN v = 12 THEN 'stance_evidence_failure' END) AS errors FROM r""")
def row_validator(spark: SparkSession, d: str) -> DataFrame:
    """Results that break one rule each, by the remainder of the id; the quote is the text's first word."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    key, v = F.col("doc_id").cast("string"), F.col("doc_id") % 13
    quote = F.when(v == 6, " ").when(v == 7, "no such words here").when(v == 8, "critique").otherwise(F.regexp_extract("text", r"\S+", 0))
    result = {
        "context_id": F.when(v == 5, "other").otherwise(key),
        "context_group_id": key,
        "citation_function": F.when(v == 1, "nonsense").when(v == 9, "critique").otherwise("unclear"),
        "topic": F.lit("unclear"),
        "stance": F.when(v == 12, "supportive").otherwise("neutral_descriptive"),
        "quote_function": F.when(v == 9, R.ABSTAIN).otherwise(quote),
        "quote_topic": F.lit(R.ABSTAIN),
        "quote_stance": F.when(v == 12, F.regexp_extract("text", r"\S+", 0)).otherwise(F.lit(R.ABSTAIN)),
        "confidence_function": F.when(v == 2, 1.5).otherwise(0.9),
        "confidence_topic": F.lit(0.5),
        "confidence_stance": F.lit(0.5),
        "flags": F.when(v == 3, F.array(F.lit("none"), F.lit("ocr_noise"))).when(v == 10, F.array(F.lit("ocr_noise"))).otherwise(F.array(F.lit("none"))),
        "needs_human_review": F.lit(False),
        "reasoning_summary": F.when(v == 4, F.repeat(F.lit("long "), 60)).when(v == 11, F.lit(None).cast("string")).otherwise("short"),
    }
    found = R.validate_result(result, F.col("text"), key, key, F.lit(False), ("unclear", "sustainability"), ("none", "ocr_noise", "bibliography_only"))
    return rows.select("doc_id", F.array_join(found, "|").alias("errors"))


@query(r"""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN y >= 2000 THEN 'recent' END) AS flags,
  (CASE WHEN o_totalprice > 300000 THEN 3 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END + CASE WHEN y >= 2000 THEN 1 ELSE 0 END) AS score,
  CASE WHEN o_orderstatus = 'P' OR o_totalprice > 300000 AND y >= 2000 THEN 'high' WHEN o_totalprice > 300000 OR y >= 2000 THEN 'medium' ELSE 'low' END AS priority FROM o""")
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    large, partial, recent = F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "P", F.year("o_orderdate") >= 2000
    return o.select(
        "o_orderkey",
        F.array_join(R.flags((large, "large"), (partial, "partial"), (recent, "recent")), "|").alias("flags"),
        R.points((large, 3), (partial, 2), (recent, 1)).alias("score"),
        R.cascade([(partial | (large & recent), "high"), (large | recent, "medium")], "low").alias("priority"),
    )


@query(r"""WITH d AS (SELECT doc_id, text, lang = 'de' AS bib, source = 'src_3' OR doc_id % 3 = 0 AS seed, lower(text) AS t FROM documents),
r AS (SELECT *, list_filter([CASE WHEN contains(t, 'wrong') OR contains(t, 'failed') THEN 'critique' END, CASE WHEN contains(t, 'model') THEN 'modeling_simulation_reference' END, CASE WHEN contains(t, 'license') OR contains(t, 'policy') THEN 'policy_governance_framing' END], lambda x: x IS NOT NULL) AS f FROM d),
g AS (SELECT *, CASE WHEN bib THEN ['bibliographic_only'] ELSE [] END || CASE WHEN len(f) > 0 THEN f WHEN seed THEN ['foundational_citation'] ELSE ['unclear'] END AS roles FROM r)
SELECT doc_id, array_to_string(roles, '|') AS roles, roles[1] AS primary_role, CASE WHEN seed THEN 'yes' ELSE 'ambiguous' END AS is_seed, CASE WHEN seed AND bib THEN 0.65 WHEN seed THEN 0.78 ELSE 0.45 END::DOUBLE AS confidence,
  CASE WHEN list_contains(roles, 'modeling_simulation_reference') THEN 'system_dynamics_modeling' WHEN list_contains(roles, 'policy_governance_framing') THEN 'environmental_policy' WHEN bib THEN 'bibliographic_record' ELSE 'the_seed' END AS discourse,
  CASE WHEN bib THEN 'bibliography_only' ELSE 'missing_surrounding_context' END || CASE WHEN seed THEN '' ELSE '|ambiguous_referent' END AS flags FROM g""")
def fallback_roles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source").withColumn("section", F.when(F.col("lang") == "de", "BIBLIO").otherwise("BODY"))
    roles = {"critique": ("wrong", "failed"), "modeling_simulation_reference": ("model",), "policy_governance_framing": ("license", "policy")}
    seed = (F.col("source") == "src_3") | (F.col("doc_id") % 3 == 0)
    f = F.col("fallback")
    return R.fallback_classification(docs, "text", "section", seed, "the_seed", roles).select(
        "doc_id", F.array_join(f["roles"], "|").alias("roles"), f["primary_role"].alias("primary_role"), f["is_seed_work_citation"].alias("is_seed"),
        f["confidence"].alias("confidence"), f["discourse_category"].alias("discourse"), F.array_join(f["uncertainty_flags"], "|").alias("flags"),
    )
