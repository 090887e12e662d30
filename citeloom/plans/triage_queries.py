"""Triage rules over conversations, documents, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import triage as T
from citeloom.plans.registry import query, table

_OR = lambda c, terms: "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_WORDS = r"CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\s+')) END"


@query(f"""WITH d AS (SELECT d.doc_id, text, lower(text) AS t, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN coalesce(toxic = 1, false) THEN 'human_coded' WHEN coalesce(quality = 0, false) THEN 'boundary_case' WHEN contains(t, 'bibliograph') THEN 'bibliography_like'
  WHEN {_OR('t', ('ocr', 'snippet_too_short', 'low confidence'))} THEN 'ocr_or_low_confidence' WHEN {_OR('t', (*T.MODELS, 'world3', 'world 3'))} THEN 'modeling_simulation' WHEN {_OR('t', T.RESOURCES)} THEN 'foundational_claim'
  WHEN {_OR('t', T.RULING)} THEN 'policy_governance_ambiguity' WHEN {_OR('t', T.LINEAGE)} THEN 'historical_lineage' WHEN contains(t, 'license') THEN 'generic_limits_phrase' WHEN {_WORDS} < 35 THEN 'short_context' ELSE 'lower_risk_neutral_historical' END AS stratum FROM d""")
def assign_stratum(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    docs = T.with_words(docs, "text").withColumns(
        {
            "human_coded": F.col("toxic") == 1, "boundary_case": F.col("quality") == 0, "bibliography_like": F.lit(False), "extraction_confidence": F.lit(1.0),
            "generic_phrase": F.contains("body", F.lit("license")),
        }
    )
    return docs.select("doc_id", T.stratum().alias("stratum"))


@query(f"""WITH d AS (SELECT d.doc_id, text, lower(text) AS t, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT *, CASE WHEN toxic = 1 THEN 1 WHEN contains(t, 'license') THEN 2 WHEN quality = 0 OR contains(t, 'ocr') OR contains(t, chr(65533)) THEN 3 WHEN {_OR('t', T.RULING)} THEN 4 WHEN {_OR('t', T.MODELS)} AND doc_id % 2 = 0 THEN 5
  WHEN {_OR('t', T.CLAIMS)} AND doc_id % 2 = 0 THEN 6 WHEN contains(t, 'publication') THEN 7 WHEN {_WORDS} < 45 THEN 8 WHEN doc_id % 5 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 10 ELSE 11 END AS n FROM d),
f AS (SELECT *, ['evidence_quote_failure', 'generic_title_or_generic_limits', 'ocr_or_text_quality', 'policy_governance_ambiguity', 'historical_vs_modeling', 'historical_vs_foundational', 'bibliography_or_publication_history', 'short_context', 'stance_ambiguity', 'topic_label_weakness', 'true_interpretive_gray_zone'][n] AS failure_family,
  ['llm_used_non_exact_or_paraphrased_evidence', 'generic_limits_phrase_or_title_mention', 'text_quality_or_ocr_noise_limits_interpretation', 'policy_terms_present_but_rhetorical_function_uncertain', 'modeling_language_overlaps_with_historical_or_scenario_framing', 'substantive_resource_claim_overlaps_with_historical_framing', 'publication_history_or_bibliography_boundary', 'context_too_short_or_missing_adjacent_sentences', 'stance_requires_explicit_evaluative_evidence', 'topic_label_unclear_or_too_broad', 'coherent_context_requires_interpretive_judgment'][n] AS failure_mode,
  n IN (2, 3, 5, 6, 7, 8) AS can_router_handle_future_cases, n IN (3, 8) AS needs_extraction_improvement, n IN (1, 4, 9) AS needs_prompt_improvement, toxic = 1 OR n IN (2, 3, 4, 11) OR doc_id % 4 = 0 AS needs_human_review, n IN (1, 4, 9, 11) AS candidate_for_model_benchmark FROM n)
SELECT doc_id, failure_family, failure_mode, can_router_handle_future_cases, needs_extraction_improvement, needs_prompt_improvement, needs_human_review, candidate_for_model_benchmark, CASE WHEN n = 1 THEN 'tighten_prompt_validator_or_repair_then_benchmark' WHEN needs_extraction_improvement THEN 'improve_extraction_or_context_window_before_reclassification'
  WHEN can_router_handle_future_cases THEN 'add_or_tighten_deterministic_router_rule' WHEN needs_human_review THEN 'targeted_human_review' WHEN candidate_for_model_benchmark THEN 'model_benchmark_on_gray_zone' ELSE 'retain_as_gray_zone_with_spot_check' END AS recommended_next_action FROM f""")
def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    k, no, none = F.col("doc_id"), F.lit(False), F.lit("")
    rows = T.with_words(rows, "text").withColumns(
        {
            "errors": F.when(F.col("toxic") == 1, F.array(F.lit("non_exact_evidence"))).otherwise(F.array().cast("array<string>")),
            "generic_phrase": F.contains("body", F.lit("license")), "ocr": F.col("quality") == 0, "bibliography_like": no, "limited": no,
            "accepted": F.col("toxic") == 0, "has_human_label": k % 4 != 0, "label": F.when(k % 2 == 0, "historical_framing").otherwise("critique"),
            "human": none, "earlier": none, "stance": F.when(k % 5 == 0, "mixed").otherwise("unclear"), "topic": F.when(k % 3 == 0, "unclear").otherwise("growth"),
        }
    )
    return T.failures(rows).select("doc_id", "failure_family", "failure_mode", *T.NEEDS, "recommended_next_action")


@query(f"""WITH r AS (SELECT l.doc_id, quality, toxic, text, lower(text) AS t, n_chars, ['critique', 'policy_governance_framing', 'historical_framing', 'modeling_simulation_reference'][l.doc_id % 4 + 1] AS role, CASE l.doc_id % 3 WHEN 0 THEN 'foundational_citation' WHEN 1 THEN 'historical_framing' ELSE '' END AS other, CASE WHEN l.doc_id % 6 = 5 THEN 'supportive' ELSE 'unclear' END AS stance FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
f AS (SELECT *, list_filter([CASE WHEN n_chars < 800 THEN 'low_extraction_confidence' END, CASE WHEN toxic = 1 THEN 'ocr_noise' END, CASE WHEN quality = 0 THEN 'generic_limits_false_positive_risk' END, CASE WHEN toxic = 1 THEN 'high_llm_confidence_with_uncertainty' END,
  CASE WHEN other <> '' AND other <> role THEN 'fallback_llm_primary_role_disagreement' END, CASE WHEN stance = 'supportive' AND NOT {_OR('t', T.ENDORSING)} THEN 'supportive_stance_without_explicit_endorsement' END,
  CASE WHEN role = 'critique' AND NOT {_OR('t', T.REJECTING)} THEN 'critique_without_explicit_negative_assessment' END, CASE WHEN role = 'policy_governance_framing' AND NOT {_OR('t', T.GOVERNING)} THEN 'policy_label_without_policy_content' END,
  CASE WHEN role = 'modeling_simulation_reference' AND NOT {_OR('t', T.MODELLING)} THEN 'modeling_label_without_model_content' END, CASE WHEN role = 'historical_framing' AND other = 'foundational_citation' THEN 'historical_foundational_ambiguity' END,
  CASE WHEN role = 'modeling_simulation_reference' AND other = 'historical_framing' THEN 'historical_modeling_ambiguity' END], lambda x: x IS NOT NULL) AS f FROM r)
SELECT doc_id, array_to_string(f, '|') AS audit_flags, CASE WHEN stance = 'supportive' OR role = 'critique' OR toxic = 1 OR n_chars < 800 OR len(list_intersect(f, ['generic_limits_false_positive_risk', 'policy_label_without_policy_content', 'modeling_label_without_model_content', 'fallback_llm_primary_role_disagreement'])) > 0 THEN 'high' WHEN len(f) > 0 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN role = 'critique' THEN 120 ELSE 0 END + CASE WHEN stance = 'supportive' THEN 115 ELSE 0 END + CASE WHEN list_contains(f, 'historical_foundational_ambiguity') THEN 90 ELSE 0 END + CASE WHEN list_contains(f, 'historical_modeling_ambiguity') THEN 90 ELSE 0 END
  + CASE WHEN list_contains(f, 'fallback_llm_primary_role_disagreement') THEN 85 ELSE 0 END + CASE WHEN quality = 0 THEN 75 ELSE 0 END + CASE WHEN n_chars < 800 THEN 50 ELSE 0 END + CASE WHEN toxic = 1 THEN 40 ELSE 0 END
  + CASE WHEN role = 'modeling_simulation_reference' THEN 65 ELSE 0 END + CASE WHEN role IN ('historical_framing', 'modeling_simulation_reference') THEN 10 ELSE 0 END AS review_score FROM f""")
def audit_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "text", "n_chars"), "doc_id")
    k = F.col("doc_id")
    roles = F.array(*map(F.lit, ("critique", "policy_governance_framing", "historical_framing", "modeling_simulation_reference")))
    rows = rows.withColumns(
        {
            "context_id_count": F.lit(1), "repeated": F.lit(False), "generic_phrase": F.lit(False), "snippet": F.col("text"), "evidence_quote": F.lit(""),
            "title": F.lit("t"), "year": F.lit("y"), "venue": F.lit("v"), "extraction_confidence": F.when(F.col("n_chars") < 800, 0.5).otherwise(0.9), "confidence": F.lit(0.9),
            "uncertainty_flags": F.when(F.col("toxic") == 1, F.array(F.lit("ocr_noise"))).otherwise(F.array().cast("array<string>")),
            "false_positive_risk": F.when(F.col("quality") == 0, "high_generic").otherwise("low"), "primary_role": F.get(roles, (k % 4).cast("int")),
            "fallback_role": F.when(k % 3 == 0, "foundational_citation").when(k % 3 == 1, "historical_framing").otherwise(""), "stance": F.when(k % 6 == 5, "supportive").otherwise("unclear"),
        }
    )
    return T.audit(rows).select("doc_id", F.array_join("audit_flags", "|").alias("audit_flags"), "priority", "review_score")


@query("""WITH e AS (SELECT event_id, event_type, value, user_id, user_id % 4 AS m, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS risk FROM events)
SELECT event_id, (CASE WHEN event_type = 'click' THEN 100 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 85 ELSE 0 END)::INT AS issues, (CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END + least(user_id // 100, 3))::INT AS combined,
  (CASE WHEN event_type = 'click' THEN 100 ELSE 0 END + CASE WHEN m = 0 THEN 5 ELSE 0 END + greatest(0, CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END - 2))::INT AS recovery,
  (CASE m WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN event_type = 'click' THEN 8 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 6 ELSE 0 END + greatest(0, 10 - user_id))::INT AS gain FROM e""")
def worklist_scores(spark: SparkSession, d: str) -> DataFrame:
    """The other score tables of worklists, over events that stand for reviewed rows."""
    m, kind = F.col("user_id") % 4, F.col("event_type")
    e = table(spark, d, "events", "event_id", "event_type", "user_id").withColumns(
        {
            "reason": F.when(kind == "click", "ocr_noise").when(kind == "purchase", "bibliography_only").otherwise(""), "risk": F.when(m == 0, "high").when(m == 1, "medium").when(m == 2, "low").otherwise(""),
            "expected_likely_improvement": kind == "click", "previous_gray_zone_membership": F.lit("no"), "historical_foundational_ambiguity": F.lit(""), "modeling_ambiguity": F.lit(None).cast("string"),
            "recovery_status": F.when(m == 0, "recovered").otherwise("x"), "evidence_quality_before": F.lit("low_short_context"), "evidence_quality_after": F.when(m == 0, "high").when(m == 1, "medium").when(m == 2, "low").otherwise(""),
            "category": F.lit(""), "place": F.col("user_id"), "stratum": F.when(kind == "purchase", "bibliography_only").otherwise("x"),
        }
    )
    return e.select(
        "event_id", T.issue_score("reason").alias("issues"), T.combined_priority(["risk"], "user_id").alias("combined"), T.recovery_score().alias("recovery"),
        T.information_gain("risk", "CASE WHEN reason = 'ocr_noise' THEN reason ELSE '' END", "category", "stratum", "place").alias("gain"),
    )


_ROLES = "['historical_framing', 'foundational_citation', 'modeling_simulation_reference', 'unclear']"


@query(f"""WITH r AS (SELECT doc_id, {_ROLES}[doc_id % 4 + 1] AS a, {_ROLES}[(doc_id // 4) % 4 + 1] AS b FROM labels),
k AS (SELECT *, left(a, position('_' IN a || '_') - 1) || '_to_' || left(b, position('_' IN b || '_') - 1) AS pair FROM r)
SELECT doc_id, CASE WHEN a = b THEN 'agreement' WHEN pair = 'historical_to_foundational' THEN 'false_historical' WHEN pair = 'foundational_to_historical' THEN 'false_foundational' WHEN b = 'unclear' THEN 'human_unclear' ELSE 'other_disagreement' END AS packet_a,
  CASE WHEN a = b THEN 'agreement' WHEN pair IN ('historical_to_foundational', 'historical_to_modeling', 'historical_to_unclear', 'foundational_to_historical', 'foundational_to_modeling') THEN pair WHEN b = 'unclear' THEN 'router_to_unclear' ELSE 'other' END AS packet_b,
  CASE WHEN a = b THEN 'agreement' WHEN pair IN ('historical_to_foundational', 'historical_to_modeling', 'historical_to_unclear', 'foundational_to_historical', 'foundational_to_modeling', 'foundational_to_unclear') THEN pair ELSE 'other' END AS packet_c,
  CASE WHEN a = b THEN 'agreement' WHEN pair IN ('modeling_to_foundational', 'modeling_to_unclear', 'foundational_to_modeling') THEN pair ELSE 'other' END AS modeling,
  CASE WHEN a = b THEN 'agreement' WHEN pair = 'modeling_to_unclear' THEN pair ELSE a || '_to_' || b END AS by_role FROM k""")
def disagreement_types(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select(
        "doc_id",
        *[T.disagreement_type("router", "human", names).alias(c) for c, names in (("packet_a", T.FALSE_ROLES), ("packet_b", T.ROLE_TURNS), ("packet_c", T.FINAL_TURNS), ("modeling", T.MODELING_TURNS))],
        T.named_turn("router", "human").alias("by_role"),
    )


def _routed(spark: SparkSession, d: str) -> DataFrame:
    roles = F.array(*map(F.lit, ("historical_framing", "foundational_citation", "modeling_simulation_reference", "unclear")))
    k = F.col("doc_id")
    return table(spark, d, "labels", "doc_id").select("doc_id", F.get(roles, (k % 4).cast("int")).alias("router"), F.get(roles, (F.floor(k / 4) % 4).cast("int")).alias("human"))


@query(f"""WITH r AS (SELECT {_ROLES}[doc_id % 4 + 1] AS a, {_ROLES}[(doc_id // 4) % 4 + 1] AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b)::DOUBLE AS s FROM r),
t AS (SELECT left(a, position('_' IN a || '_') - 1) || '_to_' || left(b, position('_' IN b || '_') - 1) AS pair FROM r WHERE a <> b)
SELECT 'total_adjudicated' AS metric, n AS value FROM n UNION ALL SELECT 'agreement_count', s FROM n UNION ALL SELECT 'agreement_rate', round(s / n, 4) FROM n UNION ALL SELECT 'disagreement_count', n - s FROM n UNION ALL SELECT 'disagreement_rate', round((n - s) / n, 4) FROM n
UNION ALL SELECT 'human_' || b || '_count', count(*) FROM r GROUP BY 1 UNION ALL SELECT 'router_' || a || '_count', count(*) FROM r GROUP BY 1
UNION ALL SELECT p, count(*) FILTER (WHERE pair = p) FROM t, (SELECT unnest(['historical_to_foundational', 'historical_to_modeling', 'historical_to_unclear', 'foundational_to_historical', 'foundational_to_modeling', 'foundational_to_unclear']) AS p) GROUP BY 1
UNION ALL SELECT 'other', count(*) FILTER (WHERE pair LIKE 'modeling%' OR pair LIKE 'unclear%') FROM t""")
def packet_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.disagreement_summary(_routed(spark, d), "router", "human", T.FINAL_TURNS)


@query("""SELECT source AS stratum, count(*) AS total_rows, count(quality) AS human_coded_rows, count(*) - count(quality) AS unresolved_rows, round(count(quality) / count(*), 4) AS human_coded_coverage,
  CASE WHEN count(quality) / count(*) >= 0.8 THEN 'well_covered_for_internal_audit' WHEN count(quality) / count(*) >= 0.4 THEN 'partially_covered' WHEN count(quality) = 0 THEN 'not_yet_human_coded' ELSE 'under_validated' END AS validation_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def validation_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return T.validation_coverage(rows, "source", F.col("quality").isNotNull())


@query(r"""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER o AS b, lead(text) OVER o AS a FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '-' || turn AS k, length(text) AS old_snippet_length, length(concat_ws(' ', nullif(b, ''), nullif(text, ''), nullif(a, ''))) AS new_context_length, trim(coalesce(text, '')) <> '' AS citation_sentence_exists, trim(coalesce(b, '')) <> '' AS sentence_before_exists, trim(coalesce(a, '')) <> '' AS sentence_after_exists, false AS section_heading_exists,
  turn % 2 = 0 AS old_bibliography_detected, contains(text, '1') AS new_bibliography_detected, (turn % 2 = 0) <> contains(text, '1') AS bibliography_detection_changed, 0.5::DOUBLE AS old_extraction_confidence, 0.75::DOUBLE AS new_extraction_confidence, 0.25::DOUBLE AS extraction_confidence_change FROM w""")
def extraction_changes(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations", "conv_id", "turn", "text").withColumn("k", F.concat_ws("-", "conv_id", "turn"))
    old = turns.select("k", F.col("text").alias("snippet"), F.when(F.col("turn") % 2 == 0, "BIBLIO").otherwise("BODY").alias("section"), F.lit(0.5).alias("confidence"))
    new = X.three_windows(turns, "conv_id", "turn", "text").select(
        F.concat_ws("-", "conv_id", "turn").alias("k"), F.col("context_text").alias("context_window"), "citing_sentence", "sentence_before", "sentence_after",
        F.lit(None).cast("string").alias("section_heading"), F.contains("citing_sentence", F.lit("1")).alias("bibliography_detected"), F.lit(0.75).alias("confidence"),
    )
    return T.extraction_changes(old, new, "k")


@query()
def recover_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of turns whose neighbours are missing, rebuilt from the raw text; needs look-behind, which SQL lacks."""
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    none = F.lit(None).cast("string")
    rows = conv.withColumns({"citing": F.when(F.col("turn") % 2 == 0, none).otherwise(F.get(F.split("text", r"(?<=[.!?])\s+"), F.lit(0))), "before": none, "after": none})
    out = T.repair_context(rows, "text", "citing", "before", "after", "the|der|que", F.lit(False))
    return out.select("conv_id", "turn", "recoverability", "quality_before", "quality_after", "expected_effect", "repaired_window")


@query("""WITH c AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderpriority AS cell, count(*) AS raw, count(*) FILTER (WHERE o_orderstatus <> 'O') AS attempted, count(*) FILTER (WHERE o_orderstatus <> 'O' AND o_totalprice > 300000) AS yielded FROM orders GROUP BY 1)
SELECT cell, raw, attempted, yielded, CASE WHEN raw < 20 THEN 'thin_census' WHEN attempted = 0 THEN 'not_attempted' WHEN yielded / attempted < 0.05 THEN 'access_limited' WHEN yielded / attempted >= 0.25 THEN 'adequate' ELSE 'partial' END AS diagnosis FROM c""")
def census_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    tried = F.col("o_orderstatus") != "O"
    cells = o.groupBy(F.concat_ws("-", F.year("o_orderdate").cast("string"), "o_orderpriority").alias("cell")).agg(
        F.count("*").alias("raw"), F.count_if(tried).alias("attempted"), F.count_if(tried & (F.col("o_totalprice") > 300000)).alias("yielded")
    )
    return cells.withColumn("diagnosis", T.census_diagnosis(F.col("raw"), F.col("attempted"), F.col("yielded")))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'brand' WHEN contains(lower(p_name), 'red') AND contains(lower(p_type), 'promo') THEN 'title_author' WHEN contains(lower(p_name), 'red') AND abs(p_size - 20) <= 2 THEN 'title_year' END AS reason FROM part""")
def seed_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    reason = T.seed_reason({"brand": (F.col("p_brand"), "Brand#1")}, F.col("p_name"), ["red"], F.col("p_type"), "promo", F.col("p_size"), 20)
    return p.select("p_partkey", reason.alias("reason"))


@query("""WITH n AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT * FROM (VALUES ('F', 16, 20, true), ('O', 15, 28, false)) v(status, k, o, adjust))
SELECT n.status, n, round(k / o, 6) AS rate, CASE WHEN adjust THEN round(n * (k / o), 1) END AS adjusted FROM n LEFT JOIN m ON n.status = m.status""")
def precision_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderstatus").withColumnRenamed("o_orderstatus", "status")
    return T.adjusted_counts(rows, "status", [("F", 16, 20, True), ("O", 15, 28, False)])


@query("""WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS q, CASE WHEN toxic = 1 THEN 'toxic' END AS s FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'good' END AS q, CASE WHEN doc_id % 7 = 0 THEN 'clean' ELSE 'toxic' END AS s FROM labels)
SELECT a.doc_id, a.q AS "q_A", b.q AS "q_B", a.s AS "s_A", b.s AS "s_B", a.q <> b.q AS q_disagree, coalesce(a.s <> b.s, false) AS s_disagree, '' AS adjudicated_q, '' AS adjudicated_s, '' AS adjudication_notes FROM a JOIN b ON a.doc_id = b.doc_id WHERE a.q <> b.q OR coalesce(a.s <> b.s, false)""")
def coder_disagreements(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    a = lab.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("q"), F.when(F.col("toxic") == 1, "toxic").alias("s"))
    b = lab.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "bad").otherwise("good").alias("q"), F.when(F.col("doc_id") % 7 == 0, "clean").otherwise("toxic").alias("s"))
    return T.disagreements(a, b, "doc_id", ["q", "s"])
