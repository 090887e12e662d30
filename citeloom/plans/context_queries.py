"""Further normalisation, extraction, linkage and validation queries over parts, documents, labels, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import normalize as N
from citeloom.functions import text as X
from citeloom.operators import contexts, linkage, stats
from citeloom.operators import rules as R
from citeloom.operators import triage as T
from citeloom.plans.corpus_queries import _LEADERS
from citeloom.plans.registry import query, table
from citeloom.plans.scratch import Tables

CUES = R.SeedCues(author=r"\blicense\b", title=r"\bapache\b|\bmit\b", year=r"\b(2\.0|version)\b", group=r"\breleased\b")


@query(r"""SELECT p_partkey, '10.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '/', '')) AS doi, nullif(trim(regexp_replace(lower(p_name || '; ' || p_brand), '[^a-z,; ]+', ' ', 'g')), '') AS author_key, 'W' || p_partkey AS openalex,
  CASE WHEN p_size < 10 THEN 'article' WHEN p_size < 20 THEN 'book_or_chapter' WHEN p_size < 30 THEN 'grey' ELSE 'other' END AS type_class, 'a' || p_size % 3 || CASE WHEN p_size % 3 <> p_size % 2 THEN '|a' || p_size % 2 ELSE '' END AS flags,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS first_present, format('{:,}', p_partkey * 1000) AS shown, CASE WHEN p_retailprice % 1 < 0.5 THEN '0.50-0.64' ELSE '0.65-0.79' END AS confidence FROM part""")
def normalize_more(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    kind = F.when(F.col("p_size") < 10, "Review").when(F.col("p_size") < 20, "monograph").when(F.col("p_size") < 30, "preprint").otherwise("dataset")
    raw = F.concat(F.lit("a"), F.col("p_size") % 3, F.lit("|none||a"), F.col("p_size") % 2)
    safe = F.concat(F.lit("10_"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_")))
    p = p.withColumn("first", F.lit(None).cast("string")).withColumn("second", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    return p.select(
        "p_partkey", N.doi_from_safe_id(safe).alias("doi"), N.normalize_author_key(F.concat_ws("; ", "p_name", "p_brand")).alias("author_key"),
        N.openalex_id(F.concat(F.lit("https://openalex.org/w"), "p_partkey")).alias("openalex"), N.collapse_type(kind).alias("type_class"), F.array_join(N.split_flags(raw), "|").alias("flags"),
        N.coalesce_columns(p, ["absent", "first", "second"]).alias("first_present"), N.display_count(F.col("p_partkey") * 1000).alias("shown"),
        N.confidence_bin(F.when(F.col("p_retailprice") % 1 < 0.5, 0.6).otherwise(0.7)).alias("confidence"),
    )


@query(r"""WITH w AS (SELECT d.doc_id, text, lower(text) AS t FROM documents d), f AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM w)
SELECT doc_id, (CASE WHEN regexp_matches(p, '^(references|bibliography|works\s+cited|literature\s+cited)\b') THEN 3 ELSE 0 END + CASE WHEN len(regexp_extract_all(p, '\b(19|20)\d{2}\b')) >= 5 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(p, ',')) >= 20 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(p, '\b10\.\d{4,9}/')) >= 2 THEN 1 ELSE 0 END)::INT AS page_score,
  contains(t, 'r r') OR contains(t, 'ev ') OR len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{1,2}$'))) > 20 AS maybe_ocr, doc_id % 5 > 1 AND doc_id % 3 > 0 AS substantive FROM f""")
def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Page bibliography score, broken words and the substantive corpus."""
    docs = table(spark, d, "documents", "doc_id", "text")
    function = F.when(F.col("doc_id") % 3 == 0, "unclear").otherwise("critique")
    return docs.select(
        "doc_id", R.page_bibliography_score(F.col("text")).alias("page_score"), T.ocr_indicator(F.col("text"), F.lit(False)).alias("maybe_ocr"),
        T.is_substantive(function, F.col("doc_id") % 5).alias("substantive"),
    )


@query()
def page_anchor_hits(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of all pages (documents, by turn of their lines); sentence windows need look-behind, which SQL lacks."""
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    out = contexts.page_hits(lines, r"\blicense\b", CUES)
    return out.select(
        "doc_id", "page", "start", "match", "snippet", "sentence_before", "citation_sentence", "sentence_after", "section_heading", "semantic_label", "citation_section", "score"
    )


@query(r"""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS context_text, false AS context_window_complete, 's2_precomputed_context_unverified' AS context_window_status FROM conversations""")
def snippet_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = X.snippet_window(table(spark, d, "conversations", "conv_id", "turn", "text"), "text")
    return rows.select("conv_id", "turn", "context_text", "context_window_complete", "context_window_status")


@query()
def early_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents as works: a source stands for a DOI in some, the first words are the title; greedy groups have no SQL."""
    # the words before the seventh: whole texts are neither lowered nor split
    head = F.regexp_extract("text", r"^ *\S*(?:\s+\S*){0,5}", 0)
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source").withColumn("head", head)
    title = F.nullif(F.array_join(F.slice(F.split(F.trim(F.lower("head")), r"\s+", 7), 1, 6), " "), F.lit(""))
    doi = F.when(F.col("doc_id") % 10 == 0, F.concat_ws("/", F.lit("10"), "source", "lang"))
    works = docs.select("doc_id", doi.alias("doi"), title.alias("title"), F.when(F.col("doc_id") % 4 != 0, F.floor(F.col("doc_id") / 100)).cast("int").alias("year"))
    out = linkage.early_duplicates(works, "doi", "title", "year", "doc_id", Tables(spark, "early"), "doc_id")
    return out.select("doc_id", "duplicate_group", "is_duplicate")


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS doi, nullif(trim(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '') AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 3 END AS year FROM part),
n AS MATERIALIZED (SELECT title, year, row_number() OVER (ORDER BY year NULLS LAST, title) AS id FROM (SELECT DISTINCT title, year FROM w WHERE doi IS NULL AND title IS NOT NULL)), nodes AS (SELECT id FROM n),
e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id < y.id AND (x.year = y.year OR x.year IS NULL OR y.year IS NULL) WHERE jaro_similarity(x.title, y.title) >= 0.92),
{_LEADERS}, r AS (SELECT leader, row_number() OVER (ORDER BY leader) AS place FROM (SELECT DISTINCT leader FROM l)), t AS (SELECT title, year, 'title:' || place AS grp FROM n JOIN l USING (id) JOIN r USING (leader)),
o AS (SELECT p_partkey, coalesce('doi:' || doi, grp, p_partkey::VARCHAR) AS duplicate_group FROM w LEFT JOIN t ON doi IS NULL AND w.title = t.title AND w.year IS NOT DISTINCT FROM t.year)
SELECT p_partkey, duplicate_group, row_number() OVER (PARTITION BY duplicate_group ORDER BY p_partkey) > 1 AS is_duplicate FROM o""")
def part_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as works: whole names are titles, sizes are years, a brand stands for a DOI in some."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    works = p.select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")).alias("doi"), N.normalize_title(F.col("p_name")).alias("title"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 3).alias("year"),
    )
    out = linkage.early_duplicates(works, "doi", "title", "year", "p_partkey", Tables(spark, "parts"), "p_partkey")
    return out.select("p_partkey", "duplicate_group", "is_duplicate")


@query("""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS doi, lang FROM documents),
c AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN doc_id % 2 = 0 THEN 'fuzzy:' || (doc_id // 10 * 10) ELSE 'singleton:' || doc_id END AS cluster_id FROM w),
k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 1.0 WHEN doc_id % 2 = 1 THEN 0.5 WHEN doc_id % 10 = 0 THEN 0.75 ELSE 0.95 END::DOUBLE AS k, CASE WHEN doi IS NOT NULL THEN 'exact_doi' WHEN doc_id % 2 = 1 THEN 'insufficient_metadata_singleton' WHEN doc_id % 10 = 0 THEN 'title_author_year_singleton' ELSE 'fuzzy_title_author_year' END AS m FROM c)
SELECT cluster_id, count(*) AS n_records, min(k) AS dedup_confidence_min, array_to_string(list_sort(list(DISTINCT m)), '; ') AS dedup_methods, array_to_string(list_sort(list(DISTINCT lang)), ' | ') AS titles, coalesce(array_to_string(list_sort(list(DISTINCT doi) FILTER (WHERE doi IS NOT NULL)), ' | '), '') AS dois, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ' | ') AS record_ids FROM k GROUP BY 1""")
def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "documents", "doc_id", "lang", "source").withColumn("doi", F.when(F.col("doc_id") % 3 == 0, F.col("source")))
    ids = works.where("doi is null and doc_id % 2 = 0").select(F.col("doc_id").alias("id"), (F.floor(F.col("doc_id") / 10) * 10).cast("long").alias("leader"))
    scored = ids.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"), F.lit(0.95).alias("score"))
    rows = linkage.attributed_clusters(works, "doc_id", "doi", "lang", ids, scored)
    return linkage.cluster_summary(rows, "cluster_id", "doc_id", "lang", "doi")


@query(f"""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus = 'F' AS oa, count(*) AS N, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS tried, count(*) FILTER (WHERE o_orderkey % 4 = 0 AND o_totalprice > 200000) AS k FROM orders GROUP BY 1, 2),
g AS (SELECT 'naive_overall_rate' AS estimator, '' AS cell, sum(N) AS census, sum(tried) AS n, sum(k) AS k FROM c UNION ALL SELECT 'stratified', p, sum(N), sum(tried), sum(k) FROM c GROUP BY 2 UNION ALL SELECT 'marginal_only', oa::VARCHAR, sum(N), sum(tried), sum(k) FROM c GROUP BY 2),
w AS (SELECT *, k / n AS r, 3.8414588206941227 AS z2 FROM g WHERE n > 0), v AS (SELECT *, (r + z2 / (2 * n)) / (1 + z2 / n) AS mid, 1.959963984540054 * sqrt(r * (1 - r) / n + z2 / (4.0 * n * n)) / (1 + z2 / n) AS half FROM w)
SELECT estimator, round(sum(census * r), 4)::DOUBLE AS point, round(sum(census * greatest(0, mid - half)), 4)::DOUBLE AS low, round(sum(census * least(1, mid + half)), 4)::DOUBLE AS high FROM v GROUP BY 1""")
def estimator_comparison(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    tried = F.col("o_orderkey") % 4 == 0
    cells = o.groupBy("o_orderpriority", (F.col("o_orderstatus") == "F").alias("oa")).agg(
        F.count("*").alias("census"), F.count_if(tried).alias("n"), F.count_if(tried & (F.col("o_totalprice") > 200000)).alias("k")
    )
    return stats.estimator_comparison(cells, "o_orderpriority", "oa")


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Human labels with gaps, a model's and a rule's, over the labelled documents."""
    k = F.col("doc_id")
    return table(spark, d, "labels").select(
        "doc_id", F.when(k % 5 == 0, " ").otherwise(F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("h_role"), F.when(k % 3 == 0, "pos").when(k % 3 == 1, "neg").alias("h_stance"),
        F.when(k % 4 == 0, "bad").otherwise("good").alias("m_role"), F.when(k % 2 == 0, "pos").otherwise("neg").alias("m_stance"), F.when(k % 6 == 0, "bad").otherwise("good").alias("f_role"), (F.col("toxic") == 1).alias("review"),
    )


_SIDES = """s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'good' ELSE 'bad' END AS h_role, CASE doc_id % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' END AS h_stance, CASE WHEN doc_id % 4 = 0 THEN 'bad' ELSE 'good' END AS m_role, CASE WHEN doc_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS m_stance,
  CASE WHEN doc_id % 6 = 0 THEN 'bad' ELSE 'good' END AS f_role, toxic FROM labels), l AS (SELECT * FROM s WHERE h_role IS NOT NULL OR h_stance IS NOT NULL)"""


def _comparison(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return stats.validation_comparison(
        _sides(spark, d), {"primary_role": "h_role", "stance": "h_stance"}, {"primary_role": "m_role", "stance": "m_stance"}, {"primary_role": "f_role"}, F.col("review")
    )


@query(f"""WITH {_SIDES} SELECT 'human_labels_available' AS metric, count(*)::DOUBLE AS value FROM l UNION ALL SELECT 'primary_role_agreement_rate', round(avg(CASE WHEN h_role IS NOT NULL THEN (h_role = m_role)::INT END), 6) FROM l
UNION ALL SELECT 'stance_agreement_rate', round(avg(CASE WHEN h_stance IS NOT NULL THEN (h_stance = m_stance)::INT END), 6) FROM l UNION ALL SELECT 'llm_abstention_or_review_rate_labeled', round(avg((toxic = 1)::INT), 6) FROM l
UNION ALL SELECT 'fallback_llm_rows_available', count(*) FROM s UNION ALL SELECT 'fallback_llm_primary_role_agreement_rate', round(avg((f_role = m_role)::INT), 6) FROM s UNION ALL SELECT 'fallback_llm_llm_review_rate', round(avg((toxic = 1)::INT), 6) FROM s""")
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    tables = _comparison(spark, d)
    return tables["summary"].unionByName(tables["fallback_summary"])


@query(f"""WITH {_SIDES} SELECT 'primary_role' AS comparison, h_role AS truth, m_role AS predicted, count(*) AS n FROM l WHERE h_role IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'stance', h_stance, m_stance, count(*) FROM l WHERE h_stance IS NOT NULL GROUP BY 2, 3""")
def validation_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)["confusion"]


@query(f"""WITH {_SIDES} SELECT doc_id FROM l WHERE coalesce(h_role <> m_role, false) OR coalesce(h_stance <> m_stance, false)""")
def validation_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)["disagreements"].select("doc_id")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE a <> b) AS differ, count(*) AS n, sum((a = 'good')::INT + (b = 'good')::INT) AS g FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN doc_id % 9 = 0 THEN 'bad' ELSE 'good' END AS b FROM labels WHERE doc_id % 5 <> 0)),
x AS (SELECT n, 1 - (2 * differ) * (2 * n - 1) / (2.0 * g * (2 * n - g)) AS alpha FROM c)
SELECT 'function' AS axis, 'nominal' AS method, n AS n_units_both_labeled, round(alpha, 4) AS alpha_point, CASE WHEN alpha >= 0.8 THEN 'reliable' WHEN alpha >= 0.667 THEN 'tentative' ELSE 'unreliable' END AS threshold FROM x
UNION ALL SELECT 'depth', 'ordinal', 0, NULL, 'INSUFFICIENT_DATA'""")
def axis_alpha(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    both = table(spark, d, "labels").select(
        "doc_id", F.when(k % 5 == 0, "").otherwise(F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("function_A"), F.when(k % 9 == 0, "bad").otherwise("good").alias("function_B"),
        F.lit("").alias("depth_A"), F.lit("low").alias("depth_B"),
    )
    return stats.axis_alpha(both, "doc_id", {"function": ("nominal", None), "depth": ("ordinal", ["low", "high"])})


def _scores_sql(source: str, tasks: list[tuple[str, str, str]]) -> str:
    """Precision and recall of tasks (name, truth, predicted) over rows of a table."""
    one = """SELECT '{0}' AS task, label, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM (
  SELECT label, count(*) FILTER (WHERE {1} = label AND {2} = label) AS tp, count(*) FILTER (WHERE {1} <> label AND {2} = label) AS fp, count(*) FILTER (WHERE {1} = label AND {2} <> label) AS fn
  FROM {3} JOIN (SELECT DISTINCT unnest([{1}, {2}]) AS label FROM {3} WHERE {1} IS NOT NULL AND {2} IS NOT NULL) ON {1} IS NOT NULL AND {2} IS NOT NULL GROUP BY label)"""
    return " UNION ALL ".join(one.format(*t, source) for t in tasks)


@query(f"WITH {_SIDES} {_scores_sql('l', [('primary_role', 'h_role', 'm_role'), ('stance', 'h_stance', 'm_stance')])}")
def validation_scores(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)["metrics"]


@query(f"WITH {_SIDES} {_scores_sql('l', [('primary_role', 'h_role', 'f_role')])}")
def validation_fallback_scores(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)["human_fallback_metrics"]


@query(f"""WITH {_SIDES} SELECT 'fallback' AS side, 'primary_role' AS comparison, f_role AS truth, m_role AS predicted, count(*) AS n FROM s GROUP BY 3, 4
UNION ALL SELECT 'human', 'primary_role', h_role, f_role, count(*) FROM l WHERE h_role IS NOT NULL GROUP BY 3, 4""")
def validation_fallback_confusion(spark: SparkSession, d: str) -> DataFrame:
    made = _comparison(spark, d)
    named = [made[t].withColumn("side", F.lit(side)) for t, side in (("fallback_confusion", "fallback"), ("human_fallback_confusion", "human"))]
    return named[0].unionByName(named[1])


@query("""WITH r AS (SELECT doc_id AS u, doc_id % 3 AS a, CASE WHEN doc_id % 7 = 0 THEN (doc_id + 1) % 3 ELSE doc_id % 3 END AS b FROM labels WHERE doc_id % 11 <> 0), v AS (SELECT a AS v FROM r UNION ALL SELECT b FROM r), m AS (SELECT v, count(*) AS n FROM v GROUP BY 1),
k AS (SELECT v, sum(n) OVER (ORDER BY v) - n / 2.0 AS mid, n FROM m), o AS (SELECT sum(2 * power(x.mid - y.mid, 2)) AS o, count(*) AS units FROM r JOIN k x ON x.v = a JOIN k y ON y.v = b),
e AS (SELECT sum(x.n * y.n * power(x.mid - y.mid, 2)) AS e FROM k x, k y), z AS (SELECT units, 1 - o * (2 * units - 1) / e AS alpha FROM o, e)
SELECT 'depth' AS axis, 'ordinal' AS method, units AS n_units_both_labeled, round(alpha, 4)::DOUBLE AS alpha_point, CASE WHEN alpha >= 0.8 THEN 'reliable' WHEN alpha >= 0.667 THEN 'tentative' ELSE 'unreliable' END AS threshold FROM z""")
def axis_alpha_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """An ordinal axis with labels out of alphabetical order, some blank."""
    k, names = F.col("doc_id"), F.array(F.lit("surface"), F.lit("middle"), F.lit("deep"))
    one = F.get(names, (k % 3).cast("int"))
    two = F.get(names, F.when(k % 7 == 0, (k + 1) % 3).otherwise(k % 3).cast("int"))
    both = table(spark, d, "labels", "doc_id").select("doc_id", F.when(k % 11 == 0, " ").otherwise(one).alias("depth_A"), two.alias("depth_B"))
    return stats.axis_alpha(both, "doc_id", {"depth": ("ordinal", ["surface", "middle", "deep"])})
