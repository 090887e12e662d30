"""Networks and diffusion over orders: an order cites the parts and suppliers of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.normalize import decade, decade_of
from citeloom.functions.text import separate_rows
from citeloom.operators import diffusion, network
from citeloom.plans.registry import query, table

_EDGES = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"
_PAIRS = f"""e AS ({_EDGES}), p AS (
  SELECT a.l_partkey AS ref1, b.l_partkey AS ref2, count(*) AS n FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_partkey")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return network.cocitation(_edges(spark, d), "l_orderkey", "l_partkey")


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt by a key to the partitions of ``n`` lines: both sides of a join meet there."""
    return rows.repartition(network.shares(rows.sparkSession, n), key)


@query(f"WITH {_PAIRS} SELECT ref1, ref2, n FROM p ORDER BY n DESC, ref1, ref2 LIMIT 100")
def cocitation_top100(spark: SparkSession, d: str) -> DataFrame:
    return network.top_k(_pairs(spark, d), 100, (), F.desc("n"), "ref1", "ref2")


@query(f"WITH {_PAIRS} SELECT ref1, ref2, n FROM p WHERE n >= 3")
def cocitation_min3(spark: SparkSession, d: str) -> DataFrame:
    return network.at_least(_pairs(spark, d), 3)


@query(f"""WITH {_PAIRS}, c AS (SELECT l_partkey, count(*) AS cited FROM e GROUP BY 1)
SELECT ref1, ref2, n, round(n / sqrt(a.cited * b.cited), 6) AS strength FROM p JOIN c a ON a.l_partkey = ref1 JOIN c b ON b.l_partkey = ref2 WHERE n >= 2""")
def cocitation_strength(spark: SparkSession, d: str) -> DataFrame:
    pairs = network.at_least(_pairs(spark, d), 2)
    out = network.normalised_strength(pairs, _edges(spark, d), "l_orderkey", "l_partkey")
    return out.select("ref1", "ref2", "n", F.round("strength", 6).alias("strength"))


def _by(sql_from: str, name: str) -> str:
    return f"""WITH e AS (SELECT DISTINCT {name} AS grp, l_orderkey, l_suppkey FROM {sql_from}), p AS (
  SELECT a.grp, a.l_suppkey AS ref1, b.l_suppkey AS ref2, count(*) AS n FROM e a JOIN e b ON a.grp = b.grp AND a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2, 3)
SELECT grp AS {name.split('.')[-1] if '(' not in name else 'decade'}, ref1, ref2, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, ref1, ref2) AS rank FROM p) WHERE rank <= 20"""


@query(_by("lineitem JOIN orders ON l_orderkey = o_orderkey", "CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER)"))
def cocitation_by_decade_topk(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("l_orderkey"), decade(F.year("o_orderdate")).alias("decade"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    rows = lines.count()
    edges = _dealt(lines, "l_orderkey", rows).join(_dealt(orders, "l_orderkey", rows), "l_orderkey")
    pairs = network.cocitation(edges, "l_orderkey", "l_suppkey", ("decade",), rows=rows)
    return network.top_k(pairs, 20, ("decade",), F.desc("n"), "ref1", "ref2")


@query(_by("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", "c_mktsegment"))
def cocitation_by_field_topk(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    rows = lines.count()
    edges = _dealt(lines, "l_orderkey", rows).join(_dealt(orders, "o_orderkey", rows), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = network.cocitation(edges, "l_orderkey", "l_suppkey", ("c_mktsegment",), rows=rows)
    return network.top_k(pairs, 20, ("c_mktsegment",), F.desc("n"), "ref1", "ref2")


@query("""WITH e AS (SELECT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS work1, b.l_orderkey AS work2, count(*) AS n FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2""")
def bibliographic_coupling(spark: SparkSession, d: str) -> DataFrame:
    return network.coupling(_edges(spark, d), "l_orderkey", "l_partkey")


@query(f"""WITH {_PAIRS}, m AS (
  SELECT 'citing_works' AS metric, count(DISTINCT l_orderkey) AS value FROM e UNION ALL SELECT 'references', count(DISTINCT l_partkey) FROM e
  UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'pairs', count(*) FROM p UNION ALL SELECT 'total_weight', sum(n) FROM p
  UNION ALL SELECT 'max_weight', max(n) FROM p UNION ALL SELECT 'pair_nodes', count(DISTINCT r) FROM (SELECT ref1 AS r FROM p UNION ALL SELECT ref2 FROM p))
SELECT metric, value::BIGINT AS value FROM m""")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    return network.network_summary(_edges(spark, d), _pairs(spark, d), "l_orderkey", "l_partkey")


@query("""SELECT l_partkey, p_name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY n DESC, l_partkey LIMIT 50""")
def top_cited(spark: SparkSession, d: str) -> DataFrame:
    n = _edges(spark, d).distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "l_partkey").limit(50)
    return top.join(table(spark, d, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "p_name", "n")


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT decade, l_partkey, count(*) AS n FROM e GROUP BY 1, 2)
SELECT decade, l_partkey, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY n DESC, l_partkey) AS rank FROM n) WHERE rank <= 100""")
def top_cited_by_decade(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = _edges(spark, d), table(spark, d, "orders", "o_orderkey", "o_orderdate")
    rows = lines.count()
    e = _dealt(lines, "l_orderkey", rows).join(_dealt(orders, "o_orderkey", rows), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", decade(F.year("o_orderdate")).alias("decade")).distinct()
    return network.top_k(diffusion.counts(e, "decade", "l_partkey"), 100, ("decade",), F.desc("n"), "l_partkey")


@query("""SELECT l_partkey, count(DISTINCT l_orderkey) AS n_works, min(l_orderkey) AS first_work, max(l_orderkey) AS last_work
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1""")
def seed_edges(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "part", "p_partkey", "p_size").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return network.seed_edges(_edges(spark, d), seeds, "l_orderkey", "l_partkey")


@query("""WITH r AS (SELECT p_partkey AS w, unnest(string_split(replace(p_name, ' ', '; '), '; ')) AS ref FROM part)
SELECT w AS citing_work_id, ref AS cited_reference, lower(ref) AS cited_reference_key, 'export' AS reference_source FROM (SELECT DISTINCT w, ref FROM r WHERE ref <> '')""")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "part", "p_partkey", "p_name").withColumn("refs", F.replace("p_name", F.lit(" "), F.lit("; ")))
    return network.reference_edges(works, "p_partkey", "refs")


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1")
def yearly_growth(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.counts(table(spark, d, "orders", "o_orderdate").select(F.year("o_orderdate").alias("year")), "year")


@query("SELECT CASE WHEN year(o_orderdate) BETWEEN 1900 AND 2100 THEN (floor(year(o_orderdate) / 10) * 10)::INTEGER || 's' ELSE 'unknown' END AS decade, count(*) AS n FROM orders GROUP BY 1")
def decade_growth(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.counts(table(spark, d, "orders", "o_orderdate").select(decade_of(F.year("o_orderdate")).alias("decade")), "decade")


@query("""SELECT c_mktsegment, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def venue_by_decade(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return diffusion.counts(orders.select("c_mktsegment", decade(F.year("o_orderdate")).alias("decade")), "c_mktsegment", "decade")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.counts(table(spark, d, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


@query("SELECT word, p_type, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_type FROM part) GROUP BY 1, 2")
def field_diffusion_explode(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", "p_name", "p_type").withColumnRenamed("p_name", "word")
    return diffusion.counts(separate_rows(part, "word", " "), "word", "p_type")


@query("""WITH v AS (SELECT 'all' AS view, o_orderpriority, o_orderstatus FROM orders UNION ALL SELECT 'large', o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'late', o_orderpriority, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1999), n AS (SELECT view, o_orderpriority, o_orderstatus, count(*) AS n FROM v GROUP BY 1, 2, 3)
SELECT *, round(n / sum(n) OVER (PARTITION BY view, o_orderpriority), 6) AS share FROM n""")
def crosstab_share_views(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    views = [("all", F.lit(True)), ("large", F.col("o_totalprice") > 200000), ("late", F.year("o_orderdate") >= 1999)]
    return diffusion.crosstab_share(orders, "o_orderpriority", "o_orderstatus", views)


WILSON_SQL = """round({k} / {n}::DOUBLE, 6) AS rate,
  round(greatest(0, ({k} / {n}::DOUBLE + 3.8414588206941227 / (2 * {n}) - 1.959963984540054 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 3.8414588206941227 / (4.0 * {n} * {n}))) / (1 + 3.8414588206941227 / {n})), 6) AS ci_low,
  round(least(1, ({k} / {n}::DOUBLE + 3.8414588206941227 / (2 * {n}) + 1.959963984540054 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 3.8414588206941227 / (4.0 * {n} * {n}))) / (1 + 3.8414588206941227 / {n})), 6) AS ci_high"""


@query(f"""WITH g AS (SELECT o_orderpriority, (year(o_orderdate))::INTEGER AS year, count(*) AS attempted, count(*) FILTER (WHERE o_orderstatus = 'F') AS yielded, grouping(o_orderpriority, year(o_orderdate)) AS g
  FROM orders GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate)), (o_orderpriority), ()))
SELECT CASE g WHEN 0 THEN 'cell' WHEN 1 THEN 'o_orderpriority' ELSE 'all' END AS level, coalesce(o_orderpriority, 'ALL') AS o_orderpriority, coalesce(year::VARCHAR, 'ALL') AS year, attempted, yielded,
  {WILSON_SQL.format(k='yielded', n='attempted')} FROM g""")
def coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_orderstatus").withColumn("year", F.year("o_orderdate"))
    return diffusion.coverage(orders, F.col("o_orderstatus") == "F", "o_orderpriority", "year")


@query("""WITH x AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS s FROM orders),
n AS (SELECT year, count(*) FILTER (WHERE s = 'F') AS "n_F", count(*) FILTER (WHERE s = 'O') AS "n_O", count(*) FILTER (WHERE s = 'P') AS "n_P" FROM x GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'TOTAL', sum("n_F")::BIGINT, sum("n_O")::BIGINT, sum("n_P")::BIGINT FROM n""")
def census_pivot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderdate", "o_orderstatus").withColumn("year", F.year("o_orderdate"))
    return diffusion.pivot_counts(orders, "year", "o_orderstatus", ["F", "O", "P"])


@query("""WITH b AS (SELECT o_orderpriority, year(o_orderdate)::VARCHAR AS year, c_mktsegment, (o_orderstatus = 'F')::INTEGER AS y FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT 'priority' AS dimension, o_orderpriority AS level, y FROM b UNION ALL SELECT 'year', year, y FROM b UNION ALL SELECT 'segment', c_mktsegment, y FROM b),
n AS (SELECT dimension, level, count(*) AS n, sum(y)::BIGINT AS yielded FROM t GROUP BY 1, 2)
SELECT dimension, level, n, yielded, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share, round(yielded / n, 6) AS rate FROM n""")
def bias_profile_unpivot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    rows = orders.join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    dims = {"priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "segment": F.col("c_mktsegment")}
    return diffusion.long_profile(rows, F.col("o_orderstatus") == "F", dims)


@query("""WITH t AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT c_mktsegment FROM t ORDER BY n DESC, c_mktsegment LIMIT 3)
SELECT CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM k) THEN c_mktsegment ELSE 'other' END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.counts(diffusion.keep_levels(table(spark, d, "customer", "c_mktsegment"), "c_mktsegment", 3), "c_mktsegment")


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM n)
SELECT p_brand, string_agg(p_type || ':' || n, ' | ' ORDER BY r) AS top_values FROM r WHERE r <= 3 GROUP BY 1""")
def value_lists(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.value_list(table(spark, d, "part", "p_brand", "p_type"), "p_brand", "p_type", 3)
