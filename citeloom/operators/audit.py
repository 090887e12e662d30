"""Audit tables: upserts, latest rows, canonical members, scorecards, metrics, reconciliations, scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.normalize import context_key


def latest(rows: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """The last row of each key; a missing time counts as the latest."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_first(), *[F.desc(t) for t in ties])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def first_rows(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key under an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def upsert(rows: DataFrame, key: str, human: Column, length: Column, *order: str) -> DataFrame:
    """Evidence for each key: a human row (longest context, then order), else the first other row."""
    w = Window.partitionBy(key).orderBy(F.when(human, 0).otherwise(1), F.when(human, -length).otherwise(F.lit(0)), *order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def canonical_member(rows: DataFrame, group: str, rank: list[Column], keep: list[str], label: str) -> DataFrame:
    """Each group's member of highest rank with group size and whether its labels conflict."""
    x = rows.withColumn("_o", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]))
    best = F.max_by(F.struct(*keep), "_o").alias("m")
    out = x.groupBy(group).agg(best, F.count("*").alias("members"), (F.count_distinct(label) > 1).alias("label_conflict"))
    return out.select(group, *[F.col(f"m.{c}").alias(c) for c in keep], "members", "label_conflict")


def best_label(rows: DataFrame, key: str, label: str, confidence: str, ranks: dict[str, int], order: str) -> DataFrame:
    """The label of highest confidence rank; the first one on ties."""
    rank = F.coalesce(*[F.when(F.col(confidence) == c, F.lit(r)) for c, r in ranks.items()], F.lit(0))
    w = Window.partitionBy(key).orderBy(rank.desc(), order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def merge_routes(primary: DataFrame, secondary: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows of two routes by key: the primary's values first, the routes that have the key, and how many."""
    p = primary.withColumn("_p", F.lit(True))
    s = secondary.withColumn("_s", F.lit(True))
    values = [c for c in primary.columns if c not in keys]
    s = s.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in values], "_s")
    both = p.join(s, keys, "full_outer")
    has = [F.when(F.col(c), F.lit(n)) for c, n in (("_p", names[0]), ("_s", names[1]))]
    routes = F.array_compact(F.array(*has))
    return both.select(*keys, *[F.coalesce(c, f"_s_{c}").alias(c) for c in values], F.array_join(routes, "|").alias("routes"), F.size(routes).alias("n_routes"))


def edition_union(rows: DataFrame, keys: list[str], edition: str, order: str) -> DataFrame:
    """Set-wise union of editions: the first record's edition, all editions, and how many."""
    return rows.groupBy(*keys).agg(
        F.min_by(edition, order).alias("first_edition"),
        F.array_join(F.array_sort(F.collect_set(F.col(edition).cast("string"))), "|").alias("editions"),
        F.count_distinct(edition).alias("n_editions"),
    )


def scorecard(rows: DataFrame, stratum: str, rates: dict[str, Column], least_n: int, safe: dict[str, float]) -> DataFrame:
    """Rates of each stratum and whether it is safe to scale: enough rows and every named rate at its bound."""
    out = rows.groupBy(stratum).agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in rates.items()])
    ok = F.col("n") >= least_n
    for name, bound in safe.items():
        ok = ok & F.coalesce(F.col(name) >= bound, F.lit(False))
    return out.withColumn("safe_for_scale", ok)


def metric_table(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) rows of many aggregates from one pass."""
    one = rows.agg(*[F.round(c.cast("double"), 6).alias(n) for n, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")


def running_rate(rows: DataFrame, topic: str, order: list[str], hit: Column) -> DataFrame:
    """Each row with the rate among its topic's rows so far."""
    w = Window.partitionBy(topic).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.round(F.sum(hit.cast("double")).over(w) / F.count("*").over(w), 6).alias("running_rate"))


def pattern_scan(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each pattern stands: documents' line numbers and counts. Patterns are a fixed list, not a table."""
    found = [
        F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("pattern"), F.regexp_count("line", F.lit(p)).alias("hits"))) for n, p in patterns.items()
    ]
    some = docs.where(F.col(text_col).rlike("|".join(f"(?:{p})" for p in patterns.values())))
    lines = some.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = lines.select(id_col, (F.col("pos") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*found))).alias("m"))
    return rows.groupBy(id_col, F.col("m.pattern").alias("pattern")).agg(
        F.sum("m.hits").alias("hits"),
        F.array_join(F.transform(F.array_sort(F.collect_set("line_no")), lambda x: x.cast("string")), ",").alias("lines"),
    )


def reconcile_expected(expected: list[tuple[str, float]], found: DataFrame, key: str, value: str) -> DataFrame:
    """Expected against found figures with a match flag."""
    rows = found.sparkSession.createDataFrame(expected, f"{key} string, expected double")
    out = rows.join(found, key, "left")
    return out.select(key, "expected", F.col(value).cast("double").alias("found"), F.coalesce(F.abs(F.col("expected") - F.col(value)) < 1e-9, F.lit(False)).alias("matches"))


def partition_check(rows: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Counts of each class, and of rows that are in none or in several."""
    inside = sum((c.cast("int") for c in classes.values()), F.lit(0))
    return rows.agg(
        *[F.count_if(c).alias(n) for n, c in classes.items()], F.count_if(inside == 0).alias("in_none"), F.count_if(inside > 1).alias("in_several"), F.count("*").alias("total")
    )


def scenarios(base: DataFrame, rows: list[tuple[str, float, float]]) -> DataFrame:
    """Effort of a one-row base (n_full, n_audit) under some policies (name, seconds each)."""
    policy = base.sparkSession.createDataFrame(rows, "scenario string, seconds_full double, seconds_audit double")
    both = policy.crossJoin(F.broadcast(base))  # one row
    hours = (F.col("n_full") * F.col("seconds_full") + F.col("n_audit") * F.col("seconds_audit")) / 3600
    return both.select("scenario", F.round(hours, 4).alias("hours"))


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of union, intersection and both differences of two key sets."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full_outer")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count("*").alias("in_union"), F.count_if(x & y).alias("in_both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on several columns in which null equals null."""
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return left.join(r, same, "left").drop(*[f"_k_{k}" for k in keys])


def id_differences(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, difference): ids that are missing from what was found, and extra ones; none if the sets are equal."""
    a, b = wanted.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("difference", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("difference", F.lit("extra")))


def merge_contexts(primary: DataFrame, secondary: DataFrame, keys: list[str], sentence: str, order: str, names: tuple[str, str]) -> DataFrame:
    """Contexts of two routes by their keys and normalised sentence; of a route's repeated ones the last in order counts."""

    def last(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("sentence_key", context_key(F.col(sentence)))
        w = Window.partitionBy(*keys, "sentence_key").orderBy(F.desc(order))
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", order)

    return merge_routes(last(primary), last(secondary), [*keys, "sentence_key"], names)
