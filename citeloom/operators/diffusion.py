"""Diffusion tables: growth, crosstabs with shares, grouping sets, pivots and long profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.stats import wilson


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def crosstab_share(rows: DataFrame, group: str, level: str, views: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Counts and shares within a group, for each of some overlapping views (row subsets), in one pass.

    A row is repeated for the views it belongs to, so one aggregate makes all of them.
    """
    views = views or [("all", F.lit(True))]
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in views]))
    n = rows.select(F.explode(named).alias("view"), group, level).groupBy("view", group, level).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("view", group))
    return n.select("view", group, level, "n", F.round(F.col("n") / total, 6).alias("share"))


def coverage(rows: DataFrame, yielded: Column, first: str, second: str) -> DataFrame:
    """Attempts and yields by (first, second), by first and in all, with rate and Wilson interval, from one scan."""
    base = rows.select(first, second, yielded.cast("long").alias("y"))
    sets = base.groupingSets([[first, second], [first], []], first, second).agg(
        F.grouping_id().alias("g"), F.count("*").alias("attempted"), F.sum("y").alias("yielded")
    )
    w = wilson(F.col("yielded"), F.col("attempted"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, first).otherwise("all")
    return sets.select(
        level.alias("level"),
        F.coalesce(F.col(first).cast("string"), F.lit("ALL")).alias(first),
        F.coalesce(F.col(second).cast("string"), F.lit("ALL")).alias(second),
        "attempted",
        "yielded",
        *[F.round(c, 6).alias(n) for n, c in w.items()],
    )


def pivot_counts(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """One count column for each value, zero-filled, with a TOTAL row."""
    wide = rows.groupBy(F.col(row).cast("string").alias(row)).pivot(column, values).agg(F.count(F.lit(1)))
    wide = wide.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"n_{v}") for v in values])
    total = wide.agg(*[F.sum(f"n_{v}").alias(f"n_{v}") for v in values]).select(F.lit("TOTAL").alias(row), *[f"n_{v}" for v in values])
    return wide.unionByName(total)


def long_profile(rows: DataFrame, yielded: Column, dimensions: dict[str, Column]) -> DataFrame:
    """For every level of every dimension: count, share of the dimension, yields and rate, in one aggregate."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("level")) for n, c in dimensions.items()])
    tall = rows.select(F.explode(pairs).alias("p"), yielded.cast("long").alias("y")).select("p.dimension", "p.level", "y")
    n = tall.groupBy("dimension", "level").agg(F.count("*").alias("n"), F.sum("y").alias("yielded"))
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return n.select("dimension", "level", "n", "yielded", F.round(F.col("n") / total, 6).alias("share"), F.round(F.col("yielded") / F.col("n"), 6).alias("rate"))


def keep_levels(rows: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """The ``k`` commonest levels of a column stay, the rest become ``other``."""
    top = rows.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(k).select(column, F.lit(True).alias("_top"))
    kept = rows.join(F.broadcast(top), column, "left")  # k rows
    return kept.withColumn(column, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")


def value_list(rows: DataFrame, by: str, column: str, k: int = 5) -> DataFrame:
    """Each group's commonest values as one string ``value:count | value:count``."""
    n = rows.groupBy(by, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), column))
    few = n.withColumn("r", rank).where(F.col("r") <= k)
    item = F.struct("r", F.concat_ws(":", column, F.col("n").cast("string")).alias("s"))
    return few.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), " | ").alias("top_values"))
