"""Deterministic sampling by hashed order: the same rows for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: str | int, *keys: Column | str) -> Column:
    """The sort key of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def annotator_orders(rows: DataFrame, key: str, annotators: list[str], seed: str | int = 1) -> DataFrame:
    """Every annotator's own order of all rows: (annotator, key, place), places from 1."""
    tall = rows.select(F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator"), key)
    w = Window.partitionBy("annotator").orderBy(shuffled(seed, "annotator", key), key)
    return tall.withColumn("place", F.row_number().over(w))


def stratified_sample(rows: DataFrame, strata: list[str], n: int | Column, key: str, seed: str | int = 1) -> DataFrame:
    """``n`` rows of each stratum (all of a smaller one)."""
    w = Window.partitionBy(*strata).orderBy(shuffled(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def share_sample(rows: DataFrame, strata: list[str], share: float, least: int, key: str, seed: str | int = 1) -> DataFrame:
    """The larger of ``least`` rows and a share of each stratum."""
    sizes = rows.groupBy(*strata).agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).alias("_n"))
    return stratified_sample(rows.join(sizes, strata), strata, F.col("_n"), key, seed).drop("_n")


def allocate_quotas(pools: DataFrame, by: str, stratum: str, size: str, total: int) -> DataFrame:
    """``target`` for each stratum: equal quotas, what small strata can't fill dealt round to the others.

    The level t is the largest with sum(min(size, t)) <= total; what is left goes one each to the first
    strata that have more. All pools of a group are a few rows; the level is found from their order alone.
    """
    order = Window.partitionBy(by).orderBy(size, stratum)
    count = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(order)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # with this stratum as the smallest unfilled one, the others would share what is left
    level = F.floor((F.lit(total) - before) / (count - rank + 1))
    x = pools.select("*", rank.alias("_r"), level.alias("_level"))
    # strata up to the first that isn't filled are filled
    x = x.withColumn("_open", F.col(size) > F.col("_level"))
    first = F.min(F.when(F.col("_open"), F.struct("_r", "_level"))).over(Window.partitionBy(by))
    x = x.withColumn("_first", first)
    filled = F.col("_first").isNull() | (F.col("_r") < F.col("_first._r"))
    x = x.withColumn("_base", F.when(filled, F.col(size)).otherwise(F.col("_first._level")))
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy(by))
    x = x.withColumn("_left", left).withColumn("_more", F.col(size) > F.col("_base"))
    turn = F.row_number().over(Window.partitionBy(by, "_more").orderBy(stratum))
    extra = F.when(F.col("_more") & (turn <= F.col("_left")), 1).otherwise(0)
    return x.withColumn("target", (F.col("_base") + extra).cast("long")).drop("_r", "_level", "_open", "_first", "_base", "_left", "_more")


def preferred_fill(rows: DataFrame, by: str, preferred: Column, n: int, key: str, seed: str | int = 1) -> DataFrame:
    """``n`` rows of each group, preferred ones first."""
    w = Window.partitionBy(by).orderBy(F.when(preferred, 0).otherwise(1), shuffled(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fill_up(rows: DataFrame, chosen: DataFrame, key: str, n: int, seed: str | int = 1) -> DataFrame:
    """The chosen rows, filled to ``n`` from those not chosen."""
    taken = chosen.count()
    rest = rows.join(chosen.select(key), key, "left_anti").orderBy(shuffled(seed, key), key).limit(max(0, n - taken))
    return chosen.unionByName(rest.select(*chosen.columns))


def interleave(rows: DataFrame, stratum: str, key: str, batch: int, seed: str | int = 1) -> DataFrame:
    """Rows in turn from each stratum, with their place and batch number.

    A row of rank r stands behind min(size, r - 1) rows of every stratum and behind the rows of rank r of the strata
    before its own: its place follows from the strata's sizes alone, which are one row, so nothing is ordered together.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(seed, key), key)))
    sizes = rows.groupBy(F.col(stratum).alias("s")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("s", "n")).alias("_sizes"))
    behind = F.aggregate(
        "_sizes",
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.least(x["n"], F.col("_r") - 1) + F.when((x["n"] >= F.col("_r")) & (x["s"] <= F.col(stratum)), 1).otherwise(0),
    )
    out = ranked.crossJoin(F.broadcast(sizes)).withColumn("place", behind)  # one row: the strata's sizes
    return out.withColumn("batch", (F.floor((F.col("place") - 1) / batch) + 1).cast("long")).drop("_r", "_sizes")


def capped_selection(rows: DataFrame, group: str, score: Column, cap: int, n: int, key: str) -> DataFrame:
    """The ``n`` rows of best score, at most ``cap`` of a group: what a greedy pass with that cap selects."""
    w = Window.partitionBy(group).orderBy(score.desc(), key)
    return rows.withColumn("_c", F.row_number().over(w)).where(F.col("_c") <= cap).drop("_c").orderBy(score.desc(), key).limit(n)


def round_robin(rows: DataFrame, buckets: list[Column], group: str, order: str, n: int) -> DataFrame:
    """One row for each group, taken in turn from overlapping priority buckets: the loop over (index, bucket).

    Only the first rows of each bucket are numbered (each task keeps no more of them), four times as many
    again while they don't settle ``n`` groups.
    """
    named = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(buckets)]))
    tall = rows.select("*", F.explode(named).alias("_b"))
    most = 4 * n
    while True:
        some = tall.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(order))).where(F.col("_i") <= most)
        first = Window.partitionBy(group).orderBy("_i", "_b")
        one = some.withColumn("_f", F.row_number().over(first)).where(F.col("_f") == 1)
        out = one.orderBy("_i", "_b").limit(n).withColumnRenamed("_i", "pick_index").withColumnRenamed("_b", "pick_bucket").drop("_f")
        if out.count() == n or some.where(F.col("_i") == most).isEmpty():
            return out
        most *= 4


def first_pass(rows: DataFrame, passes: list[Column], group: str, order: str) -> DataFrame:
    """Each group's row from the first selection pass that it satisfies, with the pass number."""
    number = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(passes, 1)])
    w = Window.partitionBy(group).orderBy("pass", order)
    return rows.withColumn("pass", number).where("pass is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def sampling_manifest(rows: DataFrame, chosen: DataFrame, strata: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Pool, target and realised size of each stratum, with a shortfall flag."""
    pool = rows.groupBy(*strata).agg(F.count("*").alias("pool_size"))
    got = chosen.groupBy(*strata).agg(F.count("*").alias("realized_n"))
    out = pool.join(got, strata, "left").withColumn("realized_n", F.coalesce("realized_n", F.lit(0)))
    if targets is not None:
        out = out.join(targets.select(*strata, "target"), strata, "left")
        out = out.withColumn("flag", F.when(F.col("realized_n") < F.col("target"), "shortfall").otherwise("ok"))
    return out
