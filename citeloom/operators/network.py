"""Citation networks: reference edges, co-citation, bibliographic coupling, strengths and summaries.

Pairs come from equi-joins on the shared key. A key that many nodes share makes a quadratic number of pairs; that number is the
result here, so it is not capped, but spread: the nodes of a key of more than ``TILE`` are dealt to blocks of about that many, and each two
blocks are a tile of the triangle of pairs, which is what meets in a task. Pairs are dealt to as many partitions as their number needs, and counted there;
coupled works are counted where they meet, if their own references are fewer than the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.normalize import reference_key
from citeloom.functions.text import split_references


def reference_edges(works: DataFrame, work: str = "work_id", references: str = "cited_references", source: str = "export") -> DataFrame:
    """A row for each cited reference of each work."""
    rows = works.select(F.col(work).alias("citing_work_id"), F.explode(split_references(F.col(references))).alias("cited_reference"))
    return rows.select("*", reference_key(F.col("cited_reference")).alias("cited_reference_key"), F.lit(source).alias("reference_source")).distinct()


TILE = 512  # nodes of one key in a block
SHARE = 1 << 18  # rows or pairs in a partition, few enough for the five hash tables that a task of edges holds: tasks grow in number, not in memory, from a few million rows on
LISTED = 8  # references in the list of an edge's work, on average, up to which a partition of edges has SHARE of them


def shares(spark: SparkSession, rows: int) -> int:
    """The number of partitions for so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // SHARE))


def tiles(edges: DataFrame, by: list[str], node: str, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join over (by..., i, j) in which every two rows of a key meet once: block i's rows and block j's, i <= j."""
    size = edges.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > tile)
    dealt = edges.join(size, by, "left").select(*edges.columns, F.ceil(F.coalesce("_n", F.lit(1)) / tile).cast("int").alias("_blocks"))
    own = F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")).otherwise(0)
    dealt = dealt.withColumn("_own", own)
    low = dealt.select(*edges.columns, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    high = dealt.select(*edges.columns, F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    return low, high


def _counted_pairs(edges: DataFrame, within: list[str], key: str, node: str, first: str, second: str, tile: int) -> DataFrame:
    """Pairs of different nodes that share ``within`` and ``key``, the smaller one first, and how often: (within..., first, second, n), for ``edges`` dealt by these.

    The keys' sizes tell how many pairs there will be, and so how many partitions tiles and pairs are dealt to.
    """
    by, size = [*within, key], F.col("_n").cast("double")
    total = edges.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.sum(size * (size - 1) / 2)).first()[0]
    parts, at = shares(edges.sparkSession, int(total or 0)), [*by, "_i", "_j"]
    low, high = (side.withColumnRenamed(node, name).repartition(parts, *at) for side, name in zip(tiles(edges, by, node, tile), ("_x", "_y"), strict=True))
    both = low.join(high, at).where("_i < _j or _x < _y")
    pairs = both.select(*within, F.least("_x", "_y").alias(first), F.greatest("_x", "_y").alias(second))
    return pairs.repartition(parts, *within, first, second).groupBy(*within, first, second).agg(F.count("*").alias("n"))


def cocitation(edges: DataFrame, work: str, reference: str, by: tuple[str, ...] = (), tile: int = TILE, rows: int | None = None) -> DataFrame:
    """How many works cite both references (within equal ``by`` columns): (by..., ref1, ref2, n). ``rows``: of ``edges``, where that is known."""
    e = edges.select(*by, work, reference).where(F.col(work).isNotNull() & F.col(reference).isNotNull())
    e = e.repartition(shares(e.sparkSession, e.count() if rows is None else rows), *by, work).distinct()
    return _counted_pairs(e, list(by), work, reference, "ref1", "ref2", tile)


def coupling(edges: DataFrame, work: str, reference: str, tile: int = TILE, rows: int | None = None) -> DataFrame:
    """How many references two works share, repeated edges counted: (work1, work2, n).

    Works carry their references along, so a pair is counted where its first common reference is, and pairs never move. Where these lists
    are longer than the pairs are many, the pairs are dealt out and counted.
    """
    e = edges.select(reference, work).where(F.col(work).isNotNull() & F.col(reference).isNotNull())
    spark, size, heavy = e.sparkSession, F.col("_n").cast("double"), F.col("_n") > tile
    dealt = shares(spark, e.count() if rows is None else rows)
    counts = lambda key: e.repartition(dealt, key).groupBy(key).agg(F.count("*").alias("_n"))
    both, own = F.sum(size * (size - 1) / 2), F.sum(F.when(heavy, size * (size - 1) / 2))
    pairs, tiled, light = (int(x or 0) for x in counts(reference).agg(both, own, F.count_if(~heavy)).first())
    listed = int(counts(work).agg(F.sum(size * size)).first()[0] or 0)
    if listed > pairs:
        return _counted_pairs(e.repartition(dealt, reference), [], reference, work, "work1", "work2", tile)
    dealt = max(dealt, shares(spark, listed // LISTED))
    held = _with_lists(e.repartition(dealt, work), work, reference).repartition(dealt, reference)
    if not tiled:
        return _pairs_at_first(held, held, [reference], work, reference)
    at, parts, hot = [reference, "_i", "_j"], shares(spark, tiled), counts(reference).where(heavy).select(reference)
    low, high = (side.repartition(parts, *at) for side in tiles(held.join(hot, reference, "left_semi") if light else held, [reference], work, tile))
    found = _pairs_at_first(low, high, at, work, reference)
    if light:
        few = held.join(hot, reference, "left_anti")
        found = found.unionByName(_pairs_at_first(few, few, [reference], work, reference))
    return found


def _with_lists(edges: DataFrame, work: str, reference: str) -> DataFrame:
    """Distinct edges, for ``edges`` dealt by work, with how often each occurs, all references of the work, how often these do (null: once each), and a bit for each."""
    each = edges.groupBy(work, reference).agg(F.count("*").alias("_m"))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{reference}`), 64) as int))")
    lists = each.groupBy(work).agg(F.collect_list(F.struct(F.col(reference).alias("r"), F.col("_m").alias("m"))).alias("_all"), F.bit_or(bit).alias("_bits"), F.max("_m").alias("_most"))
    lists = lists.select(work, "_bits", F.col("_all.r").alias("_refs"), F.when(F.col("_most") > 1, F.col("_all.m")).alias("_times"), F.explode("_all").alias("_one"))
    return lists.select(F.col("_one.r").alias(reference), work, F.col("_one.m").alias("_m"), "_bits", "_refs", "_times")


def _pairs_at_first(low: DataFrame, high: DataFrame, at: list[str], work: str, reference: str) -> DataFrame:
    """(work1, work2, n) of rows of ``_with_lists`` that meet, each pair where the smallest of its common references is."""
    own = [work, "_m", "_bits", "_refs", "_times"]
    x, y = (side.select(*at, *[F.col(c).alias(f"{c}_{k}") for c in own]) for side, k in ((low, "x"), (high, "y")))
    first, second = F.col(f"{work}_x"), F.col(f"{work}_y")
    in_order = first < second if low is high else (F.col("_i") < F.col("_j")) | (first < second)
    # most pairs share this reference only: their bits tell, unless both have references of one bit
    merged = lambda k: F.size(f"_refs_{k}") > F.bit_count(f"_bits_{k}")
    several = (F.bit_count(F.col("_bits_x").bitwiseAND(F.col("_bits_y"))) > 1) | (merged("x") & merged("y"))
    common = F.when(several, F.array_intersect("_refs_x", "_refs_y"))
    both = x.join(y, at).where(in_order & (common.isNull() | (F.array_min(common) == F.col(reference))))
    times = lambda k, r: F.coalesce(F.get(F.col(f"_times_{k}"), (F.array_position(F.col(f"_refs_{k}"), r) - 1).cast("int")), F.lit(1).cast("long"))
    shared = F.aggregate(common, F.lit(0).cast("long"), lambda n, r: n + times("x", r) * times("y", r))
    n = F.when(F.size(common) > 1, shared).otherwise(F.col("_m_x") * F.col("_m_y"))
    return both.select(F.least(first, second).alias("work1"), F.greatest(first, second).alias("work2"), n.alias("n"))


def _distinct(edges: DataFrame, work: str, reference: str, rows: int | None) -> DataFrame:
    return edges.select(work, reference).repartition(shares(edges.sparkSession, edges.count() if rows is None else rows), work).distinct()


def _by_reference(edges: DataFrame, work: str, reference: str) -> DataFrame:
    """(reference, paired) of distinct edges that are dealt by work: whether a work that cites it cites another one too."""
    several = edges.groupBy(F.col(work).alias("_w")).agg((F.count(reference) >= 2).alias("_several"))
    each = edges.join(several, F.col(work) == F.col("_w"), "left").select(reference, F.coalesce("_several", F.lit(False)).alias("_several"))
    return each.groupBy(reference).agg(F.max("_several").alias("paired"))


def normalised_strength(pairs: DataFrame, edges: DataFrame, work: str, reference: str, rows: int | None = None) -> DataFrame:
    """Pair counts over the geometric mean of the two references' citation counts."""
    cited = _distinct(edges, work, reference, rows).groupBy(reference).agg(F.count("*").alias("cited"))
    one = cited.select(F.col(reference).alias("ref1"), F.col("cited").alias("cited1"))
    two = cited.select(F.col(reference).alias("ref2"), F.col("cited").alias("cited2"))
    out = pairs.join(one, "ref1").join(two, "ref2")
    return out.withColumn("strength", F.col("n") / F.sqrt(F.col("cited1") * F.col("cited2")))


def top_k(rows: DataFrame, k: int, by: tuple[str, ...], *order: Column) -> DataFrame:
    """The first ``k`` rows of each group under a total order, with their rank."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def at_least(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.where(F.col("n") >= n)


def network_summary(edges: DataFrame, pairs: DataFrame, work: str, reference: str, rows: int | None = None) -> DataFrame:
    """Counts of works, references, edges, pairs and pair nodes as (metric, value) rows.

    The pairs are aggregated once. A reference is in a pair if one of its works has two references or more, which the
    edges tell without the pairs.
    """
    e = _distinct(edges, work, reference, rows)
    base = e.groupBy(work).agg(F.count("*").alias("_n")).agg(F.count(work).alias("citing_works"), F.coalesce(F.sum("_n"), F.lit(0)).alias("edges"))
    weights = pairs.agg(F.count("*").alias("pairs"), F.sum("n").alias("total_weight"), F.max("n").alias("max_weight"))
    nodes = _by_reference(e, work, reference).agg(F.count(reference).alias("references"), F.count_if(F.col("paired") & F.col(reference).isNotNull()).alias("pair_nodes"))
    one = base.crossJoin(weights).crossJoin(nodes)  # three single rows
    return one.select(*[F.col(c).cast("long") for c in one.columns]).unpivot([], one.columns, "metric", "value")


def seed_edges(edges: DataFrame, seeds: DataFrame, work: str, reference: str) -> DataFrame:
    """For each seed reference: works citing it, and which they are at first and last."""
    hit = edges.join(seeds, reference).select(work, reference).distinct()
    return hit.groupBy(reference).agg(F.count("*").alias("n_works"), F.min(work).alias("first_work"), F.max(work).alias("last_work"))
