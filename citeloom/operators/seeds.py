"""Resolving seed works among all works, without a search service: DOI first, then title, author and year; and their other editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 10_000  # seeds that one scan of the works may look for
EDITIONS = 15
AHEAD, LATEST = 5, 2025  # other editions: from so many years before the seed's window, up to this year


def _matches(title: Column, seed: Column) -> Column:
    """Whether a title holds all words of more than two letters of the seed's."""
    return F.forall(seed["words"], lambda w: F.contains(title, w))


def title_candidates(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """Works that a seed's title and author fit: the works' columns and ``seed`` (a struct of the seed's columns).

    ``works``: id, doi, title, authors (array), year, cited. ``seeds``: seed_id, doi, title, author, year_from, year_to. The works are
    scanned once and don't move; the seeds, ``SEEDS`` at most (more raise), are one row that every task has.
    """
    n = seeds.count()
    if n > SEEDS:
        raise ValueError(f"{n} seeds are too many for one scan")
    words = F.filter(F.split(F.trim(F.lower("title")), r"\s+"), lambda w: F.char_length(w) > 2)
    one = seeds.select(F.struct(*seeds.columns, words.alias("words"), F.lower("author").alias("name")).alias("s")).agg(F.collect_list("s").alias("_seeds"))
    low, names = F.lower("title"), F.lower(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "))
    rows = works.where(F.col("title").isNotNull()).withColumns({"_low": low, "_names": names}).crossJoin(F.broadcast(one))  # one row
    fit = F.filter("_seeds", lambda s: _matches(F.col("_low"), s) & F.contains(F.col("_names"), s["name"]))
    return rows.select(*works.columns, F.explode(fit).alias("seed"))


def resolve_seeds(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, id, method): the work with the seed's DOI, else the most cited fitting one of its years; smaller ids on ties."""
    by_doi = works.where("doi is not null").select(F.lower("doi").alias("_doi"), "id").join(
        F.broadcast(seeds.where("doi is not null").select("seed_id", F.lower("doi").alias("_doi"))), "_doi"
    )
    by_doi = by_doi.groupBy("seed_id").agg(F.min("id").alias("id")).withColumn("method", F.lit("doi_lookup"))
    found = title_candidates(works, seeds).where("year between seed.year_from and seed.year_to")
    rank = F.row_number().over(Window.partitionBy("seed.seed_id").orderBy(F.desc(F.coalesce("cited", F.lit(0))), "id"))
    best = found.withColumn("_r", rank).where("_r = 1").select(F.col("seed.seed_id").alias("seed_id"), "id", F.lit("title_search_then_get").alias("method"))
    return by_doi.unionByName(best.join(by_doi, "seed_id", "left_anti"))


def other_editions(works: DataFrame, seeds: DataFrame, resolved: DataFrame, k: int = EDITIONS) -> DataFrame:
    """(seed_id, id, year, cited, rank): further works that fit a seed in a wider range of years, the most cited first."""
    wide = "year between greatest(1900, seed.year_from - %d) and %d" % (AHEAD, LATEST)
    found = title_candidates(works, seeds).where(wide).select(F.col("seed.seed_id").alias("seed_id"), "id", "year", F.coalesce("cited", F.lit(0)).alias("cited"))
    found = found.join(F.broadcast(resolved.select("seed_id", "id")), ["seed_id", "id"], "left_anti")  # one row for each seed
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("cited"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
