"""Exact deduplication by an extendible-hash index on shared files.

A text's key is a 64-bit hash. The directory tells each prefix of a key's bits its bucket: a bucket with more than
``capacity`` entries splits by its next bit, and where the deepest bucket splits, the directory doubles, until no bucket is
overfull or the bits end. As a bucket is a prefix, it is a range of keys: the index is written in ranges of buckets,
each by the task that owns it, which chains the different texts of one key (an entry each, told apart by SHA-256).
An entry has its number of rows and the row that stays. That the rows of an entry are equal is not left to
digests: the texts of all entries of several rows are grouped by their bytes, and two texts in one entry raise.

What moves are keys and digests; of the texts only those of repeated keys do, combined before the shuffle, where
those keys can be broadcast (``THIN`` of them at most), else all. Groups of over a ten-thousandth of all rows
(so fewer than ten thousand) are broadcast to their rows, all others meet theirs in a shuffle, so a text that a third of all
rows share lands in no single task.

Null texts count as empty, and empty texts are equal. Of equal texts the row with the largest id stays; a null id is
smaller than all others; of rows that agree in id and text one stays. Every row is returned. Texts of any length are taken
whole. No rows give no rows. SQL functions only, no Python in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, meet_groups

BITS = 64
CAPACITY = 1 << 20  # entries of a bucket
THIN = 2_000_000  # repeated keys that are broadcast to thin the texts
SLOTS = 1 << 20  # of a directory that is broadcast


def text_key(text: Column, bits: int = BITS) -> Column:
    """The leading ``bits`` of a text's hash, as the leading bits of a long."""
    key = F.xxhash64(text)
    return key if bits == BITS else F.shiftleft(F.shiftrightunsigned(key, BITS - bits), BITS - bits)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def slot(key: Column, depth: int) -> Column:
    """A key's first ``depth`` bits: its place in a directory of that depth."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


@dataclass
class ExactIndex:
    """``rows`` (row, id, key, sha), ``directory`` (slot, bucket, local_depth) and ``entries`` (bucket, key, chain, sha, n, keep_id, keep_row)."""

    rows: DataFrame
    directory: DataFrame
    entries: DataFrame
    depth: int
    n_rows: int


def build_directory(entries: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> tuple[DataFrame, int]:
    """The slots (slot, bucket, local_depth) of the smallest directory whose buckets hold ``capacity`` entries at most, and its depth.

    A bucket's name is its first slot. Buckets of equal keys can't split; they stay overfull when the bits end.
    """
    depth = min(bits, max(0, (entries.count() // max(1, capacity)).bit_length() - 1))
    while True:
        cells = entries.groupBy(slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
        if depth >= bits or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth += 1  # the directory doubles
    # every prefix with its entries; the halves of overfull ones that aren't overfull themselves are buckets, empty ones too
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")
    tree = cells.select("slot", "n", level).groupBy("local_depth", F.expr(f"shiftright(slot, {depth} - local_depth)").alias("prefix"))
    over = tree.agg(F.sum("n").alias("n")).where((F.col("n") > capacity) & (F.col("local_depth") < depth)).select("local_depth", "prefix")
    half = F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix")
    parts = entries.sparkSession.range(1).select(F.lit(0).alias("local_depth"), F.col("id").alias("prefix"))
    parts = parts.unionByName(over.select((F.col("local_depth") + 1).alias("local_depth"), half))
    buckets = parts.join(over, ["local_depth", "prefix"], "left_anti")
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    slots = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - local_depth)") - 1))
    return buckets.select(slots.alias("slot"), first.alias("bucket"), "local_depth"), depth


def build_index(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bits: int = BITS
) -> ExactIndex:
    """Index every row of ``docs``; the tables lie in the shared folder."""
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text, bits).alias("key"), digest(text).alias("sha"))
    rows = scratch.write(named.withColumn("row", F.monotonically_increasing_id()))
    lowest = F.coalesce("id", F.lit(-(1 << 63)))
    per = rows.groupBy("key", "sha").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.max_by("row", lowest).alias("keep_row"))
    plain = scratch.write(per)
    _compare_bytes(plain, docs.select(text_key(text, bits).alias("key"), text.alias("text")))
    directory, depth = build_directory(plain, capacity, bits)
    directory = scratch.write(directory)
    small = F.broadcast(directory) if depth <= SLOTS.bit_length() - 1 else directory
    placed = plain.withColumn("slot", slot(F.col("key"), depth)).join(small, "slot")
    owned = placed.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "sha")  # a task for each range
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha")) - 1
    entries = owned.select("bucket", "key", chain.alias("chain"), "sha", "n", "keep_id", "keep_row")
    return ExactIndex(rows, directory, scratch.write(entries), depth, rows.count())


def _compare_bytes(entries: DataFrame, texts: DataFrame) -> None:
    """Raise if an entry holds two different texts."""
    keys = entries.where("n > 1").select("key").distinct()
    n = keys.count()
    if n == 0:
        return
    if n <= THIN:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    links = texts.groupBy("key", "text").agg(F.count("*").alias("n")).select("key", digest(F.col("text")).alias("sha"))
    twice = links.groupBy("key", "sha").agg(F.count("*").alias("texts")).where("texts > 1").limit(1).collect()
    if twice:
        raise ValueError(f"different texts agree in key {twice[0]['key']} and SHA-256")


def exact_groups(index: ExactIndex) -> DataFrame:
    """A row for each indexed row: (doc_id, keep_id, group_size, kept, text_sha256, bucket, chain)."""
    groups = index.entries.select("key", "sha", "bucket", "chain", "n", "keep_id", "keep_row")
    both = meet_groups(index.rows, groups, ["key", "sha"], "n", index.n_rows)
    return both.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a staying row has; all columns are kept.

    Rows that agree in id and text, but perhaps not in other columns, stay once: one of them.
    """
    index = build_index(spark, docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.struct(F.col(id_col).cast("long").alias("id"), digest(text).alias("sha"))
    several = index.entries.where("n > 1").select(F.struct(F.col("keep_id").alias("id"), "sha").alias("_mark"), F.lit(True).alias("_several"))
    gone = index.rows.join(index.entries.where("n > 1").select("key", "sha", "keep_id"), ["key", "sha"])
    gone = gone.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.struct("id", "sha").alias("_mark")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), mark.alias("_mark")).join(gone, "_mark", "left_anti").join(several, "_mark", "left")
    alone = packed.where("_several is null").select("_doc")
    once = packed.where("_several").dropDuplicates(["_mark"]).select("_doc")
    return alone.unionByName(once).select("_doc.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(build_index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
"""
