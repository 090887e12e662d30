"""Exactly-once appends of a stream's batches by a ledger of their numbers.

A batch is written to a folder of its own number, which a repeated batch overwrites, and only then entered in the ledger. Readers see
the batches that the ledger has, so a failure between the two leaves nothing visible, and the restart, which Spark begins with the same
batch number, writes the same folder again. A batch that the ledger has isn't written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def entered(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of the batches that count."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema("batch long").json(f"{path}/ledger").distinct()


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches that the ledger has."""
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/data")
    batch = F.regexp_extract(F.input_file_name(), r"/data/b(\d+)/", 1).cast("long")  # a folder for each batch
    known = entered(spark, path).withColumnRenamed("batch", "_entered")  # eight bytes for each batch
    return rows.withColumn("_batch", batch).join(F.broadcast(known), F.col("_batch") == F.col("_entered"), "left_semi").drop("_batch")


def append_once(stream: DataFrame, path: str, checkpoint: str, between=None):
    """Run what is there and stop. ``between`` is called with a batch's number after its data and before its ledger entry (tests)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not entered(spark, path).where(F.col("batch") == number).isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/b{number}")
        if between is not None:
            between(number)
        spark.range(number, number + 1, 1, 1).select(F.col("id").alias("batch")).write.mode("append").json(f"{path}/ledger")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
