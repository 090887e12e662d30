"""Written tables that cut the lineage of iterative plans, in the folder that the session shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Parquet tables under ``spark.checkpoint.dir``; a temporary folder only where none is set on a local master (tests)."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tables-")
        self.spark, self.root, self.written = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.root}/t{self.written}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
