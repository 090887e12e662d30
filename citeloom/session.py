"""Session settings and what Python workers need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the Python workers once, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_citeloom_shipped", False):
        file = Path(tempfile.mkdtemp(prefix="citeloom-")) / "citeloom_source.zip"
        with zipfile.ZipFile(file, "w") as out:
            for path in sorted(PACKAGE.rglob("*.py")):
                out.write(path, f"citeloom/{path.relative_to(PACKAGE)}")
        context.addPyFile(str(file))
        context._citeloom_shipped = True
    # long texts: a tenth of the default rows in an Arrow batch keeps Python workers small
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that all queries expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
