"""Session settings, and shipping of this package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the queries are tested with."""
    builder = SparkSession.builder.master(master).appName("copyloom")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once, so that workers started elsewhere can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="copyloom-")) / "copyloom.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name in the one that spark.checkpoint.dir names. Where none is named, a temporary one is set in local mode (tests); on a
    cluster that is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="copyloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where}/copyloom-{what}-{uuid.uuid4().hex}"


#: Rows of a part that dealt() makes, about.
PART = 250_000


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df by keys in parts of about PART rows each, so that what a task sorts or holds doesn't grow with the table; df is counted for it, so it should be stored or
    scanned, if the number isn't given."""
    return df.repartition(parts or parts_of(df), *keys)


def parts_of(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART))


def kept(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that what uses it several times makes it once."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
