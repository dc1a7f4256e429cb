"""Session settings, the shared scratch folder, and settling of small results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rows of a fit result (a few numbers each) that may sit on the driver and be broadcast.
SMALL_ROWS = 20_000

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "plantlens") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", "16g").getOrCreate()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package from its own folder, wherever the driver was started.

    Enough for local mode and for a folder that all machines see; else ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="plantlens-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, list[Row] | None]:
    """Run ``df`` once and hand back a cheap frame.

    At most ``max_rows`` rows come to the driver and return as a broadcast-hinted local
    frame together with the rows; a larger result is written out and joined by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows
    return cut(df), None
