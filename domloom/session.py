"""Session helpers: builder for local runs, and the shared folder jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "domloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter brings its own."""
    builder = (
        SparkSession.builder.appName(app_name)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a machine-local folder: on a cluster the
    executors could not read it back.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="domloom-")
    return f"{root.rstrip('/')}/domloom/{purpose}-{uuid.uuid4().hex}"


def checkpointed(table: DataFrame) -> DataFrame:
    """``table`` computed once, as a table in the shared folder.

    Unlike ``checkpoint()``, which computes the last stage a second time to write it, this
    runs the plan once, and later joins know the size of the result.
    """
    spark = table.sparkSession
    path = shared_dir(spark, "tables")
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
