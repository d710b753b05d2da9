"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def make_session(app: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: AQE on, UTC, Arrow on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster for checkpoints; a temporary one only in local mode, where none is set (tests)."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured is None and current.isDefined():
        return current.get()
    if configured is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    if configured is None:
        configured = tempfile.mkdtemp(prefix="cohortloom-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table written and read back by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and continue from the written table.

    Lineage ends there, later readers prune columns, and a lost executor costs a re-read. The tables of one application
    lie in one folder, to be dropped when it has ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
