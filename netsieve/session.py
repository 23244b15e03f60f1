"""Session helpers: builder defaults, table loading, shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "netsieve") -> SparkSession:
    """Session with the settings this library assumes (AQE on, UI off, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NETSIEVE_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) that leaves it unset gets a folder of our own;
    on a cluster a machine-local folder would be lost with its executor, so an
    unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (written tables and checkpoints go there)")
        root = os.path.join(os.environ.get("NETSIEVE_LOCAL_SCRATCH", "/tmp"), "netsieve-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)  # DataFrame.checkpoint() writes under the context's folder
    return root


def sized_join(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner", max_rows: int = 100_000) -> DataFrame:
    """``df`` joined with an aggregate of it: broadcast where its counted rows are at most ``max_rows``, else a shuffled join
    (whose hot keys AQE splits). ``side`` is computed once, into a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    side = side.checkpoint()
    small = side.limit(max_rows + 1).count() <= max_rows
    return df.join(side.hint("broadcast") if small else side, on, how)


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/netsieve/{tag}-{uuid.uuid4().hex}"
