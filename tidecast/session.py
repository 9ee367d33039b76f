"""Session set-up and the two ways a plan may cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", app: str = "tidecast") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    cores = str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: what ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder. A cluster session without
    it is an error, because a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidecast-")
    context.setCheckpointDir(folder)
    return folder


def new_output_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for a written table, below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes a small derived frame to the shared folder and reads it back.

    A frame used several times is so computed once and survives the loss of an executor. Unlike a
    checkpoint it is written in the same pass that computes it, prunes columns when read, and has a
    known size, which lets Spark broadcast it where that is safe. ``discard`` removes it again.
    """
    path = new_output_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame.settled_path = path
    return frame


def discard(*frames: DataFrame) -> None:
    """Deletes settled tables that no later plan reads; frames that were not settled are left alone."""
    for frame in frames:
        path = getattr(frame, "settled_path", None)
        if path is None:
            continue
        spark = frame.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
