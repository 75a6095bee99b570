"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wattloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time, ANSI casts and adaptive execution; settings of a running session win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder (spark.checkpoint.dir); a folder of this machine is named only for a local master, where there is no other machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share: intermediate tables are written there")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written as parquet under the shared checkpoint folder and read again: lineage ends, columns stay prunable.

    The table is removed when the application ends; ``clear_written`` removes all of them earlier, once results are out.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clear_written(spark: SparkSession) -> int:
    """Remove the tables that ``cut_table`` has written so far, and say how many; results not written out yet can't be computed any more."""
    n = len(_WRITTEN)
    while _WRITTEN:
        files, at = _hadoop(spark, _WRITTEN.pop())
        files.delete(at, True)
    return n
