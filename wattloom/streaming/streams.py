"""Structured Streaming forms of the batch operators: hourly windows and newest vintages, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive, under an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_stream(stream: DataFrame, time: str, keys: list[str], value: str, late: str = "2 hours", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean and count per window and keys; rows later than the watermark are left out, state of closed windows is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    d = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_values"))
    return d.select(F.col("window.start").alias("window_start"), *keys, "mean_value", "n_values")


def run_newest(stream: DataFrame, path: str, checkpoint: str, published: str, cutoff: str, keys: list[str], id_col: str):
    """Keep, per key, the newest row published not after its cutoff in a table under ``path``; drain what is there and stop.

    Each batch is first reduced to one row per key and merged with the rows of the version before; the result is a new
    version. A batch that is run again writes its own version again, from the same one before it. ``read_newest`` reads the last one.
    """

    def newest(d: DataFrame) -> DataFrame:
        rest = [c for c in d.columns if c not in keys]
        return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(published, id_col)).alias("_r")).select(*keys, "_r.*")

    def merge(batch: DataFrame, number: int) -> None:
        known = newest(batch.where(F.col(published) <= F.col(cutoff)))
        before = _last_version(batch.sparkSession, path, number)
        if before is not None:
            known = newest(known.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(before)))
        known.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version-{number:09d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_version(spark: SparkSession, path: str, below: int) -> str | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/_SUCCESS")
    found = [str(x.getPath().getParent()) for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []]
    return max((x for x in found if int(x.rsplit("-", 1)[1]) < below), default=None, key=lambda x: x.rsplit("-", 1)[1])


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that ``run_newest`` has finished."""
    last = _last_version(spark, path, 1 << 62)
    if last is None:
        raise FileNotFoundError(f"no version under {path}")
    return spark.read.parquet(last)


def distinct_stream(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark's reach (re-deliveries of a feed)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is there into parquet and stop; a restart goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
