"""Readers of the parquet tables; timestamps without a zone are read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table under an explicit schema in which naive timestamps are UTC instants.

    The scan itself reads them so, whatever the session's zone is: later steps meet one type only, and filters on
    times are pushed down to the files.
    """
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    utc = [StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType, f.nullable) for f in found.schema.fields]
    return spark.read.schema(StructType(utc)).parquet(path) if found.schema.fields != utc else found
