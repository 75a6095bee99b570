"""Readers and writers of files beside the parquet tables: CSV, nested JSON, JSON lines, zipped reports, hashes."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """CSV files with a header under one explicit schema; globs that match nothing are an error only if none matches."""
    known = [p for p in paths if _exists(spark, p)]
    if not known:
        raise FileNotFoundError(f"no file matches {paths}")
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(known)


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_nested_loads(spark: SparkSession, path: str, outer: str = "HourlySystemLoads", inner: str = "HourlySystemLoad") -> DataFrame:
    """(timestamp_utc, load_mw) of JSON documents with a list of {BeginDate, Load}; what can't be read is null."""
    schema = f"{outer} struct<{inner}: array<struct<BeginDate: string, Load: string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    d = d.select(F.explode(f"{outer}.{inner}").alias("x"))
    return d.select(F.try_to_timestamp("x.BeginDate").alias("timestamp_utc"), F.col("x.Load").try_cast("double").alias("load_mw"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


_REPORT = "file string, member string, report_date string, target_date string, target_he int, value double"


def read_zipped_reports(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of zipped report CSVs: the row ``D,Date,`` names a date (month/day/year) per column from the fourth on, other rows tagged D hold an hour ending in their third column and its values.

    Each archive is read by one task; archives are split over the cluster as files. A report without a date row or with
    an hour outside 1..24 is an error; empty cells are left out.
    """
    d = spark.read.format("binaryFile").load(path).select("path", "content")
    return d.mapInPandas(_reports, _REPORT)


def count_numeric_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, n_numbers): cells of zipped report CSVs, in rows with an hour, that are numbers."""
    d = spark.read.format("binaryFile").load(path).select("path", "content")
    return d.mapInPandas(_numeric_cells, "file string, member string, n_numbers bigint")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, list[list[str]]]]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                    yield path, name, list(csv.reader(io.TextIOWrapper(z.open(name), "utf-8-sig")))


def _with_hour(rows: list[list[str]]) -> list[list[str]]:
    return [r for r in rows if len(r) > 3 and r[0] == "D" and r[2].strip().isdigit()]


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, name, lines in _members(batches):
        stamp = re.search(r"(\d{4})-?(\d{2})-?(\d{2})", name)
        head = next((r for r in lines if r[:2] == ["D", "Date"]), None)
        if head is None:
            raise ValueError(f"no date row in {name}")
        days = {k: datetime.strptime(x.strip(), "%m/%d/%Y").date().isoformat() for k, x in enumerate(head) if k >= 3 and x.strip()}
        rows = []
        for r in _with_hour(lines):
            if not 1 <= int(r[2]) <= 24:
                raise ValueError(f"hour {r[2]} in {name}")
            rows += [(path, name, "-".join(stamp.groups()) if stamp else None, days[k], int(r[2]), _float(x)) for k, x in enumerate(r) if k in days and x.strip()]
        yield pd.DataFrame(rows, columns=["file", "member", "report_date", "target_date", "target_he", "value"])


def _numeric_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, name, lines in _members(batches):
        yield pd.DataFrame([(path, name, sum(_float(x.strip()) is not None for r in _with_hour(lines) for x in r[3:]))], columns=["file", "member", "n_numbers"])


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    """Write where nothing is yet; an existing path is an error and stays as it is."""
    w = df.write.mode("errorifexists").format(kind).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
