"""Shared steps of the training-data operators: spreading of rows and spellings of ids and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are cores; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_name(split: Column) -> Column:
    """A split without case and surrounding white space; null and blank are no split."""
    s = F.upper(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def state_key(state_id: Column) -> Column:
    """The letter runs and numbers of an id in order, without case, leading zeros and all else; null if there are none."""
    runs = F.regexp_extract_all(F.lower(state_id), F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))
    key = F.array_join(F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(?=\p{Nd})", "")), "|")
    return F.when(key != "", key)
