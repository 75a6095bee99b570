"""Hourly series: resampling, gaps, interpolation, daily vectors and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import cut_table


def resample(rows: DataFrame, keys: list[str], time: str, value: str, unit: str = "hour") -> DataFrame:
    """Mean and count per key and time unit; combined before the shuffle."""
    return rows.groupBy(*keys, F.date_trunc(unit, time).alias(time)).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_values"))


def with_empty_hours(hourly: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The same rows and one for each missing hour between a key's first and last, with null values."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = hourly.withColumn("_next", F.coalesce(F.lead(time).over(w) - F.expr("INTERVAL 1 HOUR"), F.col(time)))
    d = d.withColumn("_h", F.explode(F.sequence(F.col(time), F.col("_next"), F.expr("INTERVAL 1 HOUR"))))
    own = F.col("_h") == F.col(time)
    rest = [c for c in hourly.columns if c not in (*keys, time)]
    return d.select(*keys, F.col("_h").alias(time), *[F.when(own, F.col(c)).alias(c) for c in rest])


def gaps_over(rows: DataFrame, keys: list[str], time: str, hours: int = 1) -> DataFrame:
    """(keys, gap_from, gap_to, missing_hours) where two neighbours are more than ``hours`` apart."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = rows.select(*keys, F.lag(time).over(w).alias("gap_from"), F.col(time).alias("gap_to"))
    apart = (F.unix_timestamp("gap_to") - F.unix_timestamp("gap_from")) / 3600
    return d.where(apart > hours).withColumn("missing_hours", (apart - 1).cast("int"))


def interpolate_inside(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Null values between two known ones on the straight line through them; outside they stay null. Adds ``imputed``."""
    back = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.unix_timestamp(time).alias("t"), F.col(value).cast("double").alias("v")))
    d = rows.withColumns({"_a": F.last(point, True).over(back), "_b": F.first(point, True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.unix_timestamp(time) - a["t"]) / (b["t"] - a["t"])
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(a.isNotNull() & b.isNotNull(), line)
    return d.withColumn("imputed", F.col(value).isNull() & filled.isNotNull()).withColumn(value, filled).drop("_a", "_b")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The rows with ``before``, a struct of ``cols`` of the row before in (order) of the same key, null for the first; nulls of ``order`` come last, ``order`` is total.

    Rows are range-partitioned by key and order; each range carries the last row of the range before, so a key with any
    share of all rows is spread.
    """
    last_null = [F.asc_nulls_last(c) for c in order]
    d = cut_table(rows.repartitionByRange(*keys, *last_null).withColumn("_p", F.spark_partition_id()))
    place = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(y for c in order for y in (F.col(c).isNull(), F.col(c)))])
    ends = d.groupBy(*keys, "_p").agg(F.max_by(F.struct(*cols), place).alias("_end"))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), F.lag("_end").over(Window.partitionBy(*keys).orderBy("_p")).alias("_carried"))  # one row per range and key
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_p").orderBy(*last_null)
    d = d.join(ends, on).withColumn("before", F.coalesce(F.lag(F.struct(*cols)).over(w), F.col("_carried")))
    return d.select(*rows.columns, "before")


def rising_times(rows: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Per key: rows, whether times rise strictly in the given order, and whether they are unique."""
    d = with_previous(rows.select(*keys, order, time), keys, [order], [time]).withColumn("_up", F.col(time) > F.col(f"before.{time}"))
    return d.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.every(F.coalesce("_up", F.lit(True))).alias("rising"), (F.countDistinct(time) == F.count(time)).alias("unique_times"))


def dense_day(rows: DataFrame, keys: list[str], hour: str, value: str, slots: int = 24) -> DataFrame:
    """Per key the sums of a day's slots 1..n as an array; days with a missing slot are left out."""
    per = rows.where(F.col(hour).between(1, slots)).groupBy(*keys, hour).agg(F.sum(value).alias("_s"))
    d = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(hour, "_s"))).alias("_a"))  # at most n slots
    return d.where(F.size("_a") == slots).select(*keys, F.transform("_a", lambda x: x["_s"]).alias("day"))


def complete_groups(rows: DataFrame, keys: list[str], part: str, parts: list[str]) -> DataFrame:
    """Keys whose set of parts is exactly the given one."""
    want = F.array(*[F.lit(p) for p in sorted(parts)])
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(part)).alias("_set")).where(F.col("_set") == want).select(*keys)


def as_map(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Per key a map name -> value (repeated names: their sum)."""
    per = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.sum(value).alias("_v"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "_v")))).alias("by_name"))


def day_coverage(rows: DataFrame, keys: list[str], day: str, hour: str, full: int = 24) -> DataFrame:
    """(keys, day, n_hours, status) of every day from a key's first to its last: COMPLETE, PARTIAL or MISSING."""
    have = rows.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).cast("date").alias("day")).agg(F.countDistinct(hour).cast("int").alias("n_hours"))
    ends = have.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    all_days = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    n = F.coalesce("n_hours", F.lit(0))
    return all_days.join(have, [*keys, "day"], "left").select(*keys, F.col("day").cast("string").alias("day"), n.alias("n_hours"), F.when(n >= full, "COMPLETE").when(n > 0, "PARTIAL").otherwise("MISSING").alias("status"))


def agreed(rows: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    """Per key: how many repeats, whether all have equal content, and the first one's order value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.countDistinct(content) <= 1).alias("agree"), F.min(order).alias("kept"))
