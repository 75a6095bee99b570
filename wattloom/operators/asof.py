"""Attributes as known at event time, by version numbers.

Narrow rows only: the known times of an entity's attribute records and the times of its events are merged in time
order, and a running count of the changes of "the best record known so far" numbers the versions. An event takes
the count at its own time; the wide attributes are then joined by plain equality of entity and version.

An entity with any share of all rows is no hot spot: order is kept per (entity, time bucket), and the best record and
the number of changes of all earlier buckets come from per-bucket aggregates, which are as few as the buckets. The
numbered narrow rows are written once; versions and events are read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import cut_table


def known_at(
    events: DataFrame,
    event_id: str,
    event_keys: list[Column],
    event_time: Column,
    attributes: DataFrame,
    attribute_keys: list[Column],
    known_time: Column,
    rank: list[Column],
    wide: dict[str, Column],
    bucket_hours: int = 24,
) -> DataFrame:
    """Per event at most one attribute record: of those known not after the event's time the one highest in ``rank``.

    Result: ``event_id`` (repeated as in the input) and ``wide``, the chosen record's columns; events without a known
    record don't appear. ``rank`` must be a total order of an entity's records (end it with an id; repeats of the
    whole rank count once). Null keys match nothing, and a record or event with a null time, or a record with a null
    in ``rank``, was never known. Clashing names of further columns don't matter: only the given expressions are read.
    """
    bucket = lambda t: F.floor(F.unix_micros(t) / F.lit(bucket_hours * 3_600_000_000))
    ok = lambda cols: [c.isNotNull() for c in cols]
    key = lambda cols: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
    a = attributes.select(key(attribute_keys).alias("_key"), known_time.alias("_t"), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("_rank"), *[c.alias(n) for n, c in wide.items()], _all(ok([*attribute_keys, known_time, *rank])).alias("_ok")).where("_ok")
    e = events.select(key(event_keys).alias("_key"), event_time.alias("_t"), F.col(event_id).alias("_event"), _all(ok([*event_keys, event_time])).alias("_ok")).where("_ok")
    narrow = a.select("_key", "_t", "_rank", F.lit(None).cast(e.schema["_event"].dataType).alias("_event")).unionByName(e.select("_key", "_t", F.lit(None).cast(a.schema["_rank"].dataType).alias("_rank"), "_event"))
    narrow = narrow.withColumn("_b", bucket(F.col("_t")))

    # The best record of all earlier buckets, carried into each bucket: one row per bucket.
    per = narrow.groupBy("_key", "_b").agg(F.max("_rank").alias("_top"))
    earlier = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("_key", "_b", F.max("_top").over(earlier).alias("_carried"))

    # Within a bucket: a record is a change if it beats what was known before it. Events come after records of the same time.
    order = [F.col("_t"), F.col("_event").isNotNull(), F.col("_rank")]
    before = Window.partitionBy("_key", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_key", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = narrow.join(carried, ["_key", "_b"])
    best = F.greatest(F.max("_rank").over(before), F.col("_carried"))
    d = d.withColumn("_change", F.when(F.col("_rank").isNotNull() & (best.isNull() | (F.col("_rank") > best)), 1).otherwise(0))
    d = d.withColumn("_n", F.sum("_change").over(upto))
    # written once: events, and the records that were a change
    d = cut_table(d.where(F.col("_event").isNotNull() | (F.col("_change") == 1)).select("_key", "_b", "_n", "_rank", "_event"))

    # Versions count on from bucket to bucket; only changes raise a bucket's count.
    buckets = d.groupBy("_key", "_b").agg(F.coalesce(F.max(F.when(F.col("_event").isNull(), F.col("_n"))), F.lit(0)).alias("_changes"))
    base = buckets.select("_key", "_b", F.coalesce(F.sum("_changes").over(earlier), F.lit(0)).alias("_base"))
    d = d.join(base, ["_key", "_b"]).withColumn("_version", F.col("_base") + F.col("_n"))
    version = d.where("_event IS NULL").select("_key", "_version", "_rank")
    numbered = a.join(version, ["_key", "_rank"]).dropDuplicates(["_key", "_version"])
    asked = d.where(F.col("_event").isNotNull() & (F.col("_version") > 0)).select("_key", "_version", F.col("_event").alias(event_id))
    return asked.join(numbered, ["_key", "_version"]).select(event_id, *wide)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def generator_state(states: DataFrame, generators: DataFrame) -> DataFrame:
    """Each decision with its generator's record as known at the cutoff: the latest observed, then the latest available, then the largest id."""
    c = F.col
    return known_at(
        states, "state_row_id", [c("generator_id")], c("decision_cutoff_utc"),
        generators, [c("generator_id")], F.when(c("observation_timestamp").isNotNull() & c("availability_timestamp").isNotNull(), F.greatest("observation_timestamp", "availability_timestamp")),
        [c("observation_timestamp"), c("availability_timestamp"), c("record_id")],
        {n: c(n) for n in ("record_id", "dispatch_mw", "utilization", "headroom_mw", "own_lmp", "observation_timestamp", "availability_timestamp")},
    )


def forecast_state(states: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Each decision with its hour's forecast as known at the cutoff: the latest published, then the largest id."""
    c = F.col
    return known_at(
        states, "state_row_id", [c("control_area"), c("target_local_date"), c("target_he"), c("region")], c("decision_cutoff_utc"),
        forecasts, [c("control_area"), c("forecast_date"), c("forecast_hour"), c("region")], c("published_datetime_utc"),
        [c("published_datetime_utc"), c("forecast_id")],
        {n: c(n) for n in ("forecast_id", "forecast_mw", "vintage", "published_datetime_utc")},
    )
