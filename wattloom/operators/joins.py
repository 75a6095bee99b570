"""Joins with guarantees, and tails of a series as of a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row that tells whether a join is strictly one to one: null and repeated keys of each side, keys only one side has, keys both have.

    Each side is aggregated by key before anything is compared; nothing is collected.
    """
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()

    def side(d: DataFrame, n: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.count("*").alias(n))

    both = side(left, "_l").withColumn("_nl", null).join(side(right, "_r"), keys, "full_outer")
    key_null = null
    n = lambda cond: F.count_if(cond)
    nulls = lambda c: F.coalesce(F.sum(F.when(key_null, F.col(c))), F.lit(0))
    return both.agg(
        nulls("_l").alias("left_null_rows"),
        nulls("_r").alias("right_null_rows"),
        n(~key_null & (F.col("_l") > 1)).alias("left_repeated_keys"),
        n(~key_null & (F.col("_r") > 1)).alias("right_repeated_keys"),
        n(~key_null & F.col("_r").isNull()).alias("left_only_keys"),
        n(~key_null & F.col("_l").isNull()).alias("right_only_keys"),
        n(~key_null & F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common_keys"),
    )


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails unless it is one to one and complete on both sides."""
    r = join_report(left, right, keys).first()
    broken = {k: v for k, v in r.asDict().items() if v and k != "common_keys"}
    if broken:
        raise ValueError(f"join on {keys} is not one to one: {broken}")
    return left.join(right, keys)


def lookup(facts: DataFrame, table: DataFrame, keys: list[str], found: str = "found", default: dict | None = None) -> DataFrame:
    """Left many-to-one join with a flag of the facts that found their row, and ``default`` values where they didn't; the table's keys must be unique."""
    d = facts.join(table.withColumn(found, F.lit(True)), keys, "left").withColumn(found, F.coalesce(F.col(found), F.lit(False)))
    return d.withColumns({c: F.when(F.col(found), F.col(c)).otherwise(F.lit(v)) for c, v in (default or {}).items()})


def tail_as_of(asked: DataFrame, asked_key: str, entity: str, cutoff: str, series: DataFrame, time: str, value: str, n: int, inclusive: bool = True) -> DataFrame:
    """(asked_key, values): the last ``n`` hourly values at or before a cutoff, oldest first; null unless all n hours are there.

    A cutoff asks for n known hours, so the range condition is an equi-join on (entity, hour); ``series`` is hourly and
    unique per entity and hour. ``inclusive`` takes the hour that begins exactly at the cutoff.
    """
    last = F.date_trunc("hour", cutoff)
    if not inclusive:
        last = F.when(last == F.col(cutoff), last - F.expr("INTERVAL 1 HOUR")).otherwise(last)
    hours = asked.select(asked_key, entity, last.alias("_last")).where(F.col("_last").isNotNull())
    hours = hours.select(asked_key, entity, F.explode(F.sequence(F.col("_last") - F.expr(f"INTERVAL {n - 1} HOURS"), F.col("_last"), F.expr("INTERVAL 1 HOUR"))).alias(time))
    got = hours.join(series.select(entity, time, F.col(value).alias("_v")), [entity, time])
    tails = got.groupBy(asked_key).agg(F.sort_array(F.collect_list(F.struct(time, "_v"))).alias("_a"))  # n values at most
    tails = tails.where((F.size("_a") == n) & ~F.exists("_a", lambda x: x["_v"].isNull())).select(asked_key, F.transform("_a", lambda x: x["_v"]).alias("values"))
    return asked.select(asked_key).distinct().join(tails, asked_key, "left")


def newest_before(rows: DataFrame, keys: list[str], published: str, cutoff: Column, ties: list[Column]) -> DataFrame:
    """Per key the newest row published not after its cutoff; ties by the given columns, highest first. One max per key, combined before the shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    known = rows.where(F.col(published) <= cutoff)
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(published), *ties)).alias("_row"))
    return best.select(*keys, "_row.*")


def present_on_both(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations that occur on both sides (nulls match nulls)."""
    return left.select(*cols).intersect(right.select(*cols))


def missing_from(expected: DataFrame, present: DataFrame, cols: list[str]) -> DataFrame:
    """Expected combinations that aren't present."""
    return expected.select(*cols).distinct().join(present.select(*cols).distinct(), cols, "left_anti")


def pair_gaps(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Per group the number of ordered member pairs (by member, then value) and of those in which the value rises.

    Rows are counted by (group, member, value) first; a running count per group and member then replaces the pairs, so
    a group of any size is as cheap as its distinct values. Null members and values rise nowhere.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_c")).select(F.col(group).alias("_g"), F.floor(F.col("_c") * (F.col("_c") - 1) / 2).alias("n_pairs"))
    n = rows.dropna(subset=[group, member, value]).groupBy(group, member, value).agg(F.count("*").alias("_n"))
    last = n.select(F.col(group).alias("_h"), F.col(member).alias("_last")).distinct()
    d = n.join(last, (F.col(group) == F.col("_h")) & (F.col(member) <= F.col("_last"))).groupBy(group, "_last", value).agg(F.sum("_n").alias("_any"), F.sum(F.when(F.col(member) == F.col("_last"), F.col("_n"))).alias("_own"))
    below = F.sum("_any").over(Window.partitionBy(group, "_last").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    rising = d.withColumn("_below", below).groupBy(group).agg(F.sum(F.col("_own") * F.col("_below")).alias("n_rising"))
    return sizes.join(rising, F.col("_g") == F.col(group), "left").select(F.col("_g").alias(group), "n_pairs", F.coalesce("n_rising", F.lit(0)).alias("n_rising"))


def first_known(rows: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Per key the first value of each column that isn't null, in order."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Deduplicate: per key the first row in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
