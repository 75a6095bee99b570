"""Fitted statistics, information measures and group comparisons, all as mergeable aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.numbers import is_finite
from wattloom.session import cut_table


def quantiles(rows: DataFrame, keys: list[str], value: Column, at: list[float]) -> DataFrame:
    """(keys, quantiles, n, low, high): exact, linearly interpolated quantiles of the values that aren't null, per key.

    Counts of equal values are range-partitioned by key and value; running counts inside the ranges plus those of the
    ranges before pick the ranks. So no key's values meet in one buffer, however many there are.
    """
    v = rows.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    d = cut_table(v.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    part = d.groupBy(*keys, "_p").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*keys)  # one row per range and key
    part = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), (F.sum("_m").over(w.orderBy("_p")) - F.col("_m")).alias("_before"), F.sum("_m").over(w).alias("_all"))
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.join(part, on).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v")))
    holds = lambda rank: (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    ends = []
    for x in at:
        rank = F.lit(x) * (F.col("_all") - 1)
        ends += [F.max(F.when(holds(F.floor(rank)), F.col("_v"))), F.max(F.when(holds(F.ceil(rank)), F.col("_v"))), F.max(rank - F.floor(rank))]
    d = d.groupBy(*keys).agg(F.max("_all").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)])
    e = lambda i: F.col(f"_e{i}")
    return d.select(*keys, F.array(*[e(3 * i) + (e(3 * i + 1) - e(3 * i)) * e(3 * i + 2) for i in range(len(at))]).alias("quantiles"), "n", "low", "high")


def fit_quantiles(rows: DataFrame, cols: list[str], at: list[float], where: Column | None = None) -> DataFrame:
    """(column_name, quantiles): exact quantiles of the finite values of each column, fitted on ``where`` only; empty where a column has none."""
    d = rows if where is None else rows.where(where)
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(is_finite(F.col(c)), F.col(c).cast("double")).alias("_x")) for c in cols])).alias("s")).select("s.*")
    names = rows.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    got = quantiles(long, ["column_name"], F.col("_x"), at).select("column_name", "quantiles")
    return names.join(got, "column_name", "left").select("column_name", F.coalesce("quantiles", F.array().cast("array<double>")).alias("quantiles"))


def six_numbers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, mean, median, p10, p90, max of the finite values."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    means = rows.groupBy(*keys).agg(F.avg(v).alias("mean")).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "mean")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"_m{i}").eqNullSafe(F.col(k))
    d = means.join(quantiles(rows, keys, v, [0.5, 0.1, 0.9]), on, "left")
    q = lambda i, name: F.try_element_at("quantiles", F.lit(i)).alias(name)
    return d.select(*[F.col(f"_m{i}").alias(k) for i, k in enumerate(keys)], "low", "mean", q(1, "median"), q(2, "p10"), q(3, "p90"), "high")


def null_rates(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, null_rate) in one pass."""
    d = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return d.unpivot([], cols, "column_name", "null_rate")


def conflicts(rows: DataFrame, group: list[str], labels: dict[str, Column]) -> DataFrame:
    """Per group: rows and distinct values of each label (nulls don't count)."""
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{n}") for n, c in labels.items()])


def conditional_entropy(rows: DataFrame, given: list[str], label: str) -> DataFrame:
    """One row: classes of ``given``, classes with two or more labels, and H(label | given) in nats. Two grouped counts, no pair of rows."""
    joint = rows.groupBy(*given, label).agg(F.count("*").alias("_n"))
    per = joint.groupBy(*given).agg(F.sum("_n").alias("_m"), F.count("*").alias("_k"), F.sum(F.col("_n") * F.ln("_n")).alias("_s"))
    open_part = F.sum(F.col("_m") * F.ln("_m") - F.col("_s")) / F.sum("_m")
    return per.agg(F.count("*").alias("n_classes"), F.count_if(F.col("_k") > 1).alias("n_conflicts"), open_part.alias("entropy"))


def feature_ladder(rows: DataFrame, levels: dict[str, list[str]], label: str) -> DataFrame:
    """(level, n_classes, n_conflicts, entropy) of growing feature sets."""
    return reduce(DataFrame.unionByName, [conditional_entropy(rows, cols, label).select(F.lit(n).alias("level"), "*") for n, cols in levels.items()])


def entropy(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n_labels, entropy): H(label) in nats per key; a null label counts as a label."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.count("*").alias("n_labels"), (F.ln(F.sum("_n")) - F.sum(F.col("_n") * F.ln("_n")) / F.sum("_n")).alias("entropy"))


def group_advantage(rows: DataFrame, group: str, value: str, eps: float = 1e-8) -> DataFrame:
    """Adds ``advantage``: the value's distance from its group's mean in population standard deviations, 0 where all tie."""
    w = Window.partitionBy(group)
    d = F.stddev_pop(value).over(w)
    return rows.withColumn("advantage", F.when(d <= eps, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / (d + eps)))


def best_choice(rows: DataFrame, group: list[str], choice: str, value: str) -> DataFrame:
    """Per group the choice with the highest mean value; the smallest choice wins ties."""
    means = rows.groupBy(*group, choice).agg(F.avg(value).alias("mean_value"))
    return means.groupBy(*group).agg(F.max_by(choice, F.struct("mean_value", -F.col(choice))).alias("best_choice"), F.max("mean_value").alias("best_value"))


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the commonest value; the smallest wins ties."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("top_value"), F.max("n").alias("top_count"))


def checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, n_failed, status): rows that break each rule (null counts as broken) and PASS or FAIL; one pass."""
    d = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    d = d.unpivot([], list(rules), "check_name", "n_failed")
    return d.withColumn("status", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))


def rank_by(rows: DataFrame, order: list[Column], n: int, whole: bool = False) -> DataFrame:
    """The first ``n`` rows in a total order; with ``whole`` fewer than ``n`` are an error."""
    d = rows.orderBy(*order).limit(n)
    if whole and (got := d.count()) < n:
        raise ValueError(f"{got} rows instead of {n}")
    return d


def pivot_deltas(rows: DataFrame, keys: list[str], case: str, cases: list[str], value: str) -> DataFrame:
    """Per key the value of each case side by side and its difference to the first case."""
    wide = rows.groupBy(*keys).pivot(case, cases).agg(F.first(value))
    return wide.select(*keys, *[F.col(c).alias(f"v_{c}") for c in cases], *[(F.col(c) - F.col(cases[0])).alias(f"d_{c}") for c in cases[1:]])


def largest_effects(deltas: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, largest absolute value of each column)."""
    return deltas.groupBy(*keys).agg(*[F.max(F.abs(F.col(c))).alias(f"max_abs_{c}") for c in cols])


def table_hash(rows: DataFrame) -> DataFrame:
    """One row (n_rows, digest) that doesn't depend on the order of rows or of columns; equal tables have equal digests."""
    cols = sorted(rows.columns)
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in cols]).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def metric_changes(recorded: DataFrame, computed: DataFrame, key: str, value: str, rel: float = 1e-9) -> DataFrame:
    """(key, recorded, computed, same) of two tables of metrics; a metric of one side only isn't the same."""
    a, b = recorded.select(key, F.col(value).alias("recorded")), computed.select(key, F.col(value).alias("computed"))
    same = F.coalesce(F.abs(F.col("recorded") - F.col("computed")) <= rel * (1 + F.abs("recorded")), F.col("recorded").isNull() & F.col("computed").isNull())
    return a.join(b, key, "full_outer").withColumn("same", same)
