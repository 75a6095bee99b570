"""Connected components of records that share a key, and of any edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from wattloom.session import cut_table


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, for an edge list (a, b) of bigints.

    Alternating large-star and small-star steps: each is one grouped minimum (combined before the shuffle) and one
    join; a hub with any share of the edges is split by the adaptive skew join. Ends when the edges stop changing.
    """
    e = cut_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut_table(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def related(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(row_id, root): records tied by an equal value in any of ``keys``, passed on; root is the group's smallest row id.

    ``row_id`` is unique; a null key relates nothing. Each key's rows are first contracted to the smallest row id that
    has the value, so edges run between such representatives only.
    """
    d = rows.select(F.col(row_id).cast("bigint").alias("row_id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    d = cut_table(d)
    for i in range(len(keys)):
        first = d.where(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").agg(F.min("row_id").alias(f"r{i}"), F.count("*").alias(f"n{i}"))
        # a null key meets nothing; the row's id beside it keeps such rows from meeting in one task
        apart = F.when(F.col(f"k{i}").isNull(), F.col("row_id")).otherwise(F.lit(0))
        d = d.withColumn("_apart", apart).join(first.withColumn("_apart", F.lit(0).cast("bigint")), [f"k{i}", "_apart"], "left").drop("_apart")
    reps = [F.when(F.col(f"n{i}") > 1, F.col(f"r{i}")) for i in range(len(keys))]  # a value of one row ties nothing
    d = cut_table(d.select("row_id", F.coalesce(*reps, F.col("row_id")).alias("home"), *[r.alias(f"r{i}") for i, r in enumerate(reps)]))
    edges = None
    for i in range(1, len(keys)):
        e = d.where(F.col(f"r{i}") != F.col("home")).select(F.col("home").alias("a"), F.col(f"r{i}").alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    if edges is None:
        return d.select("row_id", F.col("home").alias("root"))
    roots = components(edges)
    return d.join(roots, d["home"] == roots["node"], "left").select("row_id", F.coalesce("root", "home").alias("root"))
