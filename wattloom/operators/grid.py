"""Irregular readings onto an hourly grid, with missing hours filled by low-rank factorisation or marked.

Readings become hourly means per source. Every source's hours from its first to its last form the grid. The matrix has
a row for each week of each source and a column for each hour of the week in each band of 52 weeks, so rows and
columns both grow with time; its cells are loads as logarithms less their source's mean. Alternating least squares
factorises it, so all sources and weeks of a band share the shapes of a week; a missing cell takes the product of its row's and its column's factors. Observed cells stay as they are. A cell whose
week has too few readings of its source, or whose hour of the week no row has, is not supported and stays marked.
(Rows of sources and columns of absolute hours fit far worse: sources rarely report at the same time.)

Bounds: the grid is exploded per source, so one source's span costs rows, not memory. Row numbers come from a
distributed ranking; nothing is collected. Empty input gives an empty result. Readings that don't count: null, NaN,
infinite or non-positive loads and readings without an instant. Repeats count once per row in the hour's mean.
"""

from __future__ import annotations

import math

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.times import HOUR_US
from wattloom.session import cut, ensure_checkpoint_dir


def hourly(readings: DataFrame) -> DataFrame:
    """(source, hour, load_mw, n): mean load per source and UTC hour of (source, utc_micros, load_mw); map-side combined."""
    good = F.col("utc_micros").isNotNull() & F.col("source").isNotNull() & (F.col("load_mw") > 0) & ~F.isnan("load_mw") & (F.col("load_mw") < float("inf"))
    hour = F.floor(F.col("utc_micros") / F.lit(HOUR_US)).cast("int")
    return readings.where(good).groupBy("source", hour.alias("hour")).agg(F.avg("load_mw").alias("load_mw"), F.count("*").alias("n"))


def gaps(cells: DataFrame) -> DataFrame:
    """(source, hour) of every missing hour between a source's first and last: each cell opens the gap up to the next one."""
    w = Window.partitionBy("source").orderBy("hour")
    d = cells.select("source", "hour", F.lead("hour").over(w).alias("_next")).where(F.col("_next") > F.col("hour") + 1)
    return d.select("source", F.explode(F.sequence(F.col("hour") + 1, F.col("_next") - 1)).alias("hour"))


def numbered(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, number): distinct rows numbered from 0 without a gap, by ranges of the sorted values."""
    d = cut(rows.select(*cols).distinct().repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()))
    sizes = d.groupBy("_p").count()
    start = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_start"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*cols)) - 1
    return d.withColumn("_i", within).join(start, "_p").select(*cols, (F.col("_start") + F.col("_i")).cast("int").alias("number"))


def regular_series(readings: DataFrame, rank: int = 4, iterations: int = 8, ridge: float = 0.002, min_readings: int = 12, period: int = 168, band: int = 52, seed: int = 11, block_cells: int = 250_000) -> DataFrame:
    """(source, hour, load_mw, how): the hourly series of (source, utc_micros, load_mw).

    ``how`` is ``observed``, ``filled`` or ``marked`` (load_mw null: no factor supports the cell). ``period`` is the
    width of a row: a source's stretch of so many hours; each ``band`` of so many stretches has columns of its own.
    ``block_cells`` sets the blocks of the factorisation: about so many readings go to a task.
    """
    cells = cut(hourly(readings))
    missing = gaps(cells)
    ensure_checkpoint_dir(cells.sparkSession)
    row = F.floor(F.col("hour") / F.lit(period)).cast("int")
    place = {"_row": row, "_col": (F.floor(row / F.lit(band)) * period + F.pmod("hour", F.lit(period))).cast("int")}
    placed = cells.withColumns(place)
    level = cells.groupBy("source").agg(F.avg(F.ln("load_mw")).alias("_level"))
    full = placed.groupBy("source", "_row").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_readings).select("source", "_row")
    known = full.join(numbered(full, ["source", "_row"]), ["source", "_row"]).join(level, "source")
    x = cut(placed.join(known, ["source", "_row"]).select("number", "_col", (F.ln("load_mw") - F.col("_level")).cast("float").alias("x")))
    seen = cells.select("source", "hour", "load_mw", F.lit("observed").alias("how"))
    n_cells = x.count()
    if not n_cells:
        return seen.unionByName(missing.select("source", "hour", F.lit(None).cast("double").alias("load_mw"), F.lit("marked").alias("how")))
    both = "MEMORY_AND_DISK_2"
    blocks = max(2, math.ceil(n_cells / block_cells))
    als = ALS(numUserBlocks=blocks, numItemBlocks=blocks, rank=rank, maxIter=iterations, regParam=ridge, userCol="number", itemCol="_col", ratingCol="x", seed=seed, checkpointInterval=5, intermediateStorageLevel=both, finalStorageLevel=both)
    model = als.fit(x)
    users = model.userFactors.select(F.col("id").alias("number"), F.col("features").alias("_u"))
    items = model.itemFactors.select(F.col("id").alias("_col"), F.col("features").alias("_v"))
    dot = F.aggregate(F.zip_with("_u", "_v", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, y: s + y)
    asked = missing.withColumns(place).join(known, ["source", "_row"], "left")
    filled = asked.join(users, "number", "left").join(items, "_col", "left").withColumn("load_mw", F.exp(F.col("_level") + dot))
    filled = filled.select("source", "hour", "load_mw", F.when(F.col("load_mw").isNull(), "marked").otherwise("filled").alias("how"))
    return seen.unionByName(filled)
