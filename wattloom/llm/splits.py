"""Train, validation and test splits that keep related records together, by grouped iterative stratification.

Related records (same key value, passed on) form components; each component carries the vector of its records' label
counts. Components are placed whole: the label with the fewest records still to place goes first, each of its
components (largest share first) into the split that lacks most of that label, then most records, then by order.

One component that holds more than ``COARSE`` of what the smallest split wants of a label decides that label's balance.
There can't be more such components than labels / (COARSE x the smallest share), whatever the size of the table (for a
rare label all of its components are such), so they are placed first, all together, against the global wants. The rest
is fine-grained in every label. It is dealt to shards of about ``shard_rows`` rows by a hash, and each shard places its
components by the same rule against its quotas: a label's open wants run through all shards in their order and each
shard gets the whole records between the rounded sums before and after it, so the quotas add up to the wants even where
a shard has one record of a label. No group, and no list of all components, goes to one task or the driver.

Nulls: a null key relates nothing, a null label counts as its own label. Repeated rows tie by their keys or stand
alone. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.components import related
from wattloom.session import cut_table

COARSE, MOST_LABELS = 0.05, 200
NAMES, SHARES = ("train", "validation", "test"), (0.8, 0.1, 0.1)


def place(counts: np.ndarray, want: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The split of each component (rows of ``counts``, one column per label, the last one all records), given the records each split wants of each label (splits x labels) and those still to place of each, here or elsewhere."""
    want, left = want.astype(float).copy(), (counts.sum(0) if left is None else left).astype(float)
    done = np.full(len(counts), -1)
    by_label = [np.flatnonzero(counts[:, j]) for j in range(counts.shape[1])]
    by_label = [x[np.argsort(-counts[x, j], kind="stable")] for j, x in enumerate(by_label)]
    for _ in range(counts.shape[1]):
        open_labels = np.flatnonzero(left > 0)
        if not len(open_labels):
            break
        label = open_labels[np.argmin(left[open_labels])]
        for c in by_label[label]:
            if done[c] < 0:
                need = want[:, label]
                best = np.flatnonzero(need >= need.max() - 1e-9)
                s = best[np.argmax(want[best, -1])] if len(best) > 1 else best[0]
                done[c] = s
                want[s] -= counts[c]
                left -= counts[c]
        left[label] = 0
    return done


def assign_splits(rows: DataFrame, row_id: str, keys: list[str], labels: list[str], shares: tuple[float, ...] = SHARES, names: tuple[str, ...] = NAMES, shard_rows: int = 100_000) -> DataFrame:
    """(row_id, component, new_split) of every row; records tied by ``keys`` share a split, labels are spread by ``shares``.

    ``labels`` are columns with at most ``MOST_LABELS`` values together; more raise an error (their totals and the
    vectors of coarse components are read by the driver).
    """
    comp = related(rows, row_id, keys)
    tags = F.array(*[F.concat_ws("=", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("(null)"))) for c in labels])
    tagged = rows.select(F.col(row_id).cast("bigint").alias("row_id"), tags.alias("_tags")).join(comp, "row_id")
    long = tagged.select("root", F.explode(F.concat("_tags", F.array(F.lit("")))).alias("label"))
    per = cut_table(long.groupBy("root", "label").agg(F.count("*").alias("n")))
    sums = per.groupBy("label").agg(F.sum("n").alias("n")).limit(MOST_LABELS + 2).collect()
    totals = {r["label"]: r["n"] for r in sums}
    if len(totals) > MOST_LABELS + 1:
        raise ValueError(f"{labels} have more than {MOST_LABELS} values")
    order = sorted(k for k in totals if k) + [""]
    if not totals:
        return comp.select("row_id", F.col("root").alias("component"), F.lit(names[0]).alias("new_split"))
    share = np.array(shares, float)
    want = share[:, None] * np.array([totals[k] for k in order], float)[None, :]

    of_label = lambda values: F.create_map(*[x for k, v in zip(order, values) for x in (F.lit(k), F.lit(v))])[F.col("label")]
    number = of_label(range(len(order))).alias("k")
    coarse = per.where(F.col("n") >= of_label([COARSE * float(share.min()) * totals[k] for k in order])).select("root").distinct()
    long_rows = per.join(coarse, "root").select("root", number, "n").collect()  # at most labels / (COARSE x smallest share) components
    fixed = {}
    if long_rows:
        roots = sorted({r["root"] for r in long_rows})
        at = {r: i for i, r in enumerate(roots)}
        counts = np.zeros((len(roots), len(order)), np.int64)
        for r in long_rows:
            counts[at[r["root"]], r["k"]] = r["n"]
        to = place(counts, want, want.sum(0))
        for s, v in zip(to, counts):
            want[s] -= v
        fixed = {r: names[s] for r, s in zip(roots, to)}
    need = np.maximum(want, 0)
    total = need.sum(0)
    ratio = np.where(total > 0, need / np.where(total > 0, total, 1), share[:, None])

    shards = max(1, math.ceil(totals[""] / shard_rows))
    rest = per.join(coarse, "root", "left_anti").withColumn("_shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
    # a label's quotas of a shard: the records of the running sums, rounded for each split with an offset of its own so that splits take turns
    sizes = rest.groupBy("_shard", "label").agg(F.sum("n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("label").orderBy("_shard"))  # one row per shard and label
    quota = []
    for j in range(len(names)):
        r, turn = of_label([float(x) for x in ratio[j]]), F.lit((j + 0.5) / len(names))
        quota.append((F.floor(F.col("_upto") * r + turn) - F.floor((F.col("_upto") - F.col("_n")) * r + turn)).cast("double"))
    quotas = sizes.withColumn("_upto", upto).select("_shard", number, F.array(*quota).alias("q")).groupBy("_shard").agg(F.collect_list(F.struct("k", "q")).alias("quotas"))  # labels

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, row = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(roots), len(order)), np.int64)
        counts[row, pdf["k"].to_numpy()] = pdf["n"].to_numpy()
        mine = np.zeros((len(names), len(order)))
        for x in pdf["quotas"].iloc[0]:
            mine[:, x["k"]] = x["q"]
        return pd.DataFrame({"root": roots, "new_split": [names[s] for s in place(counts, mine, total)]})

    dealt = rest.select("_shard", "root", number, "n").join(quotas, "_shard")
    placed = dealt.groupBy("_shard").applyInPandas(shard, "root bigint, new_split string")
    if fixed:
        placed = placed.unionByName(rows.sparkSession.createDataFrame(list(fixed.items()), "root bigint, new_split string"))
    return comp.join(cut_table(placed), "root").select("row_id", F.col("root").alias("component"), "new_split")


def leaks(rows: DataFrame, row_id: str, keys: list[str], split: str) -> DataFrame:
    """(group_first_id, row_id): every record of a group of related records that has two or more splits."""
    comp = related(rows, row_id, keys)
    d = comp.join(rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(split).alias("_split")), "row_id")
    mixed = d.groupBy("root").agg(F.min("_split").alias("_a"), F.max("_split").alias("_b")).where("_a <> _b").select("root")
    return comp.join(mixed, "root", "left_semi").select(F.col("root").alias("group_first_id"), "row_id")
