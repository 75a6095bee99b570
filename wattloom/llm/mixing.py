"""Records of several sources mixed to target shares of all tokens, by Sainte-Lague apportionment.

The total is the largest at which no source needs a record more often than allowed. It is cut into blocks of equal
tokens; the blocks go to the sources by their highest quotients. A source's blocks go to its shards by the same rounding
of the running sums of their tokens, so the shards' quotas add up to the source's. Within a shard the records are taken
in the order of a seeded hash, all of them as many times as the quota allows and then once more as far as the rest of
the quota reaches, a record too long for it not stopping the next; one record of the size closest to what is still
open completes it.

The driver sees one row per source. A source with any share of all rows is spread over shards of about
``shard_tokens`` tokens, as many as it takes. Records without tokens, of a null source, or of a source without a target
are not chosen; a source with a target but no tokens gets no blocks and its share goes to the rest. Ties in the hash go
by id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SOURCES = 1000


def sainte_lague(seats: int, votes: list[float], most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 seats + 1), no party above ``most``; ties go to the earlier party."""
    got = [0] * len(votes)
    seats = min(seats, sum(m for m, v in zip(most, votes) if v > 0))
    total = sum(v for v in votes if v > 0)
    if seats > 4 * len(votes) and total > 0:  # all but the last few seats follow from a divisor that hands out too few
        low, high = 0.0, 1.0
        take = lambda d: [min(m, max(0, math.floor(v * d / 2 + 0.5))) if v > 0 else 0 for v, m in zip(votes, most)]
        while sum(take(high)) < seats:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(take(mid)) <= seats else (low, mid)
        got = take(low)
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v > 0 and g < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix(records: DataFrame, targets: DataFrame, block_tokens: int = 256, shard_tokens: int = 2_000_000, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, n_uses) of the chosen records of (doc_id, source, n_tokens).

    ``targets``: (source, target_share, max_repeats), a table of a few rows; more than ``MOST_SOURCES`` raise an error.
    """
    listed = targets.select("source", "target_share", "max_repeats").dropna().where("target_share > 0 AND max_repeats > 0").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in listed}
    known = records.where((F.col("n_tokens") > 0) & F.col("source").isin(list(want)))
    supply = {r["source"]: r["tokens"] for r in known.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # one row per target
    names = sorted(supply)
    share = sum(want[s][0] for s in names)
    goal = min((supply[s] * want[s][1] * share / want[s][0] for s in names), default=0)
    quota = sainte_lague(int(goal // block_tokens), [want[s][0] for s in names], [supply[s] * want[s][1] // block_tokens for s in names])
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for s, v in zip(names, values) for x in (s, v)]) if names else F.create_map().cast("map<string,bigint>"), "source").cast("bigint")

    shards = of([max(1, math.ceil(supply[s] / shard_tokens)) for s in names])
    fine = known.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), shards))
    held = fine.groupBy("source", "_shard").agg(F.sum("n_tokens").alias("_tokens"))
    upto = F.sum("_tokens").over(Window.partitionBy("source").orderBy("_shard"))  # one row per shard
    seats = lambda tokens: F.floor((2 * of(quota) * tokens + of([supply[s] for s in names])) / (2 * of([supply[s] for s in names])))
    plan = held.withColumn("_upto", upto).withColumn("_quota", (seats(F.col("_upto")) - seats(F.col("_upto") - F.col("_tokens"))) * block_tokens)
    plan = plan.select("source", "_shard", F.floor(F.col("_quota") / F.col("_tokens")).alias("_full"), (F.col("_quota") % F.col("_tokens")).alias("_rest"))
    d = fine.withColumns({"_hash": F.xxhash64("doc_id", F.lit(seed)), "_most": of([want[s][1] for s in names])}).join(plan, ["source", "_shard"])
    kinds = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "n_tokens"))
    return d.groupBy("source", "_shard").applyInPandas(_fill, f"{kinds}, n_uses int")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of one shard that its quota takes, and how often."""
    pdf = pdf.sort_values(["_hash", "doc_id"])
    n, full, most = pdf["n_tokens"].to_numpy(), int(pdf["_full"].iloc[0]), int(pdf["_most"].iloc[0])
    gap, taken = int(pdf["_rest"].iloc[0]), np.zeros(len(n), bool)
    while (fits := ~taken & (n <= gap)).any():  # each round takes one record at least
        now = fits & (np.cumsum(np.where(fits, n, 0)) <= gap)
        taken |= now
        gap -= int(n[now].sum())
    off = np.where(taken, gap, np.abs(n - gap))
    if gap and off.min() < gap:
        taken[off.argmin()] = True
    uses = min(full, most) + (taken if full < most else 0)
    return pdf.assign(n_uses=np.broadcast_to(uses, len(n)).astype(np.int32))[["doc_id", "source", "n_tokens", "n_uses"]].query("n_uses > 0")


def mix_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, n_records, most_uses) per source with a target."""
    per = chosen.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("n_uses")).alias("tokens"), F.count("*").alias("n_records"), F.max("n_uses").alias("most_uses"))
    all_tokens = per.agg(F.sum("tokens").alias("_all"))
    d = targets.join(per, "source", "left").join(F.broadcast(all_tokens))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("n_records"), zero("most_uses"))
