"""Items of varying length into containers of fixed capacity, by vector best-fit.

An item takes tokens, one document place and attention cost (its tokens squared) of a container; a container has a
residual capacity of each. Longest first, an item goes to the open container that it fits under every constraint and
that is left with the smallest weighted norm of its residual shares; if there is none, a new one is opened. An item
longer than a container is cut: whole containers first, the rest is placed like any item. Nothing else is split.

Places and attention are measured by the items themselves: a container has ``PLACES`` times the places that items of
mean size need to fill it, and what is put beside its first item may cost ``ATTENTION`` times what the same tokens cost
on average (the items' tokens squared over their tokens). So long items are kept apart and joined by short ones, and the
short ones don't pile up in a few containers.

The items are dealt by a hash to shards of about ``shard_items`` items and each shard fills its own containers, so no
task holds more than a shard; a shard leaves at most a few containers half empty. Null and empty texts have no tokens:
they take a document place only and are placed like the rest. Ties go by id. An empty table gives an empty result;
rows with the same id are separate items; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = (1.0, 0.02, 0.02)  # of residual tokens, document places, attention cost in the norm
PLACES, ATTENTION = 6.0, 1.5  # places relative to a container of mean items, attention cost relative to the mean of as many tokens
MOST_KINDS = 1000
_OUT = "container_kind string, shard int, container_no int, doc_id bigint, piece_no int, first_token int, n_tokens int"


def best_fit(size: np.ndarray, capacity: int, places: float, rate: float, weights: np.ndarray) -> np.ndarray:
    """Container number of each item (tokens, in the order to be placed); ``rate`` is the attention cost allowed per token beside the first item.

    An item always fits an empty container.
    """
    need = np.stack([size, np.ones(len(size)), size.astype(float) ** 2], 1)
    full = np.array([capacity, places, max(capacity * rate, 1.0)])
    where = np.empty(len(need), np.int64)
    left = np.empty((256, 3))
    number = np.empty(256, np.int64)
    n_open = opened = 0
    smallest = np.minimum.accumulate(need[::-1, 0])[::-1] if len(need) else need
    scale = weights / full
    for i, item in enumerate(need):
        if i % 512 == 511:  # containers that nothing fits any more are closed
            keep = np.flatnonzero((left[:n_open, 0] >= smallest[i]) & (left[:n_open, 1] >= 1))
            left[: len(keep)], number[: len(keep)], n_open = left[keep], number[keep], len(keep)
        r = left[:n_open] - item
        fits = np.flatnonzero((r >= 0).all(1))
        if len(fits):
            x = r[fits] * scale
            at = fits[np.argmin(np.einsum("ij,ij->i", x, x))]
            left[at] -= item
        else:
            if n_open == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            at = n_open
            left[at], number[at] = (capacity - item[0], places - 1, (capacity - item[0]) * rate), opened
            n_open, opened = n_open + 1, opened + 1
        where[i] = number[at]
    return where


def pack(items: DataFrame, kinds: DataFrame, shard_items: int = 4000, weights: tuple[float, float, float] = WEIGHTS, places: float = PLACES, attention: float = ATTENTION) -> DataFrame:
    """Placements of (doc_id, n_tokens) in containers of (container_kind, capacity_tokens), each kind on its own.

    ``items`` is read twice: for its size and means, and to be placed. ``kinds`` is a table of a few rows; more than
    ``MOST_KINDS`` raise an error.
    """
    specs = [(r[0], int(r[1])) for r in kinds.select("container_kind", "capacity_tokens").dropna().distinct().orderBy("container_kind").limit(MOST_KINDS + 1).collect()]
    if len(specs) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    rest = {cap: F.when(F.col("n_tokens") % cap == 0, F.least("n_tokens", F.lit(cap))).otherwise(F.col("n_tokens") % cap).cast("double") for _, cap in specs}
    sums = items.agg(F.count("*").alias("n"), *[x for cap, r in rest.items() for x in (F.sum(r).alias(f"a{cap}"), F.sum(r * r).alias(f"b{cap}"))]).first()
    shards = max(1, math.ceil(sums["n"] / shard_items))
    w = np.array(weights)
    limits = {}
    for cap in rest:
        tokens, squares = sums[f"a{cap}"] or 1.0, sums[f"b{cap}"] or 1.0
        limits[cap] = (max(1.0, math.ceil(places * cap * sums["n"] / tokens)), attention * squares / tokens)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["_shard"].iloc[0])
        ids, size = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
        out = []
        for kind, cap in specs:
            whole, rest = size // cap, size % cap
            whole, rest = np.where((rest == 0) & (size > 0), whole - 1, whole), np.where((rest == 0) & (size > 0), cap, rest)
            order = np.lexsort((ids, -rest))
            where = best_fit(rest[order], cap, *limits[cap], w)
            out.append(pd.DataFrame({"container_kind": kind, "container_no": where, "doc_id": ids[order], "piece_no": whole[order], "first_token": whole[order] * cap, "n_tokens": rest[order]}))
            cut = np.repeat(np.arange(len(ids)), whole)
            if len(cut):
                piece = np.arange(len(cut)) - np.repeat(np.cumsum(whole) - whole, whole)
                base = int(where.max()) + 1
                out.append(pd.DataFrame({"container_kind": kind, "container_no": base + np.arange(len(cut)), "doc_id": ids[cut], "piece_no": piece, "first_token": piece * cap, "n_tokens": cap}))
        d = pd.concat(out)
        d.insert(1, "shard", shard)
        return d

    dealt = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("_shard"))
    # by number, so that small but slow shards aren't coalesced into a few tasks
    return dealt.repartition(shards, "_shard").groupBy("_shard").applyInPandas(fill, _OUT)
