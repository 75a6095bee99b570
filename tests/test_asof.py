"""Versions against brute force, with hot entities, ties, nulls and repeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.operators.asof import generator_state, known_at

GEN = "record_id bigint, generator_id string, dispatch_mw double, utilization double, headroom_mw double, own_lmp double, observation_timestamp timestamp, availability_timestamp timestamp, state_row_id string"
STATE = "state_row_id bigint, generator_id string, decision_cutoff_utc timestamp, record_id int"  # clashing names


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    t = lambda: None if rnd.random() < 0.08 else datetime(2022, 1, 1) + timedelta(hours=rnd.randrange(80))
    g = lambda: None if rnd.random() < 0.05 else rnd.choice(["HOT"] * 6 + ["B", "C"])
    gens = [(i, g(), 1.0 * i, 0.5, 1.0, None, t(), t(), "x") for i in range(300)]
    gens += gens[:20]
    states = [(i, g(), t(), 7) for i in range(120)]
    out = generator_state(spark.createDataFrame(states, STATE), spark.createDataFrame(gens, GEN)).select("state_row_id", "record_id").collect()
    want = set()
    for i, k, c, _ in states:
        known = [(r[6], r[7], r[0]) for r in gens if k is not None and c is not None and r[1] == k and r[6] and r[7] and r[6] <= c and r[7] <= c]
        if known:
            want.add((i, max(known)[2]))
    assert len(out) == len(want) and {tuple(r) for r in out} == want


def test_empty_and_later_only(spark):
    empty = spark.createDataFrame([], GEN)
    one = spark.createDataFrame([(1, "A", datetime(2022, 1, 1), 0)], STATE)
    assert generator_state(one, empty).count() == 0
    late = spark.createDataFrame([(1, "A", 1.0, 0.1, 1.0, 1.0, datetime(2022, 1, 2), datetime(2022, 1, 2), "x")], GEN)
    assert generator_state(one, late).count() == 0
    assert generator_state(spark.createDataFrame([], STATE), late).count() == 0


def test_bucket_width_changes_nothing(spark):
    ev = spark.range(50).select("id", F.lit("e").alias("k"), F.timestamp_seconds(F.col("id") * 7000).alias("t"))
    at = spark.range(40).select(F.col("id").alias("a"), F.lit("e").alias("k"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(300000))).alias("u"))
    run = lambda h: sorted(map(tuple, known_at(ev, "id", [F.col("k")], F.col("t"), at, [F.col("k")], F.col("u"), [F.col("u"), F.col("a")], {"a": F.col("a")}, h).collect()))
    assert run(1) == run(24) == run(100000)
