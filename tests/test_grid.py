"""The hourly grid: gaps by brute force, observed cells exact, filled cells better than the source's mean."""

import math
import random

from wattloom.functions.times import HOUR_US
from wattloom.operators.grid import gaps, hourly, regular_series

SCHEMA = "source string, utc_micros bigint, load_mw double"


def test_hourly_and_gaps(spark):
    h = lambda x: int(x * HOUR_US)
    rows = [("a", h(0.1), 1.0), ("a", h(0.9), 3.0), ("a", h(3), 5.0), ("a", h(1), float("nan")), ("a", h(2), -1.0), ("a", None, 9.0), ("a", h(1), float("inf")), ("a", h(1), None), ("b", h(7), 1.0), (None, h(1), 2.0)]
    cells = hourly(spark.createDataFrame(rows, SCHEMA))
    assert {(r.source, r.hour, r.load_mw, r.n) for r in cells.collect()} == {("a", 0, 2.0, 2), ("a", 3, 5.0, 1), ("b", 7, 1.0, 1)}
    assert sorted((r.source, r.hour) for r in gaps(cells).collect()) == [("a", 1), ("a", 2)]


def test_filling_beats_the_mean(spark):
    rnd = random.Random(4)
    truth, rows = {}, []
    for s in range(25):
        level, amp, phase = rnd.uniform(4, 8), rnd.uniform(0.1, 0.5), rnd.choice([0.0, 0.5])
        for t in range(240):
            truth[f"s{s}", t] = math.exp(level + amp * math.sin(2 * math.pi * t / 24 + phase) + 0.01 * rnd.gauss(0, 1))
            if t in (0, 239) or rnd.random() > 0.15:
                rows.append((f"s{s}", t * HOUR_US, truth[f"s{s}", t]))
    out = regular_series(spark.createDataFrame(rows, SCHEMA), rank=4, iterations=8).collect()
    seen = {(r[0], r[1] // HOUR_US): r[2] for r in rows}
    assert len(out) == 25 * 240 and {r.how for r in out} == {"observed", "filled"}
    assert all(abs(r.load_mw - seen[r.source, r.hour]) < 1e-9 for r in out if r.how == "observed")
    mean = {s: sum(math.log(v) for (k, _), v in seen.items() if k == s) / sum(k == s for k, _ in seen) for s in {k for k, _ in seen}}
    err = lambda f: math.sqrt(sum((f(r) - math.log(truth[r.source, r.hour])) ** 2 for r in out if r.how == "filled"))
    assert err(lambda r: math.log(r.load_mw)) < 0.3 * err(lambda r: mean[r.source])


def test_unsupported_cells_stay_marked(spark):
    rows = [("a", t * HOUR_US, 10.0 + t) for t in range(40) if t != 20]
    out = regular_series(spark.createDataFrame(rows, SCHEMA)).where("how <> 'observed'").collect()
    assert [(r.source, r.hour, r.load_mw, r.how) for r in out] == [("a", 20, None, "marked")]


def test_empty(spark):
    assert regular_series(spark.createDataFrame([], SCHEMA)).count() == 0
    assert regular_series(spark.createDataFrame([("a", 1, 1.0), ("a", 5 * HOUR_US, 1.0)], SCHEMA)).groupBy("how").count().count() == 2
