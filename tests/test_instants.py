"""Time texts against an independent row-by-row reading, and the path's choices."""

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest

from wattloom.functions import time_texts as T
from wattloom.operators.instants import lmp_instants, load_instants, path

NY = ZoneInfo("America/New_York")
LMP = "lmp_row_id bigint, interval_start_utc string, location string, target_local_date string, target_he int"
LOAD = "reading_id bigint, load_source string, feed_id string, timestamp_utc string"
CLOCK = "feed_id string, bare_zone string, date_order string"


def micros(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


def fields(utc):
    local = datetime.fromtimestamp(utc / 1e6, NY)
    return local.date().isoformat(), local.hour + 1


def test_shapes():
    texts = [
        "2020-01-01T01:00:00-05:00", " 2021-08-22 08:00:00 ", "20260414060000", "20200226T130000-0500", "1682856000000", "1661335200", "1577887200000000", "Thu, 22 May 2025 06:00:00 GMT",
        "3 Sep 2021, 02:00 AM", "16-jun-2023 07:00 EDT", "07/23/2022 06:00:00 PM", "2020/04/07 03:00:00 AM EDT", "2022-08-15T18:00:00.123Z", "2023-01-01 00:00:00.123456 UTC",
        "24:61", "0000-00-00 00:00:00", "2023-02-30T05:00:00Z", "", None, "13:00", "2024-01-01 24:00", "12/31/99 10:00", "2024-01-01 13:00 PM",
    ]
    p = T.parse(pa.array(texts))
    epoch = {4: 1682856000000000, 5: 1661335200000000, 6: 1577887200000000}
    assert {i: int(p.epoch[i]) for i in range(len(texts)) if p.has_epoch[i]} == epoch
    walls = {
        0: micros(2020, 1, 1, 1), 1: micros(2021, 8, 22, 8), 2: micros(2026, 4, 14, 6), 3: micros(2020, 2, 26, 13), 7: micros(2025, 5, 22, 6), 8: micros(2021, 9, 3, 2), 9: micros(2023, 6, 16, 7),
        10: micros(2022, 7, 23, 18), 11: micros(2020, 4, 7, 3), 12: micros(2022, 8, 15, 18) + 123000, 13: micros(2023, 1, 1) + 123456,
    }
    assert {i: int(p.walls[0][0][i]) for i in range(len(texts)) if p.walls[0][1][i]} == walls
    assert [i for i in range(len(texts)) if p.walls[1][1][i]] == []  # 23 is no month
    hours = {0: -5, 3: -5, 7: 0, 9: -4, 11: -4, 12: 0, 13: 0}
    assert {i: int(p.offset[i]) // T.HOUR_US for i in walls if p.has_offset[i]} == hours


@pytest.mark.parametrize("zone", ["America/New_York", "America/Chicago", "-06:00", "UTC"])
def test_walls_have_every_instant(zone):
    import numpy as np

    wall = np.array([micros(2023, 3, 12, 2, 30), micros(2023, 11, 5, 1, 30), micros(2023, 7, 1, 12)], np.int64)
    cands = T.instants_of_wall(wall, np.ones(3, bool), zone)
    got = [sorted(int(u[i]) for u, ok in cands if ok[i]) for i in range(3)]
    z = ZoneInfo(zone) if zone[0].isalpha() else None
    for i, w in enumerate(wall):
        want = [u for h in range(-12, 13) if (u := int(w) + h * T.HOUR_US) is not None and (int(T.local_of(np.array([u]), zone)[0]) == w)]
        assert got[i] == want
        if z:
            assert all(datetime.fromtimestamp(u / 1e6, z).replace(tzinfo=UTC).timestamp() * 1e6 == w for u in got[i])


def test_lmp(spark):
    fold = (date(2023, 11, 5).isoformat(), 2)
    rows = [
        (0, "2020-01-01T01:00:00-05:00", "A", "1999-01-01", 9),  # a zone says it all
        (1, "2021-08-22 08:00:00", "A", "2021-08-22", 5),  # UTC
        (2, "2021-08-22 08:00:00", "A", "2021-08-22", 9),  # New York
        (3, "2021-08-22 08:00:00", "A", None, None),
        (4, "2021-08-22 08:00:00", "A", "2021-08-22", 20),  # contradicts both
        (5, "05/06/2022 10:00", "B", "2022-05-06", 11),
        (6, "05/06/2022 10:00", "B", "2022-06-05", 11),
        (7, "05/06/2022 10:00 EDT", "B", None, None),  # two orders
        (8, "05/05/2022 10:00 EDT", "B", None, None),  # one, whatever the order
        (9, None, "B", "2022-05-06", 11),
        (10, "2023-02-30T05:00:00Z", "B", "2023-03-01", 1),  # no real date: the target hour counts
        (11, "see note", "B", *fold),  # that hour comes twice
        (12, "2023-11-05 01:30:00", "B", *fold),
        (13, "n/a", "B", "2023-03-12", 3),  # that hour is skipped
        (14, "n/a", None, None, None),
        (15, "junk", "B", "no date", 4),
    ]
    got = {r.row_id: r for r in lmp_instants(spark.createDataFrame(rows, LMP)).collect()}
    exact = {
        0: micros(2020, 1, 1, 6), 1: micros(2021, 8, 22, 8), 2: micros(2021, 8, 22, 12), 5: micros(2022, 5, 6, 14), 6: micros(2022, 6, 5, 14), 8: micros(2022, 5, 5, 14),
        9: micros(2022, 5, 6, 14), 10: micros(2023, 3, 1, 5),
    }
    assert {k: r.utc_micros for k, r in got.items() if r.status == "exact"} == exact
    assert {k for k, r in got.items() if r.status == "undecidable"} == {4, 13, 14, 15}
    assert sorted(got[11].alternatives) == [micros(2023, 11, 5, 5), micros(2023, 11, 5, 6)]
    assert len(got) == len(rows)


def test_load_and_blocks(spark):
    clock = spark.createDataFrame([("N", "America/New_York", "MDY"), ("D", "UTC", "DMY"), ("Y", "-06:00", "YMD")], CLOCK)
    start = datetime(2023, 11, 5, 3, tzinfo=UTC)
    local = [(start + timedelta(minutes=20 * i)).astimezone(NY) for i in range(18)]
    rows = [(i, "S", "N", t.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(local)]
    rows += [(100, "T", "D", "05/06/2022 10:00"), (101, "T", "Y", "2022/06/05 10:00"), (102, "T", "Y", "05/06/2022 10:00"), (103, "T", "?", "2022-01-01 00:00"), (104, "T", None, "2022-01-01T00:00Z"), (105, None, "N", None)]
    df = spark.createDataFrame(rows, LOAD)
    picks = []
    for parts in (None, 1, 3, 24):  # however rows are cut: the same rows
        got = {r.row_id: r for r in load_instants(df, clock, parts=parts).collect()}
        picks.append({k: r.utc_micros for k, r in got.items()})
        assert got[100].utc_micros == micros(2022, 6, 5, 10) and got[101].utc_micros == micros(2022, 6, 5, 16)
        assert got[102].status == got[103].status == got[105].status == "undecidable" and got[104].status == "exact"
        twice = {i for i, t in enumerate(local) if t.hour == 1}
        assert {i for i in range(18) if got[i].status == "likely"} == twice
    assert all(p == picks[0] for p in picks)
    # in record order the doubled hour is told apart: the path doesn't jump back
    got = {r.row_id: r.utc_micros for r in load_instants(df, clock).collect()}
    assert [got[i] for i in range(18)] == [int((start + timedelta(minutes=20 * i)).timestamp()) * 1_000_000 for i in range(18)]


def test_path_penalties():
    h = T.HOUR_US
    assert path([([10 * h, 5 * h], [1, 2])], 9 * h, 1, 11 * h) == [10 * h]
    assert path([([10 * h, 4 * h], [1, 2])], 3 * h, 2, 5 * h) == [4 * h]


def test_empty(spark):
    assert lmp_instants(spark.createDataFrame([], LMP)).count() == 0
    assert load_instants(spark.createDataFrame([], LOAD), spark.createDataFrame([], CLOCK)).count() == 0
