"""Arrow kernels that read a batch of time texts; all of them work on whole columns.

They run inside Spark's Arrow batches: as generated JVM code the same parsing outgrows what the JIT compiles.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# North American zone abbreviations and their offsets in hours.
ZONE_HOURS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
# English month abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_ZONE = r"\s*(?P<zone>Z|UTC|GMT|[ECMP][SD]T|[+-]\d{2}:?\d{2})?$"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<us>\d{1,9}))?)?\s*(?P<half>AM|PM)?"
SHAPES = {
    "iso": rf"^(?P<a>\d{{4}})-(?P<b>\d{{1,2}})-(?P<c>\d{{1,2}})[T ]{_CLOCK}{_ZONE}",
    "compact": rf"^(?P<a>\d{{4}})(?P<b>\d{{2}})(?P<c>\d{{2}})[T ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:\.(?P<us>\d{{1,9}}))?(?P<half>){_ZONE}",
    "slash": rf"^(?P<a>\d{{1,4}})/(?P<b>\d{{1,2}})/(?P<c>\d{{1,4}}),? {_CLOCK}{_ZONE}",
    "month": rf"^(?:[A-Z]{{3,9}},? )?(?P<c>\d{{1,2}})[- ](?P<b>[A-Z]{{3}})[A-Z]*[- ,]+(?P<a>\d{{4}}),? {_CLOCK}{_ZONE}",
}
_EPOCH = r"^(?P<n>\d{10}|\d{13}|\d{16})$"


def _numbers(x: pa.Array) -> np.ndarray:
    return pc.cast(pc.if_else(pc.equal(x, ""), "0", x), pa.int64()).to_numpy(zero_copy_only=False)


def days_of(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date is real."""
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    months = np.where(ok, (year - 1970) * 12 + month - 1, 0).astype("datetime64[M]")
    first = months.astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[D]").astype(np.int64) - first
    return first + np.where(ok, day, 1) - 1, ok & (day <= length)


class Parsed:
    """What a column of texts says: ``epoch`` an instant; or ``walls``, wall times (month first or the only order; day first), and ``offset``, the zone's offset. Each comes with a mask of the rows that have it."""

    def __init__(self, n: int) -> None:
        self.epoch, self.has_epoch = np.zeros(n, np.int64), np.zeros(n, bool)
        self.walls = [(np.zeros(n, np.int64), np.zeros(n, bool)) for _ in range(2)]
        self.offset, self.has_offset = np.zeros(n, np.int64), np.zeros(n, bool)
        self.slash = np.zeros(n, bool)  # the order of day and month has to be told


def parse(texts: pa.Array) -> Parsed:
    """Read texts of every known shape; case and blanks don't matter."""
    out = Parsed(len(texts))
    t = pc.utf8_upper(pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, r"\s+", " ")))
    left = np.flatnonzero(pc.is_valid(t).to_numpy(zero_copy_only=False))
    rest = t.take(pa.array(left))
    for name, pattern in [*SHAPES.items(), ("epoch", _EPOCH)]:
        if not len(left):
            break
        got = pc.extract_regex(rest, pattern)
        hit = pc.is_valid(got).to_numpy(zero_copy_only=False)
        rows, f = left[hit], got.filter(pa.array(hit))
        left, rest = left[~hit], rest.filter(pa.array(~hit))
        if not len(rows):
            continue
        if name == "epoch":
            n = f.field("n")
            size = pc.utf8_length(n).to_numpy(zero_copy_only=False)
            out.epoch[rows] = _numbers(n) * np.where(size == 10, 1_000_000, np.where(size == 13, 1_000, 1))
            out.has_epoch[rows] = True
        else:
            _walls(out, name, rows, f)
    return out


def _walls(out: Parsed, name: str, rows: np.ndarray, f: pa.StructArray) -> None:
    a, c = f.field("a"), f.field("c")
    if name == "month":
        code = f.field("b").dictionary_encode()
        b = np.array([MONTHS.index(m) + 1 if m in MONTHS else 0 for m in code.dictionary.to_pylist()] or [0])[code.indices.to_numpy(zero_copy_only=False)]
    else:
        b = _numbers(f.field("b"))
    h, mi, s = (_numbers(f.field(k)) for k in ("h", "mi", "s"))
    us = _numbers(pc.utf8_rpad(pc.utf8_slice_codeunits(f.field("us"), 0, 6), 6, "0"))
    half = f.field("half")
    pm, am = (pc.equal(half, k).to_numpy(zero_copy_only=False) for k in ("PM", "AM"))
    clock = (h <= 23) & (mi <= 59) & (s <= 59) & (~(am | pm) | ((h >= 1) & (h <= 12)))
    h = np.where(am | pm, h % 12 + 12 * pm, h)
    time_us = (h * 3600 + mi * 60 + s) * 1_000_000 + us
    a_len, c_len = (pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (a, c))
    a, c = _numbers(a), _numbers(c)
    told = np.zeros(len(rows), bool)
    if name == "slash":
        told = (c_len == 4) & (a_len <= 2)
        clock = clock & (told | ((a_len == 4) & (c_len <= 2)))
    for k, (y, mo, d, which) in enumerate(((np.where(told, c, a), np.where(told, a, b), np.where(told, b, c), clock), (c, b, a, clock & told))):
        days, real = days_of(y, mo, d)
        wall, has = out.walls[k]
        wall[rows], has[rows] = days * DAY_US + time_us, real & which
    out.slash[rows] = told
    zone = f.field("zone").dictionary_encode()
    offsets = [_offset_of(z) for z in zone.dictionary.to_pylist()] or [None]
    at = zone.indices.to_numpy(zero_copy_only=False)
    out.offset[rows] = np.array([x or 0 for x in offsets], np.int64)[at]
    out.has_offset[rows] = np.array([x is not None for x in offsets])[at]


def _offset_of(zone: str) -> int | None:
    if not zone:
        return None
    if zone in ZONE_HOURS:
        return ZONE_HOURS[zone] * HOUR_US
    return (int(zone[1:3]) * 60 + int(zone[-2:])) * 60_000_000 * (-1 if zone[0] == "-" else 1)


@lru_cache(maxsize=64)
def _offsets(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Instants at which the zone's offset changes (1900 to 2100) and the offsets between them."""
    if zone[:1] in "+-":
        return np.empty(0, np.int64), np.array([_offset_of(zone)], np.int64)
    z, start = ZoneInfo(zone), datetime(1900, 1, 1, tzinfo=UTC)
    off = lambda s: int((start + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    base = int(start.timestamp())
    at, offs, last = [], [off(0)], 0
    for day in range(1, 201 * 365):
        if off(day * 86400) != offs[-1]:
            lo, hi = last, day * 86400
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == offs[-1] else (lo, mid)
            at.append((base + hi) * 1_000_000)
            offs.append(off(hi))
        last = day * 86400
    return np.array(at, np.int64), np.array(offs, np.int64) * 1_000_000


def local_of(utc: np.ndarray, zone: str) -> np.ndarray:
    """Wall-clock microseconds of ``zone`` at instants."""
    at, offs = _offsets(zone)
    return utc + offs[np.searchsorted(at, utc, "right")]


def instants_of_wall(wall: np.ndarray, has: np.ndarray, zone: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two columns of instants that show a wall time in ``zone``: none valid in a spring gap, both in an autumn fold."""
    at, offs = _offsets(zone)
    first = wall - offs[np.searchsorted(at, wall - DAY_US, "right")]
    second = wall - offs[np.searchsorted(at, wall + DAY_US, "right")]
    return [(first, has & (local_of(first, zone) == wall)), (second, has & (second != first) & (local_of(second, zone) == wall))]
