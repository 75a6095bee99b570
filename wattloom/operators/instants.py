"""Mixed time texts of a record stream as one unambiguous UTC instant.

Every text gets an array of all valid interpretations (order of a slash date, zone of a bare wall time, both sides
of an autumn fold). What the row itself says (a feed's clock, a local date and hour) strikes out the impossible
ones. A Viterbi pass over each source's record order then picks one of what is left, penalising a switch of
convention, a jump back in time and, slightly, a long jump ahead. Rows with a single interpretation fix the path,
so only the runs between them are searched.

Tasks hold ranges of (source, record id), so a source with any share of all rows is spread over many of them, however
its ids lie. Runs inside a task are searched there; of runs at its first and last source's ends the open rows and the
nearest settled ones are handed to a second pass, which sees nothing else, so the path is the same however rows are cut.

Result: one row per row id (repeated ids give one each) with ``utc_micros``, ``n_instants`` (how many instants are
possible), ``alternatives`` (all of them, where there are several) and ``status``: ``exact`` (one instant),
``likely`` (several; the path's choice is given) or ``undecidable`` (none). Null texts, unreadable texts and dates
that don't exist have no interpretation of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import time_texts as T
from wattloom.session import cut_table

GOAL, START, HABIT, OPEN, DONE = range(5)  # rows of the first pass, in the order they have at one record
SWITCH_COST, BACK_COST = 1.0, 2.0
NEW_YORK = "America/New_York"

_OUT = "row_id bigint, utc_micros bigint, n_instants int, alternatives array<bigint>, status string"


class Readings:
    """Interpretations of a batch as columns of (instant, valid, convention); ``unsure`` rows lack the evidence that would settle them."""

    def __init__(self, n: int) -> None:
        self.u: list[np.ndarray] = []
        self.ok: list[np.ndarray] = []
        self.code: list[np.ndarray] = []
        self.unsure = np.zeros(n, bool)

    def add(self, u: np.ndarray, ok: np.ndarray, code: np.ndarray) -> None:
        self.u.append(u)
        self.ok.append(ok)
        self.code.append(code)


def interpretations(p: T.Parsed, zones: list[tuple[str, np.ndarray]]) -> Readings:
    """All valid readings; zones: names that a bare text may be in, each with the rows it holds for.

    The convention is 8 or 16 for a slash date with the month or the day first, plus the number of the assumed zone.
    """
    n = len(p.epoch)
    r = Readings(n)
    r.add(p.epoch, p.has_epoch, np.zeros(n, int))
    for k, (wall, has) in enumerate(p.walls):
        order = np.where(p.slash, 8 * (k + 1), 0)
        r.add(wall - p.offset, has & p.has_offset, order)
        for z, (zone, rows) in enumerate(zones):
            for u, ok in T.instants_of_wall(wall, has & ~p.has_offset & rows, zone):
                r.add(u, ok, order + z + 1)
    return r


def choose(df: DataFrame, read: Callable[[pa.Table], Readings], keep: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The path's choice per row of ``df`` (source, row_id, what ``read`` needs, and ``keep``, which is carried along); see the module."""
    keep = keep or []
    kept = "".join(f", `{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    order = ["source", "row_id"]
    d = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    first = cut_table(d.sortWithinPartitions(*order).mapInArrow(partial(_first_pass, read, keep), f"kind tinyint, source string, {_OUT}, codes array<int>{kept}"))
    done = first.where(F.col("kind") == DONE)
    rest = first.where(F.col("kind") != DONE).repartition("source").sortWithinPartitions("source", "row_id", "kind")
    rest = rest.mapInArrow(partial(_second_pass, keep), f"{_OUT}{kept}")
    names = [f.split()[0] for f in _OUT.split(", ")] + keep
    return done.select(*names).unionByName(rest.select(*names))


def _changes(x: pa.ChunkedArray) -> np.ndarray:
    codes = x.combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    i = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], i[1:] != i[:-1]])


class _Chain:
    """A source's rows inside one task: the run of open rows since the last settled one, and what is known before it."""

    def __init__(self, source: str | None, first: bool) -> None:
        self.source, self.first = source, first  # the first chain of a task may go on from an earlier task
        self.start: tuple[int, int] | None = None  # row and instant of the last settled row
        self.habit: tuple[int, int] | None = None  # row and convention of the last row that told one
        self.run: list[tuple] = []  # (row_id, instants, conventions, n, kept values)
        self.settled = False

    def close(self, goal: tuple[int, int] | None, last: bool, out: list[tuple]) -> None:
        """End the run at a settled row, or at the chain's end (``goal`` null); what an earlier or later task has a say in is handed on."""
        before = self.first and (self.start is None or self.habit is None)
        if self.run and not before and not (goal is None and last):
            choices = [(us, cs) for _, us, cs, _, _ in self.run]
            picked = path(choices, self.start and self.start[1], self.habit[1] if self.habit else 0, goal and goal[1])
            out += [(DONE, self.source, row, u, n, sorted(us), "likely", None, *kept) for u, (row, us, _, n, kept) in zip(picked, self.run)]
        elif self.run:
            if self.start:
                out.append(self._edge(START, *self.start))
            out += [(OPEN, self.source, row, None, n, us, "likely", cs, *kept) for row, us, cs, n, kept in self.run]
            if goal:
                out.append(self._edge(GOAL, *goal))
        elif goal and self.first and not self.settled:
            out.append(self._edge(GOAL, *goal))
        if goal is None and last:
            out += [self._edge(START, *self.start)] if self.start else []
            out += [self._edge(HABIT, *self.habit)] if self.habit else []
        self.run, self.settled = [], self.settled or goal is not None

    def _edge(self, kind: int, row: int, value: int) -> tuple:
        return (kind, self.source, row, value, None, None, None, None)


def _first_pass(read: Callable[[pa.Table], Readings], keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with one instant or none at once; runs of others once the next settled row is seen; the ends of the task's first and last source for the second pass."""
    chain: _Chain | None = None
    kinds: dict[str, pa.DataType] = {}
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        kinds = {k: t.schema.field(k).type for k in keep}
        r = read(t)
        u, ok = np.stack(r.u, 1), np.stack(r.ok, 1)
        code = np.stack([np.broadcast_to(c, len(r.unsure)) for c in r.code], 1)
        distinct = ok.copy()
        for j in range(1, ok.shape[1]):
            for i in range(j):
                distinct[:, j] &= ~(ok[:, i] & (u[:, i] == u[:, j]))
        size = distinct.sum(1)
        n = np.where(r.unsure & (size > 0), np.maximum(size, 2), size)
        at, rows = distinct.argmax(1), np.arange(len(u))
        pick, conv = u[rows, at], code[rows, at]
        ids = t["row_id"].to_numpy()
        out: list[tuple] = []
        bounds = [*np.flatnonzero(_changes(t["source"])).tolist(), len(u)]
        for a, b in zip(bounds, bounds[1:]):
            source = t["source"][a].as_py()
            if chain is None or chain.source != source:
                if chain is not None:
                    chain.close(None, False, out)
                chain = _Chain(source, chain is None)
            known = a + np.flatnonzero(size[a:b] == 1)
            told = known[conv[known] != 0]
            loose = a + np.flatnonzero(size[a:b] > 1)
            done = 0  # settled rows of the segment that the chain has seen
            for x in [*loose.tolist(), b]:
                upto = int(np.searchsorted(known, x))
                if upto > done:
                    chain.close((int(ids[known[done]]), int(pick[known[done]])), False, out)
                    chain.start, done = (int(ids[known[upto - 1]]), int(pick[known[upto - 1]])), upto
                    k = int(np.searchsorted(told, x)) - 1
                    if k >= 0:
                        chain.habit = (int(ids[told[k]]), int(conv[told[k]]))
                if x < b:
                    d = distinct[x]
                    chain.run.append((int(ids[x]), u[x][d].tolist(), code[x][d].tolist(), int(n[x]), tuple(t[k][x].as_py() for k in keep)))
        whole = np.flatnonzero(size <= 1)
        take = t.take(pa.array(whole))
        fixed = {
            "kind": pa.array(np.full(len(whole), DONE, np.int8)), "source": take["source"], "row_id": take["row_id"], "utc_micros": pa.array(pick[whole], pa.int64(), mask=size[whole] == 0),
            "n_instants": pa.array(n[whole].astype(np.int32)), "alternatives": pa.nulls(len(whole), pa.list_(pa.int64())),
            "status": pa.array(np.array(["undecidable", "exact", "likely"])[np.minimum(n[whole], 2)], pa.string()), "codes": pa.nulls(len(whole), pa.list_(pa.int32())), **{k: take[k] for k in keep},
        }
        yield from pa.table(fixed).combine_chunks().to_batches()
        yield from _rows(out, kinds)
    if chain is not None:
        out = []
        chain.close(None, True, out)
        yield from _rows(out, kinds)


def _rows(out: list[tuple], kinds: dict[str, pa.DataType]) -> list[pa.RecordBatch]:
    if not out:
        return []
    types = [("kind", pa.int8()), ("source", pa.string()), ("row_id", pa.int64()), ("utc_micros", pa.int64()), ("n_instants", pa.int32()), ("alternatives", pa.list_(pa.int64())), ("status", pa.string()), ("codes", pa.list_(pa.int32())), *kinds.items()]
    filled = [(*r, *[None] * (len(types) - len(r))) for r in out]
    return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(types, zip(*filled))}).to_batches()


def _second_pass(keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that reach over tasks, between the ends that the first pass has left; rows come sorted by source and row."""
    source, start, habit = object(), None, 0
    run: list[dict] = []
    kinds: dict[str, pa.DataType] = {}

    def solve(goal: int | None) -> list[pa.RecordBatch]:
        if not run:
            return []
        picked = path([(r["alternatives"], r["codes"]) for r in run], start, habit, goal)
        out = [(DONE, r["source"], r["row_id"], u, r["n_instants"], sorted(r["alternatives"]), "likely", None, *[r[k] for k in keep]) for r, u in zip(run, picked)]
        run.clear()
        return [b.select([*[f.split()[0] for f in _OUT.split(", ")], *keep]) for b in _rows(out, kinds)]

    for batch in batches:
        kinds = {k: batch.schema.field(k).type for k in keep}
        for r in batch.to_pylist():
            if r["source"] != source:
                yield from solve(None)
                source, start, habit = r["source"], None, 0
            if r["kind"] == OPEN:
                run.append(r)
            elif r["kind"] == GOAL:
                yield from solve(r["utc_micros"])
            elif r["kind"] == START:
                start = r["utc_micros"]
            else:
                habit = r["utc_micros"]
    yield from solve(None)


def _step(a: int, b: int) -> float:
    hours = (b - a) / T.HOUR_US
    return BACK_COST + 0.1 * np.log1p(-hours) if hours < 0 else 0.01 * np.log1p(hours)


def path(choices: list[tuple[list[int], list[int]]], first: int | None, habit: int, last: int | None) -> list[int]:
    """The cheapest instants of a run of rows between two known instants; ties go to the earlier listed reading."""
    switch = lambda a, b: SWITCH_COST if a and b and a != b else 0.0
    cost = [(0.0 if first is None else _step(first, x)) + switch(habit, y) for x, y in zip(*choices[0])]
    links: list[list[int]] = []
    for (us, cs), (vs, ds) in zip(choices, choices[1:]):
        steps = [[w + _step(a, x) + switch(b, y) for w, a, b in zip(cost, us, cs)] for x, y in zip(vs, ds)]
        links.append([min(range(len(s)), key=s.__getitem__) for s in steps])
        cost = [s[k] for s, k in zip(steps, links[-1])]
    if last is not None:
        cost = [w + _step(x, last) for w, x in zip(cost, choices[-1][0])]
    at = min(range(len(cost)), key=cost.__getitem__)
    out = [choices[-1][0][at]]
    for (us, _), link in zip(choices[-2::-1], links[::-1]):
        at = link[at]
        out.append(us[at])
    return out[::-1]


def lmp_instants(lmp: DataFrame, parts: int | None = None) -> DataFrame:
    """Instants of ``lmp_hourly_hub.interval_start_utc`` by the row's New York date and hour ending.

    A bare wall time is in UTC or New York time, whichever gives the target fields; so is the order of a slash date.
    Where the text is null, unreadable or no real date, the start of the target hour counts. Without target fields a
    bare text stays undecided, and contradicting ones leave it without an instant.
    """
    day = F.unix_date(F.col("target_local_date").try_cast("date"))
    d = lmp.select(F.col("lmp_row_id").alias("row_id"), F.col("location").alias("source"), F.col("interval_start_utc").alias("text"), day.alias("day"), F.col("target_he").alias("he"))
    return choose(d, _read_lmp, parts=parts)


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t[name].combine_chunks()
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _read_lmp(t: pa.Table) -> Readings:
    p = T.parse(_column(t, "text"))
    r = interpretations(p, [("UTC", np.ones(len(t), bool)), (NEW_YORK, np.ones(len(t), bool))])
    day, he = (_column(t, c).fill_null(-(10**6)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("day", "he"))
    told = (day > -(10**6)) & (he > -(10**6))
    bare = ~p.has_epoch & ~p.has_offset
    readable = p.has_epoch | p.walls[0][1] | p.walls[1][1]
    open_order = p.walls[0][1] & p.walls[1][1] & (p.walls[0][0] != p.walls[1][0])
    for k, u in enumerate(r.u):
        if not r.ok[k].any():
            continue
        local = T.local_of(u, NEW_YORK)
        fits = (local // T.DAY_US == day) & (local % T.DAY_US // T.HOUR_US + 1 == he)
        r.ok[k] = r.ok[k] & (fits | ~(told & (bare | open_order)))
    start = day * T.DAY_US + (he - 1) * T.HOUR_US
    for u, ok in T.instants_of_wall(start, ~readable & told & (he >= 1) & (he <= 24), NEW_YORK):
        r.add(u, ok, np.full(len(t), 2))
    r.unsure = readable & bare & ~told
    return r


def load_instants(load: DataFrame, clock: DataFrame, keep: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Instants of ``hourlysysload.timestamp_utc`` by each feed's clock: zone of bare texts, order of slash dates.

    A feed the clock table doesn't name can't date bare texts; its slash dates stay open in order. ``keep``: further
    columns of ``load`` to carry along.
    """
    c = clock.groupBy(F.col("feed_id").alias("_feed")).agg(F.min("bare_zone").alias("zone"), F.min("date_order").alias("rule"))
    d = load.select(F.col("reading_id").alias("row_id"), F.col("load_source").alias("source"), F.col("timestamp_utc").alias("text"), "feed_id", *(keep or []))
    return choose(d.join(c, F.col("feed_id") == F.col("_feed"), "left").drop("feed_id", "_feed"), _read_load, keep, parts)


def _read_load(t: pa.Table) -> Readings:
    p = T.parse(_column(t, "text"))
    zone, rule = _column(t, "zone"), _column(t, "rule").fill_null("").to_numpy(zero_copy_only=False)
    p.walls[0][1][p.slash & ((rule == "DMY") | (rule == "YMD"))] = False
    p.walls[1][1][(rule == "MDY") | (rule == "YMD")] = False
    names = zone.fill_null("").to_numpy(zero_copy_only=False)
    return interpretations(p, [(z, names == z) for z in zone.unique().drop_null().to_pylist()])
