"""Functions and operators of the core on small literal tables."""

import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wattloom.functions import cards as K
from wattloom.functions import numbers as N
from wattloom.functions import records as R
from wattloom.functions import vectors as V
from wattloom.operators import joins as J
from wattloom.operators import series as S
from wattloom.operators import stats as A
from wattloom.sources import files
from wattloom.streaming import streams


def one(spark, **cols):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first())


def test_numbers(spark):
    lit = F.lit
    assert one(spark, a=N.level3(lit(1.0), 1.0, 1.0), b=N.level3(lit(2.0), 1.0, 2.0), c=N.level3(lit(1.5), 1.0, 2.0), d=N.level3(lit(None).cast("double"), 1.0, 2.0)) == ("LOW", "HIGH", "MEDIUM", None)
    assert one(spark, a=N.is_finite(lit(float("nan"))), b=N.is_finite(lit(float("-inf"))), c=N.is_finite(lit(0.0)), d=N.is_finite(lit(None).cast("double"))) == (False, False, True, False)
    assert one(spark, a=N.trend_label(lit(1e-10)), b=N.trend_label(lit(-1.0)), c=N.half_even(lit(2.5), 0), d=N.clip(lit(9.0), 0.5, 1.5), e=N.safe_double(lit("x"))) == ("FLAT", "DOWN", 2.0, 1.5, None)


def test_vectors(spark):
    a = F.array(*map(F.lit, [100.0, 110.0, 120.0, 115.0]))
    net = V.subtract(a, F.array(*map(F.lit, [10.0, 12.0, 14.0, 15.0])), F.array(*map(F.lit, [1.0, 2.0, 3.0, 5.0])))
    got = one(spark, n=net, p=F.array_max(net), d=V.differences(a), m=V.first_argmax(a), t=V.trend(a), r=V.max_abs(V.differences(a)))
    assert got == ([89.0, 96.0, 103.0, 95.0], 103.0, [10.0, 10.0, -5.0], 3, 5.0, 10.0)
    p = F.array(*map(F.lit, [0.5, 0.25, 0.25, 0.0]))
    top, ent, sup, tv = one(spark, a=V.top_p(p, 0.7), b=V.entropy(p), c=V.effective_support(p), d=V.total_variation(p, F.array(*map(F.lit, [0.0, 0.25, 0.25, 0.5]))))
    assert top == pytest.approx([2 / 3, 1 / 3, 0, 0]) and ent == pytest.approx(1.0397207708) and sup == pytest.approx(np.exp(ent)) and tv == 0.5
    assert one(spark, a=V.differences(F.array(F.lit(1.0))), b=V.at_hour_ending(p, F.lit(5)), c=V.at_hour_ending(p, F.lit(1)), d=V.mean(F.array().cast("array<double>"))) == ([], None, 0.5, None)


def test_draws(spark):
    p = F.array(*map(F.lit, [0.5, 0.25, 0.25, 0.0]))
    assert one(spark, **{f"c{i}": V.draw(p, F.lit(u)) for i, u in enumerate([0.0, 0.49, 0.5, 0.74, 0.75, 0.9999])}) == (0, 0, 1, 1, 2, 2)
    n = spark.range(8000).select(V.draw(p, V.uniform(F.col("id"), F.lit(3))).alias("c")).groupBy("c").count().collect()
    assert {r.c: round(r["count"] / 8000, 1) for r in n} in ({0: 0.5, 1: 0.2, 2: 0.3}, {0: 0.5, 1: 0.3, 2: 0.2}, {0: 0.5, 1: 0.3, 2: 0.3}, {0: 0.5, 1: 0.2, 2: 0.2})


GOOD = {"e": [], "b": [1, 0, 0, 0, 0, 0], "g": [0, 0, 0, 0], "cf": [0, 0], "i": 0, "a": 5, "p": [0, 0, 0], "q": 0.5}


@pytest.mark.parametrize(
    "change,error",
    [({}, None), ({"x": 1}, "keys"), ({"e": [8]}, "e"), ({"e": [1.5]}, "e"), ({"b": [0.5, 0, 0, 0, 0, 0]}, "b"), ({"g": [0, 0, 0]}, "g"), ({"cf": [3, 0]}, "cf"), ({"i": 4}, "i"), ({"a": None}, "a"), ({"p": [0, 0, 6]}, "p"), ({"q": 1.1}, "q")],
)
def test_decision_rules(spark, change, error):
    assert one(spark, e=R.decision_error(F.lit(json.dumps(GOOD | change)))) == (error,)


def test_texts(spark):
    rows = [(0, '{"b": 1, "a": [1.0, 1e7]}'), (1, "x {not} {\"a\": {\"b\": 2}} {\"c\": 1}"), (2, None), (3, '{"a":1,"a":2}'), (4, "same line\nsame line\nsame line"), (5, '["' + "ab" * 40 + '"]'), (6, "0123456789012345678901234" * 3), (7, "")]
    d = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r for r in d.select("i", R.canonical_json("t").alias("c"), R.first_object("t").alias("f"), R.repeated_root_keys("t").alias("k"), R.repeats(F.col("t")).alias("r"), R.brackets(F.col("t"))["balanced"].alias("b")).collect()}
    assert got[0].c == '{"a":[1.0,10000000.0],"b":1}' and got[1].c is None and got[2].c is None
    assert got[1].f == '{"a": {"b": 2}}' and got[4].f is None
    assert (got[3].k, got[0].k, got[5].k) == (1, 0, None)
    assert [got[i].r for i in (4, 5, 6, 7)] == [True, False, True, False]
    assert got[0].b and got[3].b
    assert one(spark, a=R.undecorated(F.lit("```json\n{}\n```")), b=R.undecorated(F.lit("{}<|im_end|>"))) == ("{}", "{}")


def test_cards(spark):
    d = spark.createDataFrame([(1.5, None, None)], "a double, b double, c string")
    parts = {"load": {"now_mw": F.col("a"), "peak_mw": F.col("b")}, "place": {"zone": F.col("c")}}
    assert tuple(d.select(F.to_json(K.card(parts)), K.card_text(parts, "STATE")).first()) == ('{"load":{"now_mw":1.5}}', "STATE\nload:\n  now mw: 1.5")
    schema = d.select(K.card(parts).alias("card"), F.lit(1).alias("future_payoff")).schema
    assert K.forbidden_keys(schema, ["payoff", "zone"]) == ["zone", "future_payoff"]
    assert R.leaf_paths(schema) == ["card.load.now_mw", "card.load.peak_mw", "card.place.zone", "future_payoff"]


def test_strict_join(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert J.strict_join(a, a, ["k"]).count() == 2
    for other in ([(1,), (3,)], [(1,), (1,), (2,)], [(1,), (2,), (None,)]):
        with pytest.raises(ValueError):
            J.strict_join(a, spark.createDataFrame(other, "k int"), ["k"])
    r = J.join_report(spark.createDataFrame([(None,), (1,), (1,)], "k int"), a, ["k"]).first()
    assert (r.left_null_rows, r.left_repeated_keys, r.right_only_keys, r.common_keys) == (1, 1, 1, 1)


def test_tail(spark):
    t = lambda h, m=0: datetime(2022, 1, 1, h, m)
    s = spark.createDataFrame([("g", t(h), float(h)) for h in (1, 2, 3, 4, 6)], "e string, h timestamp, v double")
    q = spark.createDataFrame([(1, "g", t(4, 30)), (2, "g", t(6)), (3, "g", None), (4, None, t(4)), (5, "g", t(4))], "i int, e string, c timestamp")
    got = dict(map(tuple, J.tail_as_of(q, "i", "e", "c", s, "h", "v", 4).collect()))
    assert got == {1: [1.0, 2.0, 3.0, 4.0], 2: None, 3: None, 4: None, 5: [1.0, 2.0, 3.0, 4.0]}
    assert dict(map(tuple, J.tail_as_of(q, "i", "e", "c", s, "h", "v", 3, inclusive=False).collect()))[5] == [1.0, 2.0, 3.0]


def test_series(spark):
    t = lambda h: datetime(2022, 1, 1, h)
    d = spark.createDataFrame([("a", t(1), 1.0), ("a", t(4), 7.0), ("b", t(0), None), ("b", t(1), 2.0)], "k string, h timestamp, v double")
    full = S.with_empty_hours(d, ["k"], "h")
    assert full.count() == 6
    got = {(r.k, r.h.hour): (r.v, r.imputed) for r in S.interpolate_inside(full, ["k"], "h", "v").collect()}
    assert got["a", 2] == (3.0, True) and got["a", 3] == (5.0, True) and got["b", 0] == (None, False)
    assert [(r.k, r.missing_hours) for r in S.gaps_over(d, ["k"], "h").collect()] == [("a", 2)]
    days = spark.createDataFrame([("x", i, 1.0) for i in range(1, 25)] + [("y", i, 1.0) for i in range(1, 24)] + [("x", 5, 2.0)], "k string, he int, v double")
    (day,) = S.dense_day(days, ["k"], "he", "v").collect()
    assert day.k == "x" and day.day[4] == 3.0 and len(day.day) == 24


def test_stats(spark):
    d = spark.createDataFrame([("TRAIN", 100.0), ("TRAIN", 200.0), ("DEV", 1000.0), ("TRAIN", float("nan")), ("TRAIN", None)], "s string, x double")
    (q,) = A.fit_quantiles(d, ["x"], [0.5], F.col("s") == "TRAIN").collect()
    assert q.quantiles == [150.0]
    rows = [("c", 0)] * 359 + [("c", 5)] * 12 + [("d", 1)] * 1200
    (r,) = A.conditional_entropy(spark.createDataFrame(rows, "x string, a int"), ["x"], "a").collect()
    assert (r.n_classes, r.n_conflicts) == (2, 1) and r.entropy == pytest.approx(0.03372332779287735)
    g = A.group_advantage(spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 1.0), (2, 3.0)], "g int, v double"), "g", "v")
    assert sorted(x.advantage for x in g.collect()) == pytest.approx([-1.0, 0.0, 0.0, 1.0], abs=1e-6)
    best = A.best_choice(spark.createDataFrame([(1, 4, 2.0), (1, 3, 2.0), (1, 2, 1.0)], "g int, c int, v double"), ["g"], "c", "v").first()
    assert best.best_choice == 3
    assert [tuple(x) for x in A.checks(d, {"ok": F.col("s").isNotNull(), "num": F.col("x") > 0}).orderBy("check_name").collect()] == [("num", 1, "FAIL"), ("ok", 0, "PASS")]
    w = A.pivot_deltas(spark.createDataFrame([(1, "C0", 5.0), (1, "C1", 3.0)], "k int, c string, v double"), ["k"], "c", ["C0", "C1", "C2"], "v").first()
    assert (w.d_C1, w.d_C2) == (-2.0, None)


@pytest.mark.parametrize(
    "text,flags",
    [
        ("temperature is high\ntemperature is high\ntemperature is high", (False, True, True)), ("a\nb\na\nb\na", (False, False, False)), ("x y z x y z x y z end", (False, False, True)), ("x y z x y z x y end", (False, False, False)),
        ("0123456789012345678901234" * 3, (True, False, False)), ("the unit at Sedby stays on   " * 3 + "x", (True, False, True)), ("the unit at Sedby stays on   " * 3, (False, False, True)), ("0123456789012345678901234" * 2, (False, False, False)), ("ab" * 40, (True, False, False)), ("z" * 71, (False, False, False)), ("z" * 72, (True, False, False)),
        ("".join(map(str, range(150))) * 3, (True, False, False)), ("q" + "".join(map(str, range(900))) * 3 + "q", (True, False, False)), ('["' + "ab" * 40 + '"]', (False, False, False)), ("", (False, False, False)),
    ],
)
def test_repetition(spark, text, flags):
    r = one(spark, r=R.repetition(F.lit(text)))[0]
    assert (r.chunk, r.line, r.ngram) == flags and r.any == any(flags)


def test_repeated_stretch_like_brute_force():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) * rnd.randrange(1, 7) + rnd.choice(["", "c"])
        t = t + "".join(rnd.choice("ab") for _ in range(rnd.randrange(6))) + t[: rnd.randrange(len(t) + 1)]
        want = any(t[i : i + p] == t[i + p : i + 2 * p] == t[i + 2 * p : i + 3 * p] for p in range(4, len(t) // 3 + 1) for i in range(len(t) - 3 * p + 1))
        assert R.repeated_stretch(t, 4) == want, t


@pytest.mark.parametrize(
    "text,want",
    [("{}", (0, 0, 0, False, True)), ("}{", (1, 0, 1, False, False)), ("[{]}", (0, 1, 1, False, False)), ('{"a]": "\\"}"}', (0, 0, 0, False, True)), ('{"a', (1, 0, 0, True, False)), ("[[{", (1, 2, 0, False, False)), ("", (0, 0, 0, False, True)), ("[" * 3000 + "]" * 3000, (0, 0, 0, False, True))],
)
def test_brackets(spark, text, want):
    assert tuple(one(spark, b=R.brackets(F.lit(text)))[0]) == want


def test_json_names(spark):
    d = spark.createDataFrame([('{"a": {"reward_x": [ {"c d": 1} ]}, "b": null}',), ("no json",), (None,), ("[1, 2]",)], "t string")
    got = [(sorted(r[0]), r[1], sorted(r[2])) for r in d.select(R.json_names(F.col("t")), R.forbidden_names(F.col("t"), ["REWARD", "zz"]), R.unexpected_names(F.col("t"), ["a", "b"])).collect()]
    assert got[0] == (["a", "b", "c d", "reward_x"], ["reward_x"], ["c d", "reward_x"]) and got[1:] == [([], [], [])] * 3


def test_quantiles_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(size=400).round(1)] + [("b", 1.0), (None, 2.0), (None, 4.0), ("c", None)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.k: r for r in A.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x"), [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hot = [x for k, x in rows if k == "hot"]
    assert got["hot"].quantiles == pytest.approx(np.quantile(hot, [0.0, 0.1, 0.5, 0.999, 1.0])) and got["hot"].n == 400
    assert got["b"].quantiles == [1.0] * 5 and got[None].quantiles[2] == 3.0 and set(got) == {"hot", "b", None}
    empty = A.fit_quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]).collect()
    assert [r.quantiles for r in empty] == [[]]


def test_previous_row_over_ranges(spark):
    rows = [("hot", i * 7 % 101, i) for i in range(101)] + [("b", 1, 1), (None, 3, 3), (None, None, 9)]
    d = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.before and r.before.v for r in S.with_previous(d, ["k"], ["o"], ["v"]).collect()}
    want = {}
    for k in ("hot", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0))
        want |= {(k, r[1]): (mine[i - 1][2] if i else None) for i, r in enumerate(mine)}
    assert got == want


def test_pairs_of_a_hot_group(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2]), rnd.randrange(5), rnd.choice([None, 1, 2, 3, 9])) for _ in range(300)] + [(None, 1, 2), (None, 2, 3), (3, 1, 1)]
    got = {r.g: (r.n_pairs, r.n_rising) for r in J.pair_gaps(spark.createDataFrame(rows, "g int, m int, v int"), "g", "m", "v").collect()}
    for g in (1, 2, 3):
        mine = sorted((r[1], r[2] or -1) for r in rows if r[0] == g)
        rising = sum(y[1] > x[1] > 0 for i, x in enumerate(mine) for y in mine[i + 1 :])
        assert got[g] == (len(mine) * (len(mine) - 1) // 2, rising)
    assert got[None] == (1, 0)


def test_small_measures(spark):
    p = F.array(*map(F.lit, [0.5, 0.25, 0.25]))
    assert one(spark, a=V.log_loss(p, F.lit(1)), b=V.log_loss(p, F.lit(None).cast("int")), c=V.percent_change(F.array(F.lit(4.0), F.lit(9.0), F.lit(5.0))), d=V.percent_change(F.array(F.lit(0.0), F.lit(5.0)))) == (pytest.approx(np.log(4)), None, 25.0, None)
    e = {r.k: (r.n_labels, round(r.entropy, 6)) for r in A.entropy(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("b", None)], "k string, l string"), ["k"], "l").collect()}
    assert e == {"a": (2, 0.693147), "b": (1, 0.0)}
    w = A.largest_effects(spark.createDataFrame([(1, -5.0), (1, 3.0), (2, None)], "k int, d double"), ["k"], ["d"])
    assert {r.k: r.max_abs_d for r in w.collect()} == {1: 5.0, 2: None}
    m = A.metric_changes(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "m string, v double"), spark.createDataFrame([("a", 1.0), ("b", 2.1), ("c", None), ("d", 1.0)], "m string, v double"), "m", "v")
    assert {r.m: r.same for r in m.collect()} == {"a": True, "b": False, "c": True, "d": False}
    with pytest.raises(ValueError):
        A.rank_by(spark.range(3), [F.col("id")], 4, whole=True)
    d = J.lookup(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], default={"v": "none"})
    assert {r.k: (r.v, r.found) for r in d.collect()} == {1: ("x", True), 2: ("none", False)}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nbad,3\n")
    assert [tuple(r) for r in files.read_csv(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/none*.csv"], "x int, y int").orderBy("y").collect()] == [(1, 2), (None, 3)]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, [f"{tmp_path}/none*.csv"], "x int")
    (tmp_path / "n.json").write_text(json.dumps({"HourlySystemLoads": {"HourlySystemLoad": [{"BeginDate": "2022-01-01T00:00:00Z", "Load": "5.5"}, {"BeginDate": "x", "Load": "y"}]}}))
    assert [(r[0] is None, r[1]) for r in files.read_nested_loads(spark, f"{tmp_path}/n.json").collect()] == [(False, 5.5), (True, None)]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("wind_20220102.csv", 'C,note\nH,"Wind"\n"D","Date","","01/02/2022","01/03/2022"\nD,Hour,HE\n"D","",1,10,11\nD,,24,,x\n')
    got = files.read_zipped_reports(spark, f"{tmp_path}/r.zip").select("report_date", "target_date", "target_he", "value").collect()
    assert {tuple(r) for r in got} == {("2022-01-02", "2022-01-02", 1, 10.0), ("2022-01-02", "2022-01-03", 1, 11.0), ("2022-01-02", "2022-01-03", 24, None)}
    assert [r.n_numbers for r in files.count_numeric_cells(spark, f"{tmp_path}/r.zip").collect()] == [2]
    for name, text in (("nodate", "D,,1,5\n"), ("hour", "D,Date,,01/02/2022\nD,,25,5\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("wind_20220102.csv", text)
        with pytest.raises(Exception):
            files.read_zipped_reports(spark, f"{tmp_path}/{name}.zip").collect()
    (tmp_path / "l.jsonl").write_text('{"x": 1, "y": "a"}\n\n{"x": 2}\n')
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/l.jsonl", "x int, y string").where("x IS NOT NULL").collect())) == [(1, "a"), (2, None)]
    files.write_new(spark.range(3), f"{tmp_path}/out")
    with pytest.raises(Exception):
        files.write_new(spark.range(3), f"{tmp_path}/out")
    assert files.file_hashes(spark, f"{tmp_path}/a.csv").first().length == 14


def test_streams(spark, tmp_path):
    rows = [Row(i=1, ts=datetime(2022, 1, 1, 0, 10), k="a", v=1.0), Row(i=2, ts=datetime(2022, 1, 1, 0, 50), k="a", v=3.0), Row(i=3, ts=datetime(2022, 1, 1, 9), k="b", v=5.0)]
    src = spark.createDataFrame(rows)
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([Row(i=4, ts=datetime(2022, 1, 1, 0, 20), k="a", v=100.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    s = streams.hourly_stream(streams.read_stream(spark, f"{tmp_path}/in", src.schema), "ts", ["k"], "v")
    streams.run_to_table(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = [(r.window_start.hour, r.k, r.mean_value, r.n_values) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [(0, "a", 2.0, 2)]  # the window at nine is still open


def test_newest_and_distinct_streams(spark, tmp_path):
    t = lambda h: datetime(2022, 1, 1, h)
    schema = "id int, k string, published timestamp, cutoff timestamp, mw double"
    one, two = [(1, "a", t(1), t(9), 1.0), (2, "a", t(3), t(9), 3.0), (3, "b", t(2), t(1), 9.0), (2, "a", t(3), t(9), 3.0)], [(4, "a", t(2), t(9), 2.0), (5, "b", t(1), t(1), 5.0), (6, "a", t(10), t(9), 10.0)]
    run = lambda: streams.run_newest(streams.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/out", f"{tmp_path}/cp", "published", "cutoff", ["k"], "id").awaitTermination(120)
    spark.createDataFrame(one, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    assert [(r.k, r.id) for r in streams.read_newest(spark, f"{tmp_path}/out").collect()] == [("a", 2)]
    spark.createDataFrame(two, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted((r.k, r.id) for r in streams.read_newest(spark, f"{tmp_path}/out").collect()) == [("a", 2), ("b", 5)]
    d = streams.distinct_stream(streams.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "published", ["id"])
    streams.run_to_table(d, f"{tmp_path}/once", f"{tmp_path}/cp2").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [1, 2, 3, 4, 5, 6]


def test_written_tables(spark):
    from wattloom.session import clear_written, cut_table

    d = cut_table(spark.range(5))
    assert d.count() == 5 and clear_written(spark) >= 1
    with pytest.raises(Exception):
        d.count()
