"""Queries of the core data operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import cards as K
from wattloom.functions import numbers as N
from wattloom.functions import records as R
from wattloom.functions import vectors as V
from wattloom.functions.times import decision_cutoff, hour_ending, local_date_text
from wattloom.operators import joins as J
from wattloom.operators import series as S
from wattloom.operators import stats as A
from wattloom.session import ensure_checkpoint_dir
from wattloom.sources import files
from wattloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(ts, name: str):
    return F.date_format(ts, HOUR).alias(name)


# Scans, projections and predicates


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_utc, event_type, round(avg(value), 6) AS mean_value, count(value) AS n_values FROM events GROUP BY 1, 2")
def hourly_resample(spark, sf):
    """Mean and count per hour and kind."""
    d = S.resample(table(spark, sf, "events"), ["event_type"], "ts", "value")
    return d.select(_text("ts", "hour_utc"), "event_type", F.round("mean_value", 6).alias("mean_value"), "n_values")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per area, date, hour and region the newest forecast known by the decision."""
    return newest_vintages(spark, sf)


@query("SELECT state_row_id, region, target_he, current_load_mw FROM public_energy_state WHERE split = 'TRAIN' AND target_hour_utc >= TIMESTAMP '2022-11-03 00:00:00' AND target_hour_utc < TIMESTAMP '2022-11-09 00:00:00' AND region IN ('MAINE', 'VERMONT', 'SEMASS')")
def scan_pruned(spark, sf):
    """Pushed-down split, half-open range and IN list; four columns are read."""
    d = table(spark, sf, "public_energy_state")
    t = F.col("target_hour_utc")
    inside = (t >= F.lit("2022-11-03 00:00:00").cast("timestamp")) & (t < F.lit("2022-11-09 00:00:00").cast("timestamp"))
    return d.where((F.col("split") == "TRAIN") & inside & F.col("region").isin("MAINE", "VERMONT", "SEMASS")).select("state_row_id", "region", "target_he", "current_load_mw")


@query("SELECT event_type, count(k) AS n_numbers, sum(k) AS total, count(*) - count(k) AS n_bad FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) k FROM events) GROUP BY 1")
def json_numbers(spark, sf):
    """A field of a JSON text, coerced; what is no number is null."""
    d = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return d.groupBy("event_type").agg(F.count("k").alias("n_numbers"), F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("n_bad"))


@query("SELECT control_area, count(*) AS n_rows, count_if(strftime(l, '%Y-%m-%d') = target_local_date) AS same_date, count_if(hour(l) + 1 = target_he) AS same_hour FROM (SELECT *, timezone('America/New_York', timezone('UTC', target_hour_utc)) l FROM public_energy_state) GROUP BY 1")
def local_hour_audit(spark, sf):
    """Recorded local date and hour ending against those of the instant."""
    d, t = table(spark, sf, "public_energy_state"), F.col("target_hour_utc")
    return d.groupBy("control_area").agg(F.count("*").alias("n_rows"), F.count_if(local_date_text(t) == F.col("target_local_date")).alias("same_date"), F.count_if(hour_ending(t) == F.col("target_he")).alias("same_hour"))


@query("SELECT control_area, count(*) AS n_rows, count_if(dispatch_mw IS NOT NULL AND isfinite(dispatch_mw) AND utilization IS NOT NULL AND isfinite(utilization) AND headroom_mw IS NOT NULL AND isfinite(headroom_mw) AND own_lmp IS NOT NULL AND isfinite(own_lmp)) AS n_finite FROM own_generator GROUP BY 1")
def finite_rows(spark, sf):
    """Rows whose numbers are all present and finite."""
    return table(spark, sf, "own_generator").groupBy("control_area").agg(F.count("*").alias("n_rows"), F.count_if(N.all_finite("dispatch_mw", "utilization", "headroom_mw", "own_lmp")).alias("n_finite"))


@query("SELECT region, count_if(abs(current_load_mw / peak_load_mw - load_factor) <= 1e-3 + 1e-5 * abs(load_factor)) AS n_close, count(*) AS n_rows FROM public_energy_state WHERE peak_load_mw > 0 GROUP BY 1")
def ratio_checks(spark, sf):
    """Recorded ratios against recomputed ones, within a tolerance."""
    d = table(spark, sf, "public_energy_state").where("peak_load_mw > 0")
    return d.groupBy("region").agg(F.count_if(N.is_close(F.col("current_load_mw") / F.col("peak_load_mw"), F.col("load_factor"), 1e-5, 1e-3)).alias("n_close"), F.count("*").alias("n_rows"))


@query("""SELECT region, label, count(*) AS n_rows FROM (
 SELECT region, CASE WHEN current_load_mw <= q[1] THEN 'LOW' WHEN current_load_mw >= q[2] THEN 'HIGH' WHEN current_load_mw IS NOT NULL THEN 'MEDIUM' END AS label
 FROM public_energy_state, (SELECT quantile_cont(current_load_mw, [0.3333333333333333, 0.6666666666666666]) q FROM public_energy_state WHERE split = 'TRAIN' AND isfinite(current_load_mw))) GROUP BY 1, 2""")
def fitted_levels(spark, sf):
    """Thirds fitted on TRAIN, applied as labels everywhere."""
    d = table(spark, sf, "public_energy_state")
    fit = A.fit_quantiles(d, ["current_load_mw"], [1 / 3, 2 / 3], F.col("split") == "TRAIN").select("quantiles")  # one row
    label = N.level3(F.col("current_load_mw"), F.try_element_at("quantiles", F.lit(1)), F.try_element_at("quantiles", F.lit(2)))
    return d.join(F.broadcast(fit)).select("region", label.alias("label")).groupBy("region", "label").agg(F.count("*").alias("n_rows"))


@query("""SELECT control_area, count(*) AS n_rows, count_if(r < 0.5) AS clipped_low, count_if(r > 1.5) AS clipped_high, round(avg(least(greatest(r, 0.5), 1.5)), 9) AS mean_alpha, round(min(r), 9) AS min_raw, round(max(r), 9) AS max_raw
 FROM (SELECT control_area, current_load_mw / (SELECT median(current_load_mw) FROM public_energy_state WHERE split = 'TRAIN' AND isfinite(current_load_mw)) r FROM public_energy_state WHERE isfinite(current_load_mw)) GROUP BY 1""")
def clipped_scale(spark, sf):
    """Load over the TRAIN median, clipped, with how often the clip binds."""
    d = _scaled(spark, sf)
    r = F.col("raw")
    return d.groupBy("control_area").agg(
        F.count("*").alias("n_rows"), F.count_if(r < 0.5).alias("clipped_low"), F.count_if(r > 1.5).alias("clipped_high"),
        F.round(F.avg("alpha"), 9).alias("mean_alpha"), F.round(F.min(r), 9).alias("min_raw"), F.round(F.max(r), 9).alias("max_raw"),
    )


def _scaled(spark, sf):
    d = table(spark, sf, "public_energy_state").where(N.is_finite(F.col("current_load_mw")))
    fit = A.fit_quantiles(d, ["current_load_mw"], [0.5], F.col("split") == "TRAIN").select(F.try_element_at("quantiles", F.lit(1)).alias("_m"))  # one row
    raw = F.col("current_load_mw") / F.col("_m")
    return d.join(F.broadcast(fit)).withColumn("raw", raw).withColumn("alpha", N.clip(F.col("raw"), 0.5, 1.5)).drop("_m")


@query("SELECT CASE WHEN utilization < 0.4 THEN 'LOW' WHEN utilization <= 0.8 THEN 'MEDIUM' WHEN utilization IS NOT NULL THEN 'HIGH' END AS level, CASE WHEN utilization < 0.8 THEN 'LOW' WHEN utilization < 0.95 THEN 'ELEVATED' WHEN utilization IS NOT NULL THEN 'HIGH' END AS stress, count(*) AS n_rows FROM own_generator GROUP BY 1, 2")
def step_labels(spark, sf):
    """Fixed steps of one number as labels."""
    u = F.col("utilization")
    level = F.when(u < 0.4, "LOW").when(u <= 0.8, "MEDIUM").when(u.isNotNull(), "HIGH")
    return table(spark, sf, "own_generator").select(level.alias("level"), N.step_label(u, [(0.8, "LOW"), (0.95, "ELEVATED")], "HIGH").alias("stress")).groupBy("level", "stress").agg(F.count("*").alias("n_rows"))


@query("""SELECT generator_id, t AS trend, count(*) AS n_rows FROM (SELECT generator_id, CASE WHEN x > 1e-9 THEN 'UP' WHEN x < -1e-9 THEN 'DOWN' WHEN x IS NOT NULL THEN 'FLAT' END t
 FROM (SELECT generator_id, dispatch_mw - lag(dispatch_mw) OVER (PARTITION BY generator_id ORDER BY observation_timestamp, record_id) x FROM own_generator)) GROUP BY 1, 2""")
def trends(spark, sf):
    """Change to the record before, as a label with a dead band."""
    d = table(spark, sf, "own_generator").select("generator_id", "observation_timestamp", "record_id", "dispatch_mw")
    x = F.col("dispatch_mw") - F.col("before.dispatch_mw")
    return S.with_previous(d, ["generator_id"], ["observation_timestamp", "record_id"], ["dispatch_mw"]).select("generator_id", N.trend_label(x).alias("trend")).groupBy("generator_id", "trend").agg(F.count("*").alias("n_rows"))


TERMS = ["deterministic interpretation", "payoff", "network stress", "reward", "future"]


@query(f"SELECT CASE {' '.join(f'''WHEN contains(lower(prompt), '{t}') THEN '{t}' ''' for t in TERMS)} END AS term, count(*) AS n_rows FROM public_state_v1_sft GROUP BY 1")
def forbidden_terms(spark, sf):
    """The first listed term each prompt contains."""
    d = table(spark, sf, "public_state_v1_sft").select(R.forbidden_term(F.col("prompt"), TERMS).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n_rows"))


@query("SELECT provenance, count_if(sha256(prompt) = prompt_hash) AS n_plain, count_if(sha256(prompt || chr(10)) = prompt_hash) AS n_with_newline, count(prompt_hash) AS n_hashed FROM public_state_v1_sft GROUP BY 1")
def hash_identity(spark, sf):
    """Recorded prompt hashes against recomputed ones."""
    p, h = F.col("prompt"), F.col("prompt_hash")
    return table(spark, sf, "public_state_v1_sft").groupBy("provenance").agg(F.count_if(R.sha256(p) == h).alias("n_plain"), F.count_if(R.sha256(F.concat(p, F.lit("\n"))) == h).alias("n_with_newline"), F.count(h).alias("n_hashed"))


@query("SELECT array_to_string(json_keys(target_json), ',') AS key_order, count(*) AS n_rows FROM public_state_v1_sft GROUP BY 1")
def key_orders(spark, sf):
    """Histogram of the order of the record's keys."""
    return table(spark, sf, "public_state_v1_sft").select(F.array_join(F.json_object_keys("target_json"), ",").alias("key_order")).groupBy("key_order").agg(F.count("*").alias("n_rows"))


@query("SELECT json_array_length(target_json, '$.e') AS n_e, json_array_length(target_json, '$.b') AS n_b, json_array_length(target_json, '$.p') AS n_p, count(*) AS n_rows FROM public_state_v1_sft GROUP BY 1, 2, 3")
def field_lengths(spark, sf):
    """Histogram of the lengths of the record's lists."""
    n = lambda k: F.json_array_length(F.get_json_object("target_json", f"$.{k}")).cast("long").alias(f"n_{k}")
    return table(spark, sf, "public_state_v1_sft").select(n("e"), n("b"), n("p")).groupBy("n_e", "n_b", "n_p").agg(F.count("*").alias("n_rows"))


@query()
def decision_errors(spark, sf):
    """First broken rule of the decision record inside each answer, and of each training target."""
    c = table(spark, sf, "t45_k4_free_candidates").select(F.lit("answers").alias("origin"), R.decision_error(R.first_object(F.col("raw_output"))).alias("error"))
    t = table(spark, sf, "public_state_v1_sft").select(F.lit("targets").alias("origin"), R.decision_error(F.col("target_json")).alias("error"))
    return c.unionByName(t).groupBy("origin", "error").agg(F.count("*").alias("n_rows"))


@query()
def answer_forms(spark, sf):
    """Structure of each answer's text: JSON or not, balanced, repeated, decorated."""
    x = F.col("raw_output")
    d = table(spark, sf, "t45_k4_free_candidates").select(R.is_json(x).alias("whole_json"), R.brackets(x)["balanced"].alias("balanced"), R.repetition(x).alias("_r"), (R.undecorated(x) != x).alias("decorated"), R.repeated_root_keys(R.first_object(x)).alias("repeated_keys"))
    d = d.select("whole_json", "balanced", F.col("_r.chunk").alias("repeated_chunk"), F.col("_r.line").alias("repeated_line"), F.col("_r.ngram").alias("repeated_words"), "decorated", "repeated_keys")
    return d.groupBy(*d.columns).agg(F.count("*").alias("n_rows"))


@query()
def canonical_targets(spark, sf):
    """Rows and distinct spellings per canonical target, by the hash of its canonical JSON."""
    d = table(spark, sf, "public_state_v1_sft").select(R.sha256(R.canonical_json(F.col("target_json"))).alias("target_hash"), "target_json")
    return d.groupBy("target_hash").agg(F.count("*").alias("n_rows"), F.countDistinct("target_json").alias("n_spellings"))


_LINES = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10))"


@query("SELECT state_row_id, " + _LINES("'STATE'", f"'load:' || chr(10) || nullif({_LINES("'  current load mw: ' || current_load_mw::VARCHAR", "'  peak load mw: ' || peak_load_mw::VARCHAR")}, '')", f"'place:' || chr(10) || nullif({_LINES("'  region: ' || region", "'  hour: ' || target_he::VARCHAR")}, '')") + " AS card FROM public_energy_state")
def card_texts(spark, sf):
    """Nested state cards as text; what is absent is left out."""
    c = F.col
    d = table(spark, sf, "public_energy_state")
    text = K.card_text({"load": {"current_load_mw": c("current_load_mw"), "peak_load_mw": c("peak_load_mw")}, "place": {"region": c("region"), "hour": c("target_he")}}, "STATE")
    return d.select("state_row_id", text.alias("card"))


_OBJECT = lambda *parts: f"'{{' || nullif(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ','), '') || '}}'"
_CARD = _OBJECT(
    f"""'"load":' || {_OBJECT("'\"current_load_mw\":' || current_load_mw::VARCHAR", "'\"load_factor\":' || load_factor::VARCHAR", "'\"peak_load_mw\":' || peak_load_mw::VARCHAR")}""",
    f"""'"own":' || {_OBJECT("'\"generator_id\":\"' || generator_id || '\"'")}""",
    f"""'"target":' || {_OBJECT("'\"local_date\":\"' || target_local_date || '\"'", "'\"he\":' || target_he::VARCHAR", "'\"region\":\"' || region || '\"'")}""",
)


@query(f"SELECT state_row_id, card_json, sha256(card_json) AS card_hash FROM (SELECT state_row_id, {_CARD} AS card_json FROM public_energy_state)")
def state_cards(spark, sf):
    """State cards as JSON without absent fields, with the hash of their text."""
    c = F.col
    card = K.card({"load": {"current_load_mw": c("current_load_mw"), "load_factor": c("load_factor"), "peak_load_mw": c("peak_load_mw")}, "own": {"generator_id": c("generator_id")}, "target": {"local_date": c("target_local_date"), "he": c("target_he"), "region": c("region")}})
    d = table(spark, sf, "public_energy_state").select("state_row_id", F.to_json(card).alias("card_json"))
    return d.withColumn("card_hash", R.sha256(F.col("card_json")))


@query("SELECT state_row_id, round_even(current_load_mw, 1) AS load_key, round_even(load_factor, 2) AS factor_key FROM public_energy_state")
def rounded_keys(spark, sf):
    """Keys rounded to even."""
    return table(spark, sf, "public_energy_state").select("state_row_id", N.half_even(F.col("current_load_mw"), 1).alias("load_key"), N.half_even(F.col("load_factor"), 2).alias("factor_key"))


# Joins


@query("""WITH l AS (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey k, count(*) n FROM orders GROUP BY 1), b AS (SELECT coalesce(l.k, r.k) k, l.n a, r.n b FROM l FULL JOIN r ON l.k = r.k)
 SELECT coalesce(sum(CASE WHEN k IS NULL THEN a END), 0)::BIGINT AS left_null_rows, coalesce(sum(CASE WHEN k IS NULL THEN b END), 0)::BIGINT AS right_null_rows, count_if(k IS NOT NULL AND a > 1) AS left_repeated_keys, count_if(k IS NOT NULL AND b > 1) AS right_repeated_keys,
 count_if(k IS NOT NULL AND b IS NULL) AS left_only_keys, count_if(k IS NOT NULL AND a IS NULL) AS right_only_keys, count_if(k IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) AS common_keys FROM b""")
def join_preflight(spark, sf):
    """Whether lines and orders would join one to one, and what stands against it."""
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return J.join_report(left, table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_chain(spark, sf):
    """Four tables along their keys; Catalyst broadcasts what is small and pre-aggregates nothing twice."""
    t = lambda n: table(spark, sf, n)
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"))
    d = per.join(t("customer"), "c_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("p"), 2).alias("total"))


@query("SELECT s_name IS NOT NULL AS found, count(*) AS n_rows FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def lookup_complete(spark, sf):
    """Lines that find their supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return J.lookup(table(spark, sf, "lineitem").select("l_suppkey"), s, ["l_suppkey"]).groupBy("found").agg(F.count("*").alias("n_rows"))


@query("""WITH f AS (SELECT control_area a, forecast_date d, forecast_hour h, count(*) n FROM load_forecast GROUP BY 1, 2, 3), s AS (SELECT control_area a, target_local_date d, target_he h, count(*) n FROM public_energy_state GROUP BY 1, 2, 3)
 SELECT coalesce(f.a, s.a) AS control_area, count_if(f.n IS NOT NULL AND s.n IS NOT NULL) AS n_both, count_if(s.n IS NULL) AS n_forecast_only, count_if(f.n IS NULL) AS n_state_only FROM f FULL JOIN s ON f.a = s.a AND f.d = s.d AND f.h = s.h GROUP BY 1""")
def hours_on_both_sides(spark, sf):
    """Full outer join of forecast hours and decision hours."""
    k = ["control_area", "d", "h"]
    f = table(spark, sf, "load_forecast").groupBy("control_area", F.col("forecast_date").alias("d"), F.col("forecast_hour").alias("h")).agg(F.count("*").alias("_f"))
    s = table(spark, sf, "public_energy_state").groupBy("control_area", F.col("target_local_date").alias("d"), F.col("target_he").alias("h")).agg(F.count("*").alias("_s"))
    d = f.join(s, k, "full_outer")
    return d.groupBy("control_area").agg(F.count_if(F.col("_f").isNotNull() & F.col("_s").isNotNull()).alias("n_both"), F.count_if(F.col("_s").isNull()).alias("n_forecast_only"), F.count_if(F.col("_f").isNull()).alias("n_state_only"))


_HOURLY = "SELECT generator_id, date_trunc('hour', observation_timestamp) h, round(avg(dispatch_mw), 6) v FROM own_generator WHERE observation_timestamp IS NOT NULL AND generator_id IS NOT NULL GROUP BY 1, 2"


def _generator_hours(spark, sf):
    d = table(spark, sf, "own_generator").where("observation_timestamp IS NOT NULL AND generator_id IS NOT NULL")
    return d.groupBy("generator_id", F.date_trunc("hour", "observation_timestamp").alias("h")).agg(F.round(F.avg("dispatch_mw"), 6).alias("v"))


@query(f"""WITH g AS ({_HOURLY}), s AS (SELECT DISTINCT state_row_id, generator_id, date_trunc('hour', decision_cutoff_utc) c FROM public_energy_state),
 x AS (SELECT state_row_id, count(v) n, array_to_string(list(v::VARCHAR ORDER BY h), ',') a FROM s JOIN g ON s.generator_id = g.generator_id AND g.h <= s.c AND g.h > s.c - INTERVAL 4 HOURS GROUP BY 1)
 SELECT DISTINCT p.state_row_id, CASE WHEN n = 4 THEN a END AS last_hours FROM public_energy_state p LEFT JOIN x ON p.state_row_id = x.state_row_id""")
def last_hours(spark, sf):
    """The last four hourly means of the generator at the cutoff, if all are there."""
    d = J.tail_as_of(table(spark, sf, "public_energy_state"), "state_row_id", "generator_id", "decision_cutoff_utc", _generator_hours(spark, sf), "h", "v", 4)
    return d.select("state_row_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("last_hours"))


@query("""SELECT control_area, forecast_date, forecast_hour, region, forecast_id, vintage FROM (SELECT *, row_number() OVER (PARTITION BY control_area, forecast_date, forecast_hour, region ORDER BY published_datetime_utc DESC, forecast_id DESC) k FROM load_forecast
 WHERE published_datetime_utc <= timezone('UTC', timezone('America/New_York', forecast_date::DATE - INTERVAL 1 DAY + INTERVAL 10 HOURS))) WHERE k = 1""")
def newest_vintages(spark, sf):
    """Per area, date, hour and region the newest forecast published by ten o'clock local time of the day before."""
    d = table(spark, sf, "load_forecast")
    return J.newest_before(d, ["control_area", "forecast_date", "forecast_hour", "region"], "published_datetime_utc", decision_cutoff(F.col("forecast_date").cast("date")), [F.col("forecast_id")]).select("control_area", "forecast_date", "forecast_hour", "region", "forecast_id", "vintage")


@query("""WITH c AS (SELECT group_index g, row_number() OVER (PARTITION BY group_index ORDER BY candidate_index, generated_tokens) i, generated_tokens v FROM t45_k4_free_candidates)
 SELECT a.g AS group_index, (max(a.n) * (max(a.n) - 1)) // 2 AS n_pairs, coalesce(max(p.r), 0) AS n_rising FROM (SELECT g, count(*) n FROM c GROUP BY 1) a LEFT JOIN (SELECT x.g, count(*) r FROM c x JOIN c y ON x.g = y.g AND x.i < y.i AND y.v > x.v GROUP BY 1) p ON a.g = p.g GROUP BY 1""")
def ordered_pairs(spark, sf):
    """Ordered pairs of a prompt's candidates, and those in which the answer gets longer."""
    return J.pair_gaps(table(spark, sf, "t45_k4_free_candidates"), "group_index", "candidate_index", "generated_tokens")


@query("SELECT prompt_hash, target_json FROM public_state_v1_sft WHERE upper(trim(split, ' ' || chr(10) || chr(9) || chr(13))) = 'TRAIN' INTERSECT SELECT prompt_hash, target_json FROM public_state_v1_sft WHERE upper(trim(split, ' ' || chr(10) || chr(9) || chr(13))) IN ('DEV', 'HOLDOUT')")
def exact_overlap(spark, sf):
    """Hash and target pairs that occur on both sides of the split."""
    d = table(spark, sf, "public_state_v1_sft").withColumn("s", F.upper(F.trim(F.regexp_replace("split", r"^\s+|\s+$", ""))))
    return J.present_on_both(d.where("s = 'TRAIN'"), d.where("s IN ('DEV', 'HOLDOUT')"), ["prompt_hash", "target_json"])


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def never_sold(spark, sf):
    """Expected keys that aren't present."""
    return J.missing_from(table(spark, sf, "part"), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT kind, nation, count(*) AS n_rows, round(sum(balance), 2) AS balance FROM (SELECT 'customer' kind, c_nationkey nation, c_acctbal balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2")
def stacked_parties(spark, sf):
    """Union of two tables by name."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("kind", "nation").agg(F.count("*").alias("n_rows"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""SELECT generator_id, strftime(min(observation_timestamp) FILTER (own_lmp IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS first_priced, arg_min(dispatch_mw, record_id) FILTER (dispatch_mw IS NOT NULL) AS first_dispatch, arg_min(own_lmp, record_id) FILTER (own_lmp IS NOT NULL) AS first_lmp FROM own_generator GROUP BY 1""")
def first_values(spark, sf):
    """First known value of each column per generator."""
    d = table(spark, sf, "own_generator")
    t = d.groupBy("generator_id").agg(_text(F.min(F.when(F.col("own_lmp").isNotNull(), F.col("observation_timestamp"))), "first_priced"))
    v = J.first_known(d, "generator_id", "record_id", ["dispatch_mw", "own_lmp"]).select("generator_id", F.col("dispatch_mw").alias("first_dispatch"), F.col("own_lmp").alias("first_lmp"))
    return t.join(v, t["generator_id"].eqNullSafe(v["generator_id"])).select(t["generator_id"], "first_priced", "first_dispatch", "first_lmp")


# Series and windows


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) t, count(value) n FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) t FROM h GROUP BY 1)
 SELECT g.event_type, strftime(g.t, '%Y-%m-%d %H:%M:%S') AS hour_utc, h.n AS n_values FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.t = h.t""")
def hours_with_gaps(spark, sf):
    """Hourly counts with a row for every empty hour."""
    h = S.resample(table(spark, sf, "events"), ["event_type"], "ts", "value").drop("mean_value")
    return S.with_empty_hours(h, ["event_type"], "ts").select("event_type", _text("ts", "hour_utc"), "n_values")


@query(f"""SELECT generator_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS gap_from, strftime(h, '%Y-%m-%d %H:%M:%S') AS gap_to, (epoch(h) - epoch(a))::BIGINT // 3600 - 1 AS missing_hours FROM (SELECT *, lag(h) OVER (PARTITION BY generator_id ORDER BY h) a FROM ({_HOURLY})) WHERE h > a + INTERVAL 1 HOUR""")
def generator_gaps(spark, sf):
    """Stretches without a record of a generator."""
    d = S.gaps_over(_generator_hours(spark, sf), ["generator_id"], "h")
    return d.select("generator_id", _text("gap_from", "gap_from"), _text("gap_to", "gap_to"), F.col("missing_hours").cast("long").alias("missing_hours"))


@query(f"""WITH h AS ({_HOURLY}), g AS (SELECT generator_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) t FROM h GROUP BY 1), x AS (SELECT g.generator_id, g.t, h.v FROM g LEFT JOIN h ON g.generator_id = h.generator_id AND g.t = h.h),
 y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p ta, last_value(v IGNORE NULLS) OVER p va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q tb, first_value(v IGNORE NULLS) OVER q vb FROM x
 WINDOW p AS (PARTITION BY generator_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY generator_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT generator_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS hour_utc, v IS NULL AND va IS NOT NULL AND vb IS NOT NULL AS imputed, round(coalesce(v, va + (vb - va) * (epoch(t) - epoch(ta)) / (epoch(tb) - epoch(ta)))::DECIMAL(30, 9), 3)::DOUBLE AS dispatch_mw FROM y""")
def interpolated(spark, sf):
    """Hourly generator series with inner gaps filled on straight lines."""
    d = S.with_empty_hours(_generator_hours(spark, sf), ["generator_id"], "h")
    return S.interpolate_inside(d, ["generator_id"], "h", "v").select("generator_id", _text("h", "hour_utc"), "imputed", F.round(F.col("v").cast("decimal(30,9)"), 3).cast("double").alias("dispatch_mw"))


@query("""SELECT generator_id, count(*) AS n_rows, bool_and(coalesce(up, true)) AS rising, count(DISTINCT observation_timestamp) = count(observation_timestamp) AS unique_times FROM (SELECT *, observation_timestamp > lag(observation_timestamp) OVER (PARTITION BY generator_id ORDER BY record_id) up FROM own_generator) GROUP BY 1""")
def order_checks(spark, sf):
    """Whether a generator's records come in strictly rising time order."""
    return S.rising_times(table(spark, sf, "own_generator"), ["generator_id"], "record_id", "observation_timestamp")


@query("SELECT record_id, generator_id FROM (SELECT *, row_number() OVER (PARTITION BY generator_id, observation_timestamp ORDER BY availability_timestamp DESC NULLS LAST, record_id DESC) k FROM own_generator) WHERE k = 1")
def latest_corrections(spark, sf):
    """One record per generator and observation: the one available last."""
    return J.keep_one(table(spark, sf, "own_generator"), ["generator_id", "observation_timestamp"], [F.desc_nulls_last("availability_timestamp"), F.desc("record_id")]).select("record_id", "generator_id")


_DAY = """SELECT control_area, forecast_date, list(s ORDER BY forecast_hour) v FROM (SELECT control_area, forecast_date, forecast_hour, round(sum(forecast_mw), 3) s FROM load_forecast WHERE vintage = 'day_ahead' AND forecast_hour BETWEEN 1 AND 24 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 24"""


def _days(spark, sf):
    d = S.dense_day(table(spark, sf, "load_forecast").where("vintage = 'day_ahead'"), ["control_area", "forecast_date"], "forecast_hour", "forecast_mw")
    return d.withColumn("day", F.transform("day", lambda x: F.round(x, 3)))


@query(f"""SELECT control_area, forecast_date, list_max(v) AS peak_mw, list_position(v, list_max(v))::BIGINT AS peak_hour, list_min(v) AS minimum_mw, round(list_sum(v), 3) AS energy_mwh, round(list_sum(v) / 24 / list_max(v), 9) AS load_factor,
 round((v[24] - v[1]) / 23, 6) AS trend, round(list_max(list_transform(range(1, 24), lambda i: v[i + 1] - v[i])), 6) AS max_up, round(list_min(list_transform(range(1, 24), lambda i: v[i + 1] - v[i])), 6) AS max_down FROM ({_DAY})""")
def day_vectors(spark, sf):
    """Statistics of each area's 24-hour forecast vector."""
    v = F.col("day")
    r = lambda c, n, name: F.round(c, n).alias(name)
    return _days(spark, sf).select(
        "control_area", "forecast_date", F.array_max(v).alias("peak_mw"), V.first_argmax(v).cast("long").alias("peak_hour"), F.array_min(v).alias("minimum_mw"), r(V.total(v), 3, "energy_mwh"),
        r(V.load_factor(v), 9, "load_factor"), r(V.trend(v), 6, "trend"), r(F.array_max(V.differences(v)), 6, "max_up"), r(F.array_min(V.differences(v)), 6, "max_down"),
    )


@query("""SELECT control_area, forecast_date, forecast_hour, array_to_string(list(region || '=' || s::VARCHAR ORDER BY region), ',') AS by_region FROM (SELECT control_area, forecast_date, forecast_hour, region, round(sum(forecast_mw), 3) s, count(*) OVER (PARTITION BY control_area, forecast_date, forecast_hour) n FROM load_forecast WHERE region IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE n = 8 GROUP BY 1, 2, 3""")
def complete_zone_maps(spark, sf):
    """Hours for which every zone has a forecast, as maps zone -> MW."""
    k = ["control_area", "forecast_date", "forecast_hour"]
    d = table(spark, sf, "load_forecast")
    zones = ["CONNECTICUT", "MAINE", "NEMASSBOST", "NEWHAMPSHIRE", "RHODEISLAND", "SEMASS", "VERMONT", "WCMASS"]
    m = S.as_map(d, k, "region", "forecast_mw").join(S.complete_groups(d.where("region IS NOT NULL"), k, "region", zones), k)
    text = F.array_join(F.transform(F.map_entries("by_name"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 3).cast("string"))), ",")
    return m.select(*k, text.alias("by_region"))


@query("""WITH h AS (SELECT control_area, forecast_date::DATE d, count(DISTINCT forecast_hour) n FROM load_forecast WHERE forecast_date IS NOT NULL GROUP BY 1, 2), g AS (SELECT control_area, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE d FROM h GROUP BY 1)
 SELECT g.control_area, g.d::VARCHAR AS day, coalesce(n, 0)::INT AS n_hours, CASE WHEN n >= 24 THEN 'COMPLETE' WHEN n > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM g LEFT JOIN h ON g.control_area = h.control_area AND g.d = h.d""")
def forecast_coverage(spark, sf):
    """Every day of an area: complete, partial or missing."""
    return S.day_coverage(table(spark, sf, "load_forecast"), ["control_area"], "forecast_date", "forecast_hour")


@query("SELECT control_area, forecast_date, forecast_hour, region, vintage, count(*) AS n_rows, count(DISTINCT forecast_mw) <= 1 AS agree, min(forecast_id) AS kept FROM load_forecast GROUP BY 1, 2, 3, 4, 5")
def repeated_forecasts(spark, sf):
    """Repeated forecasts, whether they agree, and which one is kept."""
    return S.agreed(table(spark, sf, "load_forecast"), ["control_area", "forecast_date", "forecast_hour", "region", "vintage"], "forecast_mw", "forecast_id")


# Statistics and audits


@query("SELECT location, min(lmp) AS low, round(avg(lmp), 6) AS mean, round(median(lmp), 6) AS median, round(quantile_cont(lmp, 0.1), 6) AS p10, round(quantile_cont(lmp, 0.9), 6) AS p90, max(lmp) AS high FROM lmp_hourly_hub WHERE isfinite(lmp) GROUP BY 1")
def price_profile(spark, sf):
    """Six numbers of each location's prices."""
    d = A.six_numbers(table(spark, sf, "lmp_hourly_hub").where(N.is_finite(F.col("lmp"))), ["location"], "lmp")
    return d.select("location", "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90")])


_GEN_COLS = ["dispatch_mw", "utilization", "headroom_mw", "own_lmp", "observation_timestamp", "availability_timestamp"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_rate FROM own_generator" for c in _GEN_COLS))
def null_profile(spark, sf):
    """Null rate per column in one pass."""
    return A.null_rates(table(spark, sf, "own_generator"), _GEN_COLS).withColumn("null_rate", F.round("null_rate", 9))


@query("SELECT prompt_hash, count(*) AS n_rows, count(DISTINCT target_json) AS n_target, count(DISTINCT json_extract_string(target_json, '$.a')) AS n_action FROM public_state_v1_sft GROUP BY 1 HAVING count(*) > 1")
def prompt_conflicts(spark, sf):
    """Prompts with several records, and how many targets and actions they have."""
    d = table(spark, sf, "public_state_v1_sft")
    return A.conflicts(d, ["prompt_hash"], {"target": F.col("target_json"), "action": F.get_json_object("target_json", "$.a")}).where("n_rows > 1")


@query("SELECT prompt_hash, to_json(list_sort(list(DISTINCT sft_row_id)))::VARCHAR AS members FROM public_state_v1_sft WHERE prompt_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target_json) > 1")
def collision_members(spark, sf):
    """Members of the prompts whose targets differ."""
    d = table(spark, sf, "public_state_v1_sft").where("prompt_hash IS NOT NULL")
    bad = d.groupBy("prompt_hash").agg(F.countDistinct("target_json").alias("n")).where("n > 1").select("prompt_hash")
    return d.join(bad, "prompt_hash").groupBy("prompt_hash").agg(F.to_json(F.sort_array(F.collect_set("sft_row_id"))).alias("members"))


_LEVELS = {"X0": ["provenance"], "X1": ["provenance", "n"], "X2": ["provenance", "n", "w"]}
_LADDER = "(SELECT provenance, length(prompt) // 50 n, floor(sample_weight * 4)::BIGINT w, json_extract_string(target_json, '$.a') a FROM public_state_v1_sft)"


@query(" UNION ALL ".join(f"""SELECT '{n}' AS level, count(*) AS n_classes, count_if(k > 1) AS n_conflicts, round(sum(m * ln(m) - s) / sum(m), 9) AS entropy FROM (SELECT sum(c) m, count(*) k, sum(c * ln(c)) s FROM (SELECT {', '.join(cols)}, a, count(*) c FROM {_LADDER} GROUP BY ALL) GROUP BY {', '.join(cols)})""" for n, cols in _LEVELS.items()))
def entropy_ladder(spark, sf):
    """What growing feature sets leave open about the action: classes, conflicts, conditional entropy."""
    d = table(spark, sf, "public_state_v1_sft").select("provenance", F.floor(F.length("prompt") / 50).alias("n"), F.floor(F.col("sample_weight") * 4).alias("w"), F.get_json_object("target_json", "$.a").alias("a"))
    return A.feature_ladder(d, _LEVELS, "a").withColumn("entropy", F.round("entropy", 9))


@query("SELECT l_partkey, arg_max(l_suppkey, {'m': m, 's': -l_suppkey}) AS best_choice, round(max(m), 6) AS best_value FROM (SELECT l_partkey, l_suppkey, round(avg(l_extendedprice), 6) m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def best_choices(spark, sf):
    """Per part the supplier with the highest mean price; the smaller key wins ties."""
    means = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("m"))
    d = A.best_choice(means, ["l_partkey"], "l_suppkey", "m")
    return d.select("l_partkey", "best_choice", F.round("best_value", 6).alias("best_value"))


@query("SELECT candidate_row_id, round(CASE WHEN d <= 1e-8 THEN 0.0 ELSE (generated_tokens - m) / (d + 1e-8) END, 6) AS advantage FROM (SELECT candidate_row_id, generated_tokens, avg(generated_tokens) OVER w m, stddev_pop(generated_tokens) OVER w d FROM t45_k4_free_candidates WINDOW w AS (PARTITION BY group_index))")
def group_advantages(spark, sf):
    """Each candidate against its group in population standard deviations."""
    d = A.group_advantage(table(spark, sf, "t45_k4_free_candidates").select("candidate_row_id", "group_index", "generated_tokens"), "group_index", "generated_tokens")
    return d.select("candidate_row_id", F.round("advantage", 6).alias("advantage"))


@query("""SELECT group_index, count(*) AS n_rows, count(DISTINCT raw_output) AS n_outputs, count(DISTINCT candidate_index) = 4 AS complete, max(generated_tokens) - min(generated_tokens) AS spread, round(stddev_pop(generated_tokens), 6) AS deviation, count_if(eos_completed) AS n_ended FROM t45_k4_free_candidates GROUP BY 1""")
def candidate_groups(spark, sf):
    """Variation inside each prompt's group of candidates."""
    return table(spark, sf, "t45_k4_free_candidates").groupBy("group_index").agg(
        F.count("*").alias("n_rows"), F.countDistinct("raw_output").alias("n_outputs"), (F.countDistinct("candidate_index") == 4).alias("complete"),
        (F.max("generated_tokens") - F.min("generated_tokens")).alias("spread"), F.round(F.stddev_pop("generated_tokens"), 6).alias("deviation"), F.count_if("eos_completed").alias("n_ended"),
    )


@query("SELECT temperature, max_new_tokens, round(avg(eos_completed::INT), 9) AS ended_rate, round(avg(truncated::INT), 9) AS truncated_rate, count(*) AS n_rows, round(corr(generated_tokens, candidate_index), 6) AS correlation FROM t45_k4_free_candidates GROUP BY 1, 2")
def flag_rates(spark, sf):
    """Rates of the recorded flags per sampling setting."""
    b = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 9).alias(n)
    return table(spark, sf, "t45_k4_free_candidates").groupBy("temperature", "max_new_tokens").agg(b("eos_completed", "ended_rate"), b("truncated", "truncated_rate"), F.count("*").alias("n_rows"), F.round(F.corr("generated_tokens", "candidate_index"), 6).alias("correlation"))


@query("SELECT source, arg_min(lang, {'n': -n, 'l': lang}) AS top_value, max(n) AS top_count FROM (SELECT source, lang, count(*) n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def usual_language(spark, sf):
    """Commonest language label per source; the first in order wins ties."""
    return A.most_frequent(table(spark, sf, "documents"), ["source"], "lang")


@query("SELECT split, round(quantile_cont(generated_tokens, 0.9), 6) AS p90, round(quantile_cont(generated_tokens, 0.95), 6) AS p95, round(quantile_cont(generated_tokens, 0.99), 6) AS p99, count(*) AS n_rows FROM t45_k4_free_candidates GROUP BY 1")
def length_percentiles(spark, sf):
    """Upper percentiles of answer lengths."""
    d = table(spark, sf, "t45_k4_free_candidates")
    p = lambda i, n: F.round(F.try_element_at("quantiles", F.lit(i)), 6).alias(n)
    q = A.quantiles(d, ["split"], F.col("generated_tokens"), [0.9, 0.95, 0.99]).select(F.col("split").alias("_s"), p(1, "p90"), p(2, "p95"), p(3, "p99"))
    return d.groupBy("split").agg(F.count("*").alias("n_rows")).join(q, F.col("split").eqNullSafe(F.col("_s")), "left").drop("_s")


@query("""SELECT sft_row_id, round(list_sum(list_transform(b, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END)), 9) AS entropy, round(exp(list_sum(list_transform(b, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END))), 9) AS support,
 round(1 - list_sum(list_transform(b, lambda x: x * x * x * x)), 9) AS varies, round(list_sum(list_transform(b, lambda x, i: (x - CASE WHEN i - 1 = a THEN 1 ELSE 0 END) * (x - CASE WHEN i - 1 = a THEN 1 ELSE 0 END))), 9) AS brier
 FROM (SELECT sft_row_id, json_extract(target_json, '$.b')::DOUBLE[] b, json_extract(target_json, '$.a')::INT a FROM public_state_v1_sft)""")
def belief_measures(spark, sf):
    """Entropy, effective support, chance that four draws vary, and Brier score of each target's belief."""
    d = table(spark, sf, "public_state_v1_sft").select("sft_row_id", F.from_json("target_json", R.DECISION).alias("r"))
    b, r = F.col("r.b"), lambda c, n: F.round(c, 9).alias(n)
    return d.select("sft_row_id", r(V.entropy(b), "entropy"), r(V.effective_support(b), "support"), r(V.chance_all_vary(b, 4), "varies"), r(V.brier(b, F.col("r.a")), "brier"))


@query("""SELECT sft_row_id, array_to_string(list_transform(b, lambda x: round(exp(x - list_max(b)) / list_sum(list_transform(b, lambda y: exp(y - list_max(b)))), 6)::VARCHAR), ',') AS weights FROM (SELECT sft_row_id, json_extract(target_json, '$.b')::DOUBLE[] b FROM public_state_v1_sft)""")
def belief_softmax(spark, sf):
    """Softmax of each belief vector."""
    d = table(spark, sf, "public_state_v1_sft").select("sft_row_id", F.from_json("target_json", R.DECISION)["b"].alias("b"))
    return d.select("sft_row_id", F.array_join(F.transform(V.softmax(F.col("b")), lambda x: F.round(x, 6).cast("string")), ",").alias("weights"))


@query("""WITH d AS (SELECT sft_row_id, json_extract(target_json, '$.b')::DOUBLE[] b FROM public_state_v1_sft), r AS (SELECT *, list_sort(list_transform(b, lambda x, i: {'n': -x, 'i': i})) r FROM d),
 k AS (SELECT *, list_filter(r, lambda y, j: j = 1 OR list_reduce(list_transform(r[1:j - 1], lambda z: -z.n), lambda s, z: s + z, 0.0::DOUBLE) < 0.9) k FROM r), m AS (SELECT *, list_reduce(list_transform(k, lambda z: -z.n), lambda s, z: s + z, 0.0::DOUBLE) m FROM k)
 SELECT sft_row_id, len(list_filter(k, lambda z: -z.n > 0))::INT AS n_kept, round(list_sum(list_transform(b, lambda x, i: abs(x - CASE WHEN list_contains(list_transform(k, lambda z: z.i), i) THEN x / m ELSE 0.0 END))) / 2, 9) AS distance FROM m""")
def belief_top_mass(spark, sf):
    """Each belief cut to its likeliest nine tenths, and how far that moves it."""
    d = table(spark, sf, "public_state_v1_sft").select("sft_row_id", F.from_json("target_json", R.DECISION)["b"].alias("b"))
    d = d.withColumn("top", V.top_p(F.col("b"), 0.9))
    return d.select("sft_row_id", F.size(F.filter("top", lambda x: x > 0)).alias("n_kept"), F.round(V.total_variation(F.col("b"), F.col("top")), 9).alias("distance"))


@query()
def belief_draws(spark, sf):
    """Seeded draws from each target's belief: how often each class came up, and what was to be expected."""
    d = table(spark, sf, "public_state_v1_sft").select("sft_row_id", F.from_json("target_json", R.DECISION)["b"].alias("b")).where(F.size("b") > 0)
    drawn = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: V.draw(F.col("b"), V.uniform(F.col("sft_row_id"), k)))).alias("class")).groupBy("class").agg(F.count("*").alias("n_drawn"))
    due = d.select(F.posexplode("b").alias("class", "p")).groupBy("class").agg(F.round(F.sum("p") * 16, 3).alias("n_expected"))
    return due.join(drawn, "class", "left").select("class", "n_expected", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"))


_SPLIT = "upper(trim(split, ' ' || chr(10) || chr(9) || chr(13)))"


@query(f"""WITH n AS (SELECT {_SPLIT} = 'TRAIN' t, json_extract_string(target_json, '$.a') a, count(*) c FROM public_state_v1_sft WHERE {_SPLIT} IS NOT NULL GROUP BY 1, 2), p AS (SELECT a, coalesce(sum(c) FILTER (t), 0) / sum(sum(c) FILTER (t)) OVER () x, coalesce(sum(c) FILTER (NOT t), 0) / sum(sum(c) FILTER (NOT t)) OVER () y FROM n GROUP BY 1)
 SELECT round(sum(abs(x - y)) / 2, 9) AS distance FROM p""")
def action_shift(spark, sf):
    """Total variation between the actions of TRAIN and of the rest."""
    d = table(spark, sf, "public_state_v1_sft").select((F.upper(F.regexp_replace("split", r"^\s+|\s+$", "")) == "TRAIN").alias("t"), F.get_json_object("target_json", "$.a").alias("a")).where("t IS NOT NULL")
    n = d.groupBy("a").agg(F.count_if("t").alias("x"), F.count_if(~F.col("t")).alias("y"))
    s = n.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))  # one row
    return n.join(F.broadcast(s)).agg(F.round(F.sum(F.abs(F.col("x") / F.col("sx") - F.col("y") / F.col("sy"))) / 2, 9).alias("distance"))


@query("""SELECT c AS check_name, n AS n_failed, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT 'published_before_cutoff' c, count_if(NOT coalesce(forecast_publish_utc <= decision_cutoff_utc, false)) n FROM public_energy_state UNION ALL SELECT 'cutoff_before_target', count_if(NOT coalesce(decision_cutoff_utc < target_hour_utc, false)) FROM public_energy_state
 UNION ALL SELECT 'hour_in_day', count_if(NOT coalesce(target_he BETWEEN 1 AND 24, false)) FROM public_energy_state UNION ALL SELECT 'has_generator', count_if(generator_id IS NULL) FROM public_energy_state)""")
def timestamp_audit(spark, sf):
    """Time and presence rules of the decisions, counted in one pass."""
    c = F.col
    rules = {"published_before_cutoff": c("forecast_publish_utc") <= c("decision_cutoff_utc"), "cutoff_before_target": c("decision_cutoff_utc") < c("target_hour_utc"), "hour_in_day": c("target_he").between(1, 24), "has_generator": c("generator_id").isNotNull()}
    return A.checks(table(spark, sf, "public_energy_state"), rules)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def ranked_orders(spark, sf):
    """Top-k report in a lexicographic order."""
    return A.rank_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 25)


_ANSWERED = """SELECT c.temperature, json_extract_string(c.raw_output, '$.a') ca, json_extract_string(t.target_json, '$.a') ta, json_extract_string(c.raw_output, '$.i') ci, json_extract_string(t.target_json, '$.i') ti
 FROM t45_k4_free_candidates c JOIN (SELECT example_id, arg_min(target_json, sft_row_id) target_json FROM public_state_v1_sft WHERE example_id IS NOT NULL GROUP BY 1) t ON c.example_id = t.example_id WHERE c.raw_output LIKE '{%' AND json_valid(c.raw_output)"""


@query(f"SELECT temperature, count(*) AS n_rows, count_if(ca = ta) AS same_action, count_if(ci = ti) AS same_intent FROM ({_ANSWERED}) GROUP BY 1")
def field_agreement(spark, sf):
    """Answers that are JSON objects against the first recorded target of their example, field by field."""
    t = table(spark, sf, "public_state_v1_sft").where("example_id IS NOT NULL").groupBy("example_id").agg(F.min_by("target_json", "sft_row_id").alias("target_json"))
    c = table(spark, sf, "t45_k4_free_candidates").where(F.col("raw_output").startswith("{") & R.is_json(F.col("raw_output")))
    same = lambda k: F.count_if(F.get_json_object("raw_output", f"$.{k}") == F.get_json_object("target_json", f"$.{k}"))
    return c.select("example_id", "temperature", "raw_output").join(t, "example_id").groupBy("temperature").agg(F.count("*").alias("n_rows"), same("a").alias("same_action"), same("i").alias("same_intent"))


@query("""WITH t AS (SELECT example_id, arg_min(target_json, sft_row_id) j FROM public_state_v1_sft WHERE example_id IS NOT NULL GROUP BY 1), c AS (SELECT example_id, list_filter(regexp_extract_all(raw_output, '\\{[^{}]*\\}'), lambda x: json_valid(x))[1] o FROM t45_k4_free_candidates),
 d AS (SELECT try_cast(json_extract(o, '$.b') AS DOUBLE[]) a, json_extract(j, '$.b')::DOUBLE[] b FROM c JOIN t ON c.example_id = t.example_id)
 SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS NULL OR b[i] IS NULL OR abs(a[i] - b[i]) > 1e-7 * (1 + abs(b[i])))), 0) END AS position, count(*) AS n_rows FROM d GROUP BY 1""")
def first_divergence(spark, sf):
    """Where each answer's belief first leaves that of its example's target: position of the vector, 0 for none."""
    t = table(spark, sf, "public_state_v1_sft").where("example_id IS NOT NULL").groupBy("example_id").agg(F.min_by("target_json", "sft_row_id").alias("target_json"))
    c = table(spark, sf, "t45_k4_free_candidates").select("example_id", R.first_object(F.col("raw_output")).alias("answer"))
    belief = lambda c: F.from_json(c, R.DECISION)["b"]
    d = c.join(t, "example_id").select(V.first_difference(belief("answer"), belief("target_json")).alias("position"))
    return d.groupBy("position").agg(F.count("*").alias("n_rows"))


@query()
def table_digests(spark, sf):
    """Order-free digest of each domain table."""
    names = ["public_energy_state", "load_forecast", "own_generator", "t45_k4_free_candidates"]
    parts = [A.table_hash(table(spark, sf, n)).select(F.lit(n).alias("table_name"), "n_rows", "digest") for n in names]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT group_index, arg_min(candidate_row_id, candidate_row_id) AS first_candidate, count(DISTINCT physical_state_id) AS n_states FROM t45_k4_free_candidates GROUP BY 1""")
def first_per_group(spark, sf):
    """First candidate of each group in an explicit order (Spark has no order of files)."""
    d = table(spark, sf, "t45_k4_free_candidates")
    first = J.keep_one(d, ["group_index"], [F.col("candidate_row_id")]).select("group_index", F.col("candidate_row_id").alias("first_candidate"))
    n = d.groupBy("group_index").agg(F.countDistinct("physical_state_id").alias("n_states"))
    return first.join(n, "group_index")


BUS_LOAD = {5: 90.0, 7: 100.0, 9: 125.0}  # fixed values: base load in MW of the network's load buses


@query("""SELECT state_row_id, round(total * 0.2857142857142857, 6) AS bus5_mw, round(total * 0.31746031746031744, 6) AS bus7_mw, round(total * 0.3968253968253968, 6) AS bus9_mw FROM (SELECT state_row_id, current_load_mw total FROM public_energy_state)""")
def bus_loads(spark, sf):
    """Each state's load spread over the network's load buses by their base shares."""
    d = table(spark, sf, "public_energy_state")
    return d.select("state_row_id", *[F.round(F.col("current_load_mw") * (mw / sum(BUS_LOAD.values())), 6).alias(f"bus{b}_mw") for b, mw in BUS_LOAD.items()])


# Further audits, expressions and readers


_FIELDS = ("b", "g", "cf", "i", "a", "p", "q")
_SIGNS = ", ".join(f"count(DISTINCT coalesce(json_extract(target_json, '$.{k}')::{'DOUBLE[]' if k in ('b', 'g', 'cf', 'p') else 'DOUBLE'}::VARCHAR, '')) AS n_{k}" for k in _FIELDS)
_CONFLICTS = f"SELECT prompt_hash, count(*) AS n_rows, {_SIGNS}, count(DISTINCT coalesce(json_extract(target_json, '$.a')::DOUBLE::VARCHAR, '') || '|' || coalesce(json_extract(target_json, '$.p')::DOUBLE[]::VARCHAR, '')) AS n_action_plan FROM public_state_v1_sft WHERE prompt_hash IS NOT NULL GROUP BY 1"


def _signed(spark, sf):
    r = table(spark, sf, "public_state_v1_sft").where("prompt_hash IS NOT NULL").select("sft_row_id", "prompt_hash", F.from_json("target_json", R.DECISION).alias("r"))
    sign = lambda k: F.coalesce(F.col(f"r.{k}").cast("string"), F.lit(""))
    return r.select("sft_row_id", "prompt_hash", *[sign(k).alias(k) for k in _FIELDS], F.concat(sign("a"), F.lit("|"), sign("p")).alias("action_plan"))


@query(_CONFLICTS)
def target_conflicts(spark, sf):
    """Per prompt the distinct values of each field of its targets, and of action and plan together."""
    return A.conflicts(_signed(spark, sf), ["prompt_hash"], {k: F.col(k) for k in (*_FIELDS, "action_plan")})


_H = lambda k: f"(SELECT round(sum(m * ln(m) - s) / sum(m), 9) FROM (SELECT sum(c) m, sum(c * ln(c)) s FROM (SELECT prompt_hash, coalesce(json_extract(target_json, '$.{k}')::VARCHAR, '') v, count(*) c FROM public_state_v1_sft WHERE prompt_hash IS NOT NULL GROUP BY 1, 2) GROUP BY prompt_hash))"


@query(f"SELECT count(*) AS n_classes, count_if(greatest({', '.join(f'n_{k}' for k in _FIELDS)}) > 1) AS n_conflicts, {', '.join(f'max(n_{k}) AS most_{k}' for k in _FIELDS)}, {_H('a')} AS entropy_action, {_H('i')} AS entropy_intent FROM ({_CONFLICTS})")
def identifiability(spark, sf):
    """Whether a prompt tells its target: classes, classes with conflicts, the most values of a field, what is left open."""
    d = _signed(spark, sf)
    per = target_conflicts(spark, sf)
    most = per.agg(F.count("*").alias("n_classes"), F.count_if(F.greatest(*[F.col(f"n_{k}") for k in _FIELDS]) > 1).alias("n_conflicts"), *[F.max(f"n_{k}").alias(f"most_{k}") for k in _FIELDS])
    for k, name in (("a", "entropy_action"), ("i", "entropy_intent")):
        most = most.join(A.conditional_entropy(d, ["prompt_hash"], k).select(F.round("entropy", 9).alias(name)))  # one row each
    return most


@query("SELECT s.prompt_hash, s.sft_row_id FROM public_state_v1_sft s JOIN (SELECT prompt_hash FROM public_state_v1_sft WHERE prompt_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target_json) > 1) b ON s.prompt_hash = b.prompt_hash")
def collision_rows(spark, sf):
    """Rows of the prompts whose targets differ, one by one: no group is gathered."""
    d = table(spark, sf, "public_state_v1_sft").where("prompt_hash IS NOT NULL").select("prompt_hash", "sft_row_id", "target_json")
    bad = d.groupBy("prompt_hash").agg(F.min("target_json").alias("_a"), F.max("target_json").alias("_b")).where("_a <> _b").select("prompt_hash")
    return d.join(bad, "prompt_hash", "left_semi").select("prompt_hash", "sft_row_id")


@query("""WITH t AS (SELECT example_id, count(*) n, count(DISTINCT prompt) p, min(prompt) x FROM public_state_v1_sft WHERE example_id IS NOT NULL GROUP BY 1)
 SELECT c.split, count(*) AS n_rows, count_if(t.n IS NOT NULL) AS n_id_found, count_if(t.p > 1) AS n_id_ambiguous, count_if(t.p = 1 AND t.x = c.prompt) AS n_same_prompt, count_if(t.p = 1 AND sha256(t.x) = sha256(c.prompt)) AS n_same_hash FROM t45_k4_free_candidates c LEFT JOIN t ON c.example_id = t.example_id GROUP BY 1""")
def identity_guard(spark, sf):
    """Candidates whose example id is recorded, is recorded with one prompt, and has the very prompt they answer."""
    t = table(spark, sf, "public_state_v1_sft").where("example_id IS NOT NULL").groupBy("example_id").agg(F.count("*").alias("n"), F.countDistinct("prompt").alias("p"), F.min("prompt").alias("x"))
    d = table(spark, sf, "t45_k4_free_candidates").select("split", "example_id", "prompt").join(t, "example_id", "left")
    one = F.col("p") == 1
    return d.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("n").isNotNull()).alias("n_id_found"), F.count_if(F.col("p") > 1).alias("n_id_ambiguous"),
        F.count_if(one & (F.col("x") == F.col("prompt"))).alias("n_same_prompt"), F.count_if(one & (R.sha256(F.col("x")) == R.sha256(F.col("prompt")))).alias("n_same_hash"),
    )


_KNOWN = ["k", "a", "b", "e", "g", "i", "p", "q"]


@query(f"""WITH d AS (SELECT 'events' AS origin, props AS j FROM events UNION ALL SELECT 'targets', target_json FROM public_state_v1_sft), k AS (SELECT origin, coalesce(CASE WHEN json_valid(j) THEN json_keys(j) END, []) k FROM d)
 SELECT origin, count(*) AS n_rows, count_if(len(list_filter(k, lambda x: x NOT IN ({', '.join(repr(x) for x in _KNOWN)}))) > 0) AS n_unexpected, count_if(len(list_filter(k, lambda x: contains(lower(x), 'cf'))) > 0) AS n_forbidden FROM k GROUP BY 1""")
def json_key_audit(spark, sf):
    """Key names inside JSON texts, at any depth, against a registry and a list of forbidden parts."""
    d = table(spark, sf, "events").select(F.lit("events").alias("origin"), F.col("props").alias("j")).unionByName(table(spark, sf, "public_state_v1_sft").select(F.lit("targets").alias("origin"), F.col("target_json").alias("j")))
    return d.groupBy("origin").agg(F.count("*").alias("n_rows"), F.count_if(F.size(R.unexpected_names(F.col("j"), _KNOWN)) > 0).alias("n_unexpected"), F.count_if(F.size(R.forbidden_names(F.col("j"), ["cf"])) > 0).alias("n_forbidden"))


@query(f"""SELECT 'rows' AS check_name, count(*) AS n FROM public_state_v1_sft UNION ALL SELECT 'split_not_listed', count_if(coalesce({_SPLIT}, '') NOT IN ('TRAIN', 'DEV', 'HOLDOUT')) FROM public_state_v1_sft UNION ALL SELECT 'columns_missing', 0
 UNION ALL SELECT 'ids_on_both_sides', count(*) FROM (SELECT example_id FROM public_state_v1_sft WHERE example_id IS NOT NULL AND {_SPLIT} = 'TRAIN' INTERSECT SELECT example_id FROM public_state_v1_sft WHERE example_id IS NOT NULL AND {_SPLIT} = 'DEV')""")
def dataset_manifest(spark, sf):
    """Rows, missing columns, rows of no listed split, and ids that two splits share."""
    d = table(spark, sf, "public_state_v1_sft")
    need = {"sft_row_id", "example_id", "split", "prompt", "target_json", "prompt_hash"}
    s = F.upper(F.regexp_replace("split", r"^\s+|\s+$", ""))
    counts = d.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(s, F.lit("")).isin("TRAIN", "DEV", "HOLDOUT")).alias("split_not_listed"), F.lit(len(need - set(d.columns))).cast("bigint").alias("columns_missing"))
    ids = d.where("example_id IS NOT NULL").withColumn("s", s)
    both = J.present_on_both(ids.where("s = 'TRAIN'"), ids.where("s = 'DEV'"), ["example_id"]).agg(F.lit("ids_on_both_sides").alias("check_name"), F.count("*").alias("n"))
    return counts.unpivot([], counts.columns, "check_name", "n").unionByName(both)


@query("SELECT control_area, target_local_date, target_he, region FROM public_energy_state WHERE target_he IS NOT NULL EXCEPT SELECT control_area, forecast_date, forecast_hour, region FROM load_forecast WHERE vintage = 'day_ahead' AND forecast_mw > 1000")
def hours_without_forecast(spark, sf):
    """Decision hours that no large day-ahead forecast covers (a difference with rows in it)."""
    f = table(spark, sf, "load_forecast").where("vintage = 'day_ahead' AND forecast_mw > 1000").select("control_area", F.col("forecast_date").alias("target_local_date"), F.col("forecast_hour").alias("target_he"), "region")
    keys = ["control_area", "target_local_date", "target_he", "region"]
    return table(spark, sf, "public_energy_state").where("target_he IS NOT NULL").select(*keys).subtract(f.select(*keys))


_PIVOT = "SELECT control_area, forecast_date, forecast_hour, region, avg(forecast_mw) FILTER (vintage = 'day_ahead') AS a, avg(forecast_mw) FILTER (vintage = 'in_day') AS b FROM load_forecast WHERE forecast_mw IS NOT NULL GROUP BY 1, 2, 3, 4"


@query(f"SELECT region, count(a) AS n_first, round(max(abs(b - a)), 6) AS max_abs_change FROM ({_PIVOT}) GROUP BY 1")
def vintage_changes(spark, sf):
    """Vintages side by side, their difference, and the largest effect per region."""
    k = ["control_area", "forecast_date", "forecast_hour", "region"]
    d = table(spark, sf, "load_forecast").where("forecast_mw IS NOT NULL").groupBy(*k, "vintage").agg(F.avg("forecast_mw").alias("mw"))
    wide = A.pivot_deltas(d, k, "vintage", ["day_ahead", "in_day"], "mw")
    top = A.largest_effects(wide, ["region"], ["d_in_day"]).select(F.col("region").alias("_r"), F.round("max_abs_d_in_day", 6).alias("max_abs_change"))
    return wide.groupBy("region").agg(F.count("v_day_ahead").alias("n_first")).join(top, F.col("region").eqNullSafe(F.col("_r"))).drop("_r")


@query(f"SELECT {_SPLIT} AS split_name, count(DISTINCT coalesce(json_extract_string(target_json, '$.a'), '?')) AS n_labels, round(any_value(h), 9) AS entropy FROM public_state_v1_sft JOIN (SELECT s, ln(sum(c)) - sum(c * ln(c)) / sum(c) h FROM (SELECT {_SPLIT} s, json_extract_string(target_json, '$.a') a, count(*) c FROM public_state_v1_sft GROUP BY 1, 2) GROUP BY 1) x ON x.s IS NOT DISTINCT FROM {_SPLIT} GROUP BY 1")
def action_entropy(spark, sf):
    """Entropy of the action per split."""
    d = table(spark, sf, "public_state_v1_sft").select(F.upper(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split_name"), F.get_json_object("target_json", "$.a").alias("a"))
    return A.entropy(d, ["split_name"], "a").withColumn("entropy", F.round("entropy", 9))


@query("SELECT region, count(*) AS n_rows, count_if(current_load_mw < q[1]) AS n_below, count_if(current_load_mw > q[2]) AS n_above, round(any_value(q[1]), 6) AS p01, round(any_value(q[2]), 6) AS p99 FROM public_energy_state, (SELECT quantile_cont(current_load_mw, [0.01, 0.99]) q FROM public_energy_state WHERE isfinite(current_load_mw)) GROUP BY 1")
def outer_percent(spark, sf):
    """Loads outside the first and the last percent of all."""
    d = table(spark, sf, "public_energy_state")
    fit = A.fit_quantiles(d, ["current_load_mw"], [0.01, 0.99]).select("quantiles")  # one row
    lo, hi, x = F.try_element_at("quantiles", F.lit(1)), F.try_element_at("quantiles", F.lit(2)), F.col("current_load_mw")
    return d.select("region", "current_load_mw").join(F.broadcast(fit)).groupBy("region").agg(F.count("*").alias("n_rows"), F.count_if(x < lo).alias("n_below"), F.count_if(x > hi).alias("n_above"), F.round(F.first(lo), 6).alias("p01"), F.round(F.first(hi), 6).alias("p99"))


@query(f"""SELECT {_SPLIT} AS split_name, round(avg(-ln(greatest(b[a + 1], 1e-12))), 9) AS mean_loss, round(avg(CASE WHEN list_position(b, list_max(b)) = a + 1 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (SELECT split, json_extract(target_json, '$.b')::DOUBLE[] b, json_extract(target_json, '$.a')::INT a FROM public_state_v1_sft) WHERE b IS NOT NULL AND a IS NOT NULL GROUP BY 1""")
def belief_scores(spark, sf):
    """Mean log loss of each target's action under its belief, and how often the likeliest class is the action."""
    d = table(spark, sf, "public_state_v1_sft").select(F.upper(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split_name"), F.from_json("target_json", R.DECISION).alias("r"))
    b, a = F.col("r.b"), F.col("r.a")
    hit = F.when(V.first_argmax(b) == a + 1, 1.0).otherwise(0.0)
    return d.where(b.isNotNull() & a.isNotNull()).groupBy("split_name").agg(F.round(F.avg(V.log_loss(b, a)), 9).alias("mean_loss"), F.round(F.avg(hit), 9).alias("accuracy"))


_BEST = "SELECT prompt_hash, arg_min(a, {'n': -n, 'a': a}) best FROM (SELECT prompt_hash, json_extract_string(target_json, '$.a') a, count(*) n FROM public_state_v1_sft WHERE prompt_hash IS NOT NULL AND json_extract_string(target_json, '$.a') IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


@query(f"SELECT sft_row_id, json_extract_string(target_json, '$.a') AS action, best AS best_action, regexp_replace(target_json, '(\"a\"\\s*:\\s*)\\d+', '\\1' || best) AS rewritten FROM public_state_v1_sft s JOIN ({_BEST}) b ON s.prompt_hash = b.prompt_hash WHERE json_extract_string(target_json, '$.a') <> best")
def rewritten_targets(spark, sf):
    """Targets whose action isn't the commonest one of their prompt, with that action put in."""
    d = table(spark, sf, "public_state_v1_sft").where("prompt_hash IS NOT NULL").select("sft_row_id", "prompt_hash", "target_json", F.get_json_object("target_json", "$.a").alias("action"))
    best = A.most_frequent(d, ["prompt_hash"], "action").select("prompt_hash", F.col("top_value").alias("best_action"))
    new = F.regexp_replace(F.col("target_json"), F.lit(r'("a"\s*:\s*)\d+'), F.concat(F.lit("$1"), F.col("best_action")))
    return d.join(best, "prompt_hash").where("action <> best_action").select("sft_row_id", "action", "best_action", new.alias("rewritten"))


@query("SELECT state_row_id, regexp_replace(generator_id, '[0-9]+', '', 'g') AS kind, printf('%s_he%02d', region, target_he) AS state_id, 'recorded' AS origin FROM public_energy_state WHERE region IS NOT NULL AND target_he IS NOT NULL")
def formatted_ids(spark, sf):
    """Ids without their digits, ids put together by a format, and a literal column."""
    d = table(spark, sf, "public_energy_state").where("region IS NOT NULL AND target_he IS NOT NULL")
    return d.select("state_row_id", F.regexp_replace("generator_id", "[0-9]+", "").alias("kind"), F.format_string("%s_he%02d", "region", "target_he").alias("state_id"), F.lit("recorded").alias("origin"))


@query(f"""SELECT s.state_row_id, CASE WHEN s.target_he BETWEEN 1 AND 24 THEN d.v[s.target_he] END AS hour_mw, round(100 * (d.v[24] - d.v[1]) / d.v[1], 6) AS percent_change FROM public_energy_state s JOIN ({_DAY}) d ON s.control_area = d.control_area AND s.target_local_date = d.forecast_date""")
def hour_of_day(spark, sf):
    """The decision's hour out of its day's forecast vector, and the day's change in percent."""
    d = _days(spark, sf).withColumnRenamed("forecast_date", "target_local_date")
    j = table(spark, sf, "public_energy_state").select("state_row_id", "control_area", "target_local_date", "target_he").join(d, ["control_area", "target_local_date"])
    return j.select("state_row_id", V.at_hour_ending(F.col("day"), F.col("target_he")).alias("hour_mw"), F.round(V.percent_change(F.col("day")), 6).alias("percent_change"))


@query(f"""SELECT control_area, forecast_date, round(list_max(n), 3) AS net_peak_mw, round(list_max(list_transform(range(1, 24), lambda i: abs(n[i + 1] - n[i]))), 3) AS max_ramp_mw FROM (SELECT control_area, forecast_date, list_transform(v, lambda x, i: x - v[1] * 0.1 * (i % 3)) n FROM ({_DAY}))""")
def net_loads(spark, sf):
    """A day's forecast less a second vector (a tenth of its first hour, by turns), its peak and largest ramp."""
    second = F.transform("day", lambda x, i: F.col("day")[0] * 0.1 * ((i + 1) % 3))
    d = _days(spark, sf).withColumn("net", V.subtract(F.col("day"), second))
    return d.select("control_area", "forecast_date", F.round(F.array_max("net"), 3).alias("net_peak_mw"), F.round(V.max_abs(V.differences(F.col("net"))), 3).alias("max_ramp_mw"))


_UTIL, _COUNT = r"max branch utilization\s*[:=]\s*([0-9.]+)", r"binding branch count\s*[:=]\s*([0-9]+)"


@query(f"""SELECT CASE WHEN u < 0.8 THEN 'LOW' WHEN u < 0.95 THEN 'ELEVATED' WHEN u IS NOT NULL THEN 'HIGH' WHEN n = 0 THEN 'LOW' WHEN n <= 2 THEN 'ELEVATED' WHEN n IS NOT NULL THEN 'HIGH' END AS stress, CASE WHEN n = 0 THEN 'FREE' WHEN n IS NOT NULL THEN 'CONGESTED' END AS congestion, count(*) AS n_rows
 FROM (SELECT try_cast(nullif(regexp_extract(lower(prompt), '{_UTIL}', 1), '') AS DOUBLE) u, try_cast(nullif(regexp_extract(lower(prompt), '{_COUNT}', 1), '') AS INT) n FROM public_state_v1_sft) GROUP BY 1, 2""")
def branch_labels(spark, sf):
    """Stress by utilization, by the number of binding branches where that is missing, and congestion by that number."""
    found = lambda p, kind: F.nullif(F.regexp_extract(F.lower("prompt"), p, 1), F.lit("")).try_cast(kind)
    d = table(spark, sf, "public_state_v1_sft").select(found(_UTIL, "double").alias("u"), found(_COUNT, "int").alias("n"))
    stress = F.coalesce(N.step_label(F.col("u"), [(0.8, "LOW"), (0.95, "ELEVATED")], "HIGH"), N.step_label(F.col("n"), [(0, "LOW"), (2, "ELEVATED")], "HIGH", strict=False))
    return d.select(stress.alias("stress"), N.step_label(F.col("n"), [(0, "FREE")], "CONGESTED", strict=False).alias("congestion")).groupBy("stress", "congestion").agg(F.count("*").alias("n_rows"))


@query("SELECT coalesce(t.target_share, 0.0) AS target_share, d.source, count(*) AS n_rows, t.source IS NOT NULL AS found FROM documents d LEFT JOIN mix_targets t ON d.source = t.source GROUP BY ALL")
def default_shares(spark, sf):
    """Lookup with a default for what isn't listed."""
    t = table(spark, sf, "mix_targets").select("source", "target_share")
    return J.lookup(table(spark, sf, "documents").select("source"), t, ["source"], default={"target_share": 0.0}).groupBy("target_share", "source", "found").agg(F.count("*").alias("n_rows"))


@query("SELECT group_index, first_candidate FROM (SELECT group_index, min(candidate_row_id) AS first_candidate FROM t45_k4_free_candidates WHERE group_index IS NOT NULL GROUP BY 1) ORDER BY first_candidate LIMIT 64")
def first_entities(spark, sf):
    """The first row of each group, of the first 64 groups in the order of their first rows."""
    d = table(spark, sf, "t45_k4_free_candidates").where("group_index IS NOT NULL").groupBy("group_index").agg(F.min("candidate_row_id").alias("first_candidate"))
    return A.rank_by(d, [F.col("first_candidate")], 64, whole=True)


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def through_csv(spark, sf):
    """A table written as CSV where nothing was, and read back under a schema."""
    at = _folder(spark)
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_new(d, at, "csv", header=True)
    return files.read_csv(spark, [f"{at}/*.csv"], d.schema).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT props) AS n_props, round(sum(value), 6) AS total FROM events GROUP BY 1")
def through_jsonl(spark, sf):
    """A table written as JSON lines where nothing was, and read back under a schema."""
    at = _folder(spark)
    d = table(spark, sf, "events").select("event_type", "props", "value")
    files.write_new(d, at, "json")
    return files.read_jsonl(spark, at, d.schema).groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("props").alias("n_props"), F.round(F.sum("value"), 6).alias("total"))
