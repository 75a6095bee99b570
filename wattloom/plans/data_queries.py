"""Queries of the general data problems: instants (p3), attributes as known (p4), regular series (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.times import HOUR_US, hour_text
from wattloom.operators.asof import forecast_state, generator_state
from wattloom.operators.grid import gaps, hourly, regular_series
from wattloom.operators.instants import lmp_instants, load_instants
from wattloom.sources.tables import table


def _all_instants(spark: SparkSession, sf: str) -> DataFrame:
    lmp = lmp_instants(table(spark, sf, "lmp_hourly_hub")).withColumn("table_name", F.lit("lmp_hourly_hub"))
    load = load_instants(table(spark, sf, "hourlysysload"), table(spark, sf, "feed_clock")).withColumn("table_name", F.lit("hourlysysload"))
    return lmp.unionByName(load)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose time text denotes exactly one instant."""
    return _all_instants(spark, sf).where("status = 'exact'").select("table_name", "row_id", "utc_micros")


def p3_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with its instant, the path's choice where several are possible, or none."""
    return _all_instants(spark, sf).select("table_name", "row_id", "utc_micros", "n_instants", "status")


def p3_status(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per table and status."""
    return _all_instants(spark, sf).groupBy("table_name", "status").agg(F.count("*").alias("n_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Per decision the generator record and the forecast row known at its cutoff."""
    states = table(spark, sf, "public_energy_state")
    own = generator_state(states, table(spark, sf, "own_generator")).select("state_row_id", F.lit("own_generator").alias("attribute_table"), F.col("record_id").alias("attribute_row_id"))
    fc = forecast_state(states, table(spark, sf, "load_forecast")).select("state_row_id", F.lit("load_forecast").alias("attribute_table"), F.col("forecast_id").alias("attribute_row_id"))
    return own.unionByName(fc)


_P4_OWN = """SELECT state_row_id, record_id, own_lmp, utilization FROM (
 SELECT s.state_row_id, g.record_id, g.own_lmp, g.utilization, row_number() OVER (PARTITION BY s.state_row_id ORDER BY g.observation_timestamp DESC, g.availability_timestamp DESC, g.record_id DESC) k
 FROM public_energy_state s JOIN own_generator g ON s.generator_id = g.generator_id AND g.observation_timestamp <= s.decision_cutoff_utc AND g.availability_timestamp <= s.decision_cutoff_utc) WHERE k = 1"""
_P4_FC = """SELECT state_row_id, forecast_id, forecast_mw, vintage FROM (
 SELECT s.state_row_id, g.forecast_id, g.forecast_mw, g.vintage, row_number() OVER (PARTITION BY s.state_row_id ORDER BY g.published_datetime_utc DESC, g.forecast_id DESC) k
 FROM public_energy_state s JOIN load_forecast g ON s.control_area = g.control_area AND s.target_local_date = g.forecast_date AND s.target_he = g.forecast_hour AND s.region = g.region AND g.published_datetime_utc <= s.decision_cutoff_utc) WHERE k = 1"""


def p4_generator_state(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with the generator's attributes as known."""
    return generator_state(table(spark, sf, "public_energy_state"), table(spark, sf, "own_generator")).select("state_row_id", "record_id", "own_lmp", "utilization")


def p4_forecast_state(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with the load forecast as known."""
    return forecast_state(table(spark, sf, "public_energy_state"), table(spark, sf, "load_forecast")).select("state_row_id", "forecast_id", "forecast_mw", "vintage")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    d = load_instants(table(spark, sf, "hourlysysload"), table(spark, sf, "feed_clock"), ["load_mw", "load_source"])
    return d.where("status = 'exact'").select(F.col("load_source").alias("source"), "utc_micros", "load_mw")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Missing hours of every source's series."""
    series = regular_series(_readings(spark, sf))
    return series.where("how <> 'observed'").select(F.col("source").alias("load_source"), hour_text(F.col("hour").cast("bigint") * HOUR_US).alias("hour_utc"))


def p5_series(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly series: observed, filled or marked cells."""
    series = regular_series(_readings(spark, sf))
    return series.select(F.col("source").alias("load_source"), hour_text(F.col("hour").cast("bigint") * HOUR_US).alias("hour_utc"), "load_mw", "how")


def p5_missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Missing hours per source (original_missing_hour_count)."""
    return gaps(hourly(_readings(spark, sf))).groupBy(F.col("source").alias("load_source")).agg(F.count("*").alias("original_missing_hour_count"))


# The same reading of time texts as SQL, apart from the Arrow kernels: shapes by named groups, instants by trying all whole-hour offsets of a zone.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(AM|PM)?"
_ZONE = r"\s*(Z|UTC|GMT|[ECMP][SD]T|[+-]\d{2}:?\d{2})?$"
_SHAPES = {  # name -> pattern; groups: first, second, third part of the date, hour, minute, second, fraction, half of the day, zone
    "iso": rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_CLOCK}{_ZONE}",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d{{1,9}}))?(){_ZONE}",
    "slash": rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}}),? {_CLOCK}{_ZONE}",
    "month": rf"^(?:[A-Z]{{3,9}},? )?(\d{{1,2}})[- ]([A-Z]{{3}})[A-Z]*[- ,]+(\d{{4}}),? {_CLOCK}{_ZONE}",
}
_GROUPS = "['f', 'g', 'k', 'h', 'mi', 's', 'us', 'half', 'zone']"
_MONTH = "list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], x.g)"
_OFFSET = "CASE WHEN {z} IN ('Z', 'UTC', 'GMT') THEN 0 WHEN {z} = 'EST' THEN -300 WHEN {z} = 'EDT' THEN -240 WHEN {z} = 'CST' THEN -360 WHEN {z} = 'CDT' THEN -300 WHEN {z} = 'MST' THEN -420 WHEN {z} = 'MDT' THEN -360 WHEN {z} = 'PST' THEN -480 WHEN {z} = 'PDT' THEN -420 WHEN regexp_matches({z}, '^[+-]') THEN (CASE WHEN {z}[1] = '-' THEN -1 ELSE 1 END) * (try_cast({z}[2:3] AS INT) * 60 + try_cast(right({z}, 2) AS INT)) END"


def _wall(y: str, mo: str, d: str) -> str:
    """Microseconds of a wall time, null for no real date or time."""
    return f"epoch_us(try_cast(printf('%04d-%02d-%02d', {y}, {mo}, {d}) AS DATE)::TIMESTAMP) + ((CASE WHEN x.half = '' THEN hh WHEN x.half = 'PM' THEN hh % 12 + 12 ELSE hh % 12 END) * 3600 + try_cast(x.mi AS INT) * 60 + coalesce(try_cast(x.s AS INT), 0)) * 1000000::BIGINT + try_cast(rpad(x.us[1:6], 6, '0') AS BIGINT)"


def _instants(wall: str, zone: str) -> str:
    """All instants that show a wall time in a zone."""
    local = f"epoch_us(timezone({zone}, timezone('UTC', make_timestamp(u))))"
    fixed = _OFFSET.format(z=zone)
    return f"CASE WHEN {wall} IS NULL OR {zone} IS NULL THEN [] WHEN regexp_matches({zone}, '^[+-]') THEN [{wall} - ({fixed}) * 60000000::BIGINT] ELSE list_filter(list_transform(range(-14, 15), lambda k: {wall} + k * 3600000000), lambda u: {local} = {wall}) END"


def _parsed(rows: str, k: str) -> str:
    """CTE ``p`` with tag ``k``: rows with a text t as epoch e, wall times m (month first, or the only order) and d (day first), and offset minutes off."""
    shape = "CASE " + " ".join(f"WHEN regexp_matches(t, '{r}') THEN {{'n': '{n}', 'x': regexp_extract(t, '{r}', {_GROUPS})}}" for n, r in _SHAPES.items()) + " END"
    number = "CASE WHEN w.x.{0} = '' THEN NULL ELSE try_cast(w.x.{0} AS INT) END"
    first = "CASE WHEN n = 'month' THEN " + _wall("try_cast(x.k AS INT)", _MONTH, "try_cast(x.f AS INT)") + " WHEN n = 'slash' AND told THEN " + _wall("try_cast(x.k AS INT)", "try_cast(x.f AS INT)", "try_cast(x.g AS INT)") + " WHEN n <> 'slash' OR len(x.f) = 4 AND len(x.k) <= 2 THEN " + _wall("try_cast(x.f AS INT)", "try_cast(x.g AS INT)", "try_cast(x.k AS INT)") + " END"
    return rf"""q{k} AS ({rows}), w{k} AS (SELECT *, {shape} w FROM q{k}), v{k} AS (SELECT *, w.n n, w.x x, {number.format('h')} hh, w.n = 'slash' AND len(w.x.k) = 4 AND len(w.x.f) <= 2 AS told FROM w{k}),
 o{k} AS (SELECT *, coalesce(hh <= 23 AND try_cast(x.mi AS INT) <= 59 AND coalesce(try_cast(x.s AS INT), 0) <= 59 AND (x.half = '' OR hh BETWEEN 1 AND 12), false) AS fine, {_OFFSET.format(z='x.zone')} off,
  CASE WHEN w IS NULL AND regexp_matches(t, '^(\d{{10}}|\d{{13}}|\d{{16}})$') THEN try_cast(t AS BIGINT) * CASE len(t) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END END e FROM v{k}),
 p{k} AS (SELECT *, CASE WHEN fine THEN {first} END m, CASE WHEN fine AND told THEN {_wall('try_cast(x.k AS INT)', 'try_cast(x.g AS INT)', 'try_cast(x.f AS INT)')} END d FROM o{k})"""


_TEXT = r"upper(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_LOAD_P = _parsed(f"SELECT reading_id, load_source, load_mw, bare_zone, date_order, {_TEXT.format('timestamp_utc')} t FROM hourlysysload l LEFT JOIN feed_clock c ON l.feed_id = c.feed_id", "_load")
_LOAD = f"""{_LOAD_P}, r_load AS (SELECT reading_id, load_source, load_mw, e, off, bare_zone, CASE WHEN NOT (told AND coalesce(date_order, '') IN ('DMY', 'YMD')) THEN m END m, CASE WHEN coalesce(date_order, '') NOT IN ('MDY', 'YMD') THEN d END d FROM p_load),
 load AS (SELECT reading_id, load_source, load_mw, list_distinct(list_filter(CASE WHEN e IS NOT NULL THEN [e] WHEN off IS NOT NULL THEN [m - off * 60000000::BIGINT, d - off * 60000000::BIGINT] ELSE list_concat({_instants('m', 'bare_zone')}, {_instants('d', 'bare_zone')}) END, lambda u: u IS NOT NULL)) us FROM r_load)"""
_LMP_P = _parsed(f"SELECT lmp_row_id, try_cast(target_local_date AS DATE) tday, target_he he, {_TEXT.format('interval_start_utc')} t FROM lmp_hourly_hub", "_lmp")
_FITS = "timezone('America/New_York', timezone('UTC', make_timestamp(u)))::DATE = tday AND hour(timezone('America/New_York', timezone('UTC', make_timestamp(u)))) + 1 = he"
_LMP = f"""{_LMP_P}, r_lmp AS (SELECT *, tday IS NOT NULL AND he IS NOT NULL AS given, e IS NULL AND off IS NULL AS bare, e IS NOT NULL OR m IS NOT NULL OR d IS NOT NULL AS readable, coalesce(m <> d, false) AS two, CASE WHEN he BETWEEN 1 AND 24 THEN epoch_us(tday::TIMESTAMP) + (he - 1) * 3600000000 END AS began FROM p_lmp),
 lmp AS (SELECT lmp_row_id, CASE WHEN readable AND bare AND NOT given THEN [] WHEN NOT readable AND given THEN {_instants('began', "'America/New_York'")} WHEN NOT readable THEN []
  ELSE list_filter(list_distinct(list_filter(CASE WHEN e IS NOT NULL THEN [e] WHEN off IS NOT NULL THEN [m - off * 60000000::BIGINT, d - off * 60000000::BIGINT] ELSE list_concat([m, d], list_concat({_instants('m', "'America/New_York'")}, {_instants('d', "'America/New_York'")})) END, lambda u: u IS NOT NULL)), lambda u: NOT (given AND (bare OR two)) OR ({_FITS})) END us FROM r_lmp)"""
_EXACT = f"WITH {_LOAD}, {_LMP}"
_HOURS = f"WITH {_LOAD}, h AS (SELECT DISTINCT load_source, us[1] // 3600000000 AS hour FROM load WHERE len(us) = 1 AND load_source IS NOT NULL AND isfinite(load_mw) AND load_mw > 0), g AS (SELECT *, lead(hour) OVER (PARTITION BY load_source ORDER BY hour) AS next FROM h)"

QUERIES = {f.__name__: f for f in (p3_found, p3_normalised, p3_status, p4_found, p4_generator_state, p4_forecast_state, p5_found, p5_series, p5_missing_counts)}
SQL = {
    "p4_found": f"SELECT state_row_id, 'own_generator' AS attribute_table, record_id AS attribute_row_id FROM ({_P4_OWN}) UNION ALL SELECT state_row_id, 'load_forecast', forecast_id FROM ({_P4_FC})",
    "p3_found": f"{_EXACT} SELECT 'hourlysysload' AS table_name, reading_id AS row_id, us[1] AS utc_micros FROM load WHERE len(us) = 1 UNION ALL SELECT 'lmp_hourly_hub', lmp_row_id, us[1] FROM lmp WHERE len(us) = 1",
    "p5_found": f"{_HOURS} SELECT load_source, strftime(make_timestamp(u * 3600000000), '%Y-%m-%dT%H:00:00Z') AS hour_utc FROM (SELECT load_source, unnest(range(hour + 1, next)) u FROM g WHERE next > hour + 1)",
    "p5_missing_counts": f"{_HOURS} SELECT load_source, sum(next - hour - 1)::BIGINT AS original_missing_hour_count FROM g WHERE next > hour + 1 GROUP BY 1",
    "p4_generator_state": _P4_OWN,
    "p4_forecast_state": _P4_FC,
}
