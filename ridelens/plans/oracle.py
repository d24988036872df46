"""DuckDB oracle SQL, one statement per registered query.

Each statement starts from the driver's tables (views ``events``, ``orders``
...) and rebuilds the fixture views as CTEs, then states the operator's
semantics in plain SQL, independently of the Spark code: group statistics
as window aggregates, the unpivot as a key x hour product with a left join,
the scoring rules as a table of hour bands, conditions and values instead of
the closed form used in Spark.
"""

from __future__ import annotations

from ridelens import schemas
from ridelens.functions import constants as K
from ridelens.sources import fixtures as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STATION_CASE = "CASE {c} % 20 " + " ".join(f"WHEN {i} THEN {_q(s)}" for i, s in enumerate(V.FIXTURE_STATIONS)) + " END"
LINE_CASE = "CASE event_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.FIXTURE_LINES.items()) + " END"
HOLIDAY_VALUES = ", ".join(
    f"(DATE '{y}-{md}')" for y in V.FIXTURE_HOLIDAY_YEARS for md in V.FIXTURE_HOLIDAY_MONTH_DAYS
) + ", " + ", ".join(f"(DATE '{d}')" for d in V.FIXTURE_HOLIDAY_EXTRA)
CATEGORY_VALUES = ", ".join(
    f"({_q(s)}, {', '.join(str(x) for x in vals)})" for s, vals in K.STATION_CATEGORIES.items()
)

BASE = f"""
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(round(value * 20) AS BIGINT) AS n FROM events
), v_ridership AS (
  SELECT CAST(year(ts) * 100 + month(ts) AS INTEGER) AS use_month,
         CAST(ts AS DATE) AS use_date,
         {LINE_CASE} AS line,
         {STATION_CASE.format(c='user_id')} AS station,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST(sum(CASE WHEN event_id % 2 = 0 THEN n END) AS BIGINT) AS boardings,
         CAST(sum(CASE WHEN event_id % 2 = 1 THEN n END) AS BIGINT) AS alightings
  FROM ev GROUP BY ALL
), v_clean AS (
  SELECT use_month, use_date, line, station, hour,
         coalesce(boardings, 0) AS boardings, coalesce(alightings, 0) AS alightings,
         coalesce(boardings, 0) + coalesce(alightings, 0) AS total
  FROM v_ridership
), v_month AS (
  SELECT use_month, line, station, hour,
         CAST(sum(boardings) AS BIGINT) AS boardings, CAST(sum(alightings) AS BIGINT) AS alightings
  FROM v_clean GROUP BY ALL
), v_monthly AS (
  SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS use_month,
         CASE WHEN o_custkey % 20 % 4 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS line,
         {STATION_CASE.format(c='o_custkey')} AS station,
         CAST(o_orderkey % 24 AS INTEGER) AS hour,
         CAST(sum(CASE WHEN (o_orderkey // 24) % 2 = 0 THEN CAST(round(o_totalprice / 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS boardings,
         CAST(sum(CASE WHEN (o_orderkey // 24) % 2 = 1 THEN CAST(round(o_totalprice / 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS alightings,
         CAST(sum(CAST(round(o_totalprice / 100) AS BIGINT)) AS BIGINT) AS total
  FROM orders GROUP BY ALL
), v_daily_orders AS (
  SELECT CAST(o_orderdate AS DATE) AS use_date, count(*) AS n_orders FROM orders GROUP BY ALL
), v_holidays AS (
  SELECT * FROM (VALUES {HOLIDAY_VALUES}) t(date)
), cats AS (
  SELECT * FROM (VALUES {CATEGORY_VALUES}) t(station, cat_business, cat_commercial, cat_transfer,
                                              cat_university, cat_residential, cat_group)
)"""

ORACLE: dict[str, str] = {}

KEYS = "use_date, line, station, hour"
MKEYS = "use_month, line, station, hour"

PERIOD_CASE = (
    "CASE WHEN {h} BETWEEN 7 AND 9 THEN '출근시간' WHEN {h} BETWEEN 18 AND 20 THEN '퇴근시간' "
    "WHEN {h} BETWEEN 11 AND 13 THEN '점심시간' WHEN {h} >= 22 OR {h} <= 5 THEN '심야시간' ELSE '일반시간' END"
)
LABEL_CASE = (
    "CASE WHEN {t} < 500 THEN '여유' WHEN {t} < 1500 THEN '보통' WHEN {t} < 3000 THEN '혼잡' ELSE '매우혼잡' END"
)
LEVEL_CASE = "CAST(CASE WHEN {t} < 500 THEN 0 WHEN {t} < 1500 THEN 1 WHEN {t} < 3000 THEN 2 ELSE 3 END AS INTEGER)"


def q(name: str, sql: str) -> None:
    ORACLE[name] = BASE + sql


# --- phase 1 ----------------------------------------------------------------------
q("top_stations", """
SELECT station, round(avg(total), 6) AS mean_total FROM v_clean
GROUP BY station ORDER BY avg(total) DESC, station LIMIT 10""")

# --- phase 2 ----------------------------------------------------------------------
LONG = """, wkeys AS (SELECT DISTINCT use_month, line, station FROM v_month),
long AS (
  SELECT k.use_month, k.line, k.station, CAST(h.range AS INTEGER) AS hour,
         m.boardings, m.alightings, m.boardings + m.alightings AS total
  FROM wkeys k CROSS JOIN range(24) h
  LEFT JOIN v_month m ON m.use_month = k.use_month AND m.line = k.line AND m.station = k.station AND m.hour = h.range
)"""
q("wide_to_long", LONG + f"\nSELECT {MKEYS}, boardings, alightings, total FROM long")
q("long_from_two_inputs", LONG + f"\nSELECT {MKEYS}, boardings, alightings, total FROM long")
q("month_date", LONG + f"""
SELECT {MKEYS}, make_date(use_month // 100, use_month % 100, 1) AS use_date,
       CAST(use_month // 100 AS INTEGER) AS year, CAST(use_month % 100 AS INTEGER) AS month FROM long""")
q("period", f"\nSELECT {KEYS}, {PERIOD_CASE.format(h='hour')} AS period FROM v_clean")
q("congestion_level", f"""
SELECT {KEYS}, total, {LABEL_CASE.format(t='total')} AS congestion, {LEVEL_CASE.format(t='total')} AS level FROM v_clean""")
SIGN = "CASE WHEN day(use_date) % 5 = 0 AND hour % 4 = 0 THEN -1 ELSE 1 END"
# names are the clean ones: the blanks around them are trimmed
DIRTY = f""", v_dirty AS (
  SELECT use_month, use_date, line, station, hour, boardings * {SIGN} AS boardings, alightings * {SIGN} AS alightings, total * {SIGN} AS total FROM v_clean
)"""
q("normalize_names", DIRTY + "\nSELECT use_date, line, station, hour, total FROM v_dirty")
q("fill_missing", f"""
SELECT {KEYS}, coalesce(boardings, 0) AS boardings, coalesce(alightings, 0) AS alightings,
       coalesce(boardings + alightings, 0) AS total FROM v_ridership""")

CAP = """, qs AS (
  SELECT quantile_cont(boardings, [0.25, 0.75]) AS qb, quantile_cont(alightings, [0.25, 0.75]) AS qa,
         quantile_cont(total, [0.25, 0.75]) AS qt FROM {src}
), ub AS (
  SELECT qb[2] + 1.5 * (qb[2] - qb[1]) AS ub_b, qa[2] + 1.5 * (qa[2] - qa[1]) AS ub_a,
         qt[2] + 1.5 * (qt[2] - qt[1]) AS ub_t FROM qs
)"""


def _capped(c: str, u: str) -> str:
    clip = f"CASE WHEN {c} < 0 THEN 0.0 ELSE CAST({c} AS DOUBLE) END"
    return f"CASE WHEN {clip} > 2 * {u} THEN {u} ELSE {clip} END"


q("cap_outliers", DIRTY + CAP.format(src="v_dirty") + f"""
SELECT {KEYS}, {_capped('boardings', 'ub_b')} AS boardings, {_capped('alightings', 'ub_a')} AS alightings,
       {_capped('total', 'ub_t')} AS total FROM v_dirty, ub""")
q("outlier_counts", DIRTY + CAP.format(src="v_dirty") + """
SELECT 'boardings' AS column_name, round(ub_b, 6) AS upper_bound,
       (SELECT count(*) FROM v_dirty WHERE greatest(boardings, 0) > 2 * ub_b) AS outlier_count FROM ub
UNION ALL
SELECT 'alightings', round(ub_a, 6), (SELECT count(*) FROM v_dirty WHERE greatest(alightings, 0) > 2 * ub_a) FROM ub
UNION ALL
SELECT 'total', round(ub_t, 6), (SELECT count(*) FROM v_dirty WHERE greatest(total, 0) > 2 * ub_t) FROM ub""")

GROWTH = ", g AS (SELECT *, pow(2.0, CAST(total AS DOUBLE)) AS growth FROM v_clean)"
q("replace_inf", GROWTH + f"""
SELECT {KEYS}, total, CASE WHEN isinf(growth) THEN 0.0 ELSE growth END AS growth FROM g""")
q("inf_counts", GROWTH + """
SELECT 0 AS col_pos, 'boardings' AS column_name, count(*) FILTER (WHERE isinf(CAST(boardings AS DOUBLE))) AS inf_count FROM g
UNION ALL SELECT 1, 'alightings', count(*) FILTER (WHERE isinf(CAST(alightings AS DOUBLE))) FROM g
UNION ALL SELECT 2, 'total', count(*) FILTER (WHERE isinf(CAST(total AS DOUBLE))) FROM g
UNION ALL SELECT 3, 'growth', count(*) FILTER (WHERE isinf(growth)) FROM g""")

# --- phase 3 ----------------------------------------------------------------------
_WIDE_COLS = ["use_month", "line", "station"] + [
    c for h in range(24) for c in (schemas.boarding_column(h), schemas.alighting_column(h))
]
_WIDE_SELECT = ", ".join(
    f"max(CASE WHEN hour = {h} THEN {v} END) AS \"{name}\""
    for h in range(24)
    for v, name in (("boardings", schemas.boarding_column(h)), ("alightings", schemas.alighting_column(h)))
)
WIDE = f", v_wide AS (SELECT use_month, line, station, {_WIDE_SELECT} FROM v_month GROUP BY ALL)"
q("null_counts", WIDE + "\nSELECT col_pos, column_name, null_count FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS col_pos, {_q(c)} AS column_name, count(*) - count(\"{c}\") AS null_count FROM v_wide"
    for i, c in enumerate(_WIDE_COLS)
) + "\n) WHERE null_count > 0 ORDER BY col_pos")
q("duplicate_count", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM v_ridership GROUP BY use_month, line, station)""")
q("value_range", "\nSELECT min(use_month) AS min_value, max(use_month) AS max_value FROM v_monthly")
q("distinct_counts", """
SELECT count(DISTINCT line) AS n_line, count(DISTINCT station) AS n_station, count(DISTINCT hour) AS n_hour FROM v_clean""")
q("describe_total", """
SELECT count(total) AS count, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std,
       round(CAST(min(total) AS DOUBLE), 6) AS min, round(quantile_cont(total, 0.25), 6) AS p25,
       round(quantile_cont(total, 0.5), 6) AS p50, round(quantile_cont(total, 0.75), 6) AS p75,
       round(CAST(max(total) AS DOUBLE), 6) AS max FROM v_clean""")
q("level_counts", f"""
SELECT level, count(*) AS n FROM (SELECT {LEVEL_CASE.format(t='total')} AS level FROM v_clean)
WHERE level IS NOT NULL GROUP BY level ORDER BY level""")
q("period_ranking", f"""
SELECT period, round(avg(total), 6) AS mean_total
FROM (SELECT {PERIOD_CASE.format(h='hour')} AS period, total FROM v_clean)
GROUP BY period ORDER BY avg(total) DESC, period""")

# --- phase 4 ----------------------------------------------------------------------
q("group_means", f"""
SELECT {KEYS}, total,
       round(avg(total) OVER (PARTITION BY station), 6) AS station_avg,
       round(avg(total) OVER (PARTITION BY hour), 6) AS hour_avg,
       round(avg(total) OVER (PARTITION BY line), 6) AS line_avg FROM v_clean""")
q("station_extremes", f"""
SELECT {KEYS}, total, max(total) OVER (PARTITION BY station) AS station_max,
       min(total) OVER (PARTITION BY station) AS station_min FROM v_clean""")
q("rel_congestion", f"""
SELECT {KEYS}, round(total / (avg(total) OVER (PARTITION BY station) + 1), 6) AS rel_congestion FROM v_clean""")
q("transfer_by_name", f"""
SELECT {KEYS}, CAST(regexp_matches(line, '[-,]') AS INTEGER) AS is_transfer FROM v_clean""")
STATION_DIM = """, sdim AS (
  SELECT station, line, count(*) OVER (PARTITION BY station) > 1 AS is_transfer
  FROM (SELECT DISTINCT station, line FROM v_monthly)
)"""
q("station_dim", STATION_DIM + "\nSELECT station, line, is_transfer FROM sdim")
q("weekday_features", """
SELECT use_date, n_orders, CAST(isodow(use_date) - 1 AS INTEGER) AS dow, dayname(use_date) AS day_name,
       CAST(isodow(use_date) >= 6 AS INTEGER) AS is_weekend FROM v_daily_orders""")
q("month_third", """
SELECT use_date, CASE WHEN day(use_date) <= 10 THEN '초' WHEN day(use_date) <= 20 THEN '중' ELSE '말' END AS month_third
FROM v_daily_orders""")
q("quarter", "\nSELECT use_date, CAST(quarter(use_date) AS INTEGER) AS quarter FROM v_daily_orders")

MDATED = """, md AS (
  SELECT *, make_date(use_month // 100, use_month % 100, 1) AS use_date,
         CAST(use_month % 100 AS INTEGER) AS month FROM v_monthly
), mdw AS (SELECT *, CAST(isodow(use_date) - 1 AS INTEGER) AS dow FROM md)"""
q("cyclic", MDATED + f"""
SELECT {MKEYS},
  round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos,
  round(sin(2 * pi() * dow / 7), 6) AS dow_sin, round(cos(2 * pi() * dow / 7), 6) AS dow_cos,
  round(sin(2 * pi() * month / 12), 6) AS month_sin, round(cos(2 * pi() * month / 12), 6) AS month_cos
FROM mdw""")
q("holiday_flags", """
SELECT use_date,
  CAST(use_date IN (SELECT date FROM v_holidays) AS INTEGER) AS is_holiday,
  CAST(use_date + 1 IN (SELECT date FROM v_holidays) AS INTEGER) AS holiday_eve,
  CAST(use_date - 1 IN (SELECT date FROM v_holidays) AS INTEGER) AS holiday_next,
  CAST(use_date IN (SELECT date FROM v_holidays) OR isodow(use_date) >= 6 AS INTEGER) AS is_off_day
FROM v_daily_orders""")

# --- phase 5 ----------------------------------------------------------------------
W = "(PARTITION BY station, hour ORDER BY use_date, line"
q("lags", MDATED + f"""
SELECT {MKEYS}, total,
  CAST(coalesce(lag(total, 1) OVER {W}), 0) AS DOUBLE) AS lag_1,
  CAST(coalesce(lag(total, 7) OVER {W}), 0) AS DOUBLE) AS lag_7 FROM md""")
q("rolling", MDATED + f"""
SELECT {MKEYS}, total,
  round(coalesce(avg(total) OVER {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 6) AS ma_3,
  round(coalesce(avg(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS ma_7,
  round(coalesce(stddev_samp(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS std_7
FROM md""")
q("combos", MDATED + f"""
SELECT {MKEYS}, CAST(hour AS VARCHAR) || '_' || CAST(dow AS VARCHAR) AS hour_dow,
  CAST(hour AS VARCHAR) || '_' || CAST(CAST(dow >= 5 AS INTEGER) AS VARCHAR) AS hour_weekend,
  line || '_' || CAST(hour AS VARCHAR) AS line_hour FROM mdw""")
q("label_encode", MDATED + f"""
, lab AS (SELECT *, {PERIOD_CASE.format(h='hour')} AS period, {LABEL_CASE.format(t='total')} AS congestion,
                 CASE WHEN day(use_date) <= 10 THEN '초' WHEN day(use_date) <= 20 THEN '중' ELSE '말' END AS month_third
          FROM md)
SELECT {MKEYS},
  CAST(dense_rank() OVER (ORDER BY line) - 1 AS INTEGER) AS line_idx,
  CAST(dense_rank() OVER (ORDER BY station) - 1 AS INTEGER) AS station_idx,
  CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS period_idx,
  CAST(dense_rank() OVER (ORDER BY congestion) - 1 AS INTEGER) AS congestion_idx,
  CAST(dense_rank() OVER (ORDER BY month_third) - 1 AS INTEGER) AS month_third_idx
FROM lab""")

CAT_COLS = "cat_business, cat_commercial, cat_transfer, cat_university, cat_residential, cat_group"
CAT_COALESCE = ", ".join(f"CAST(coalesce(c.{x}, 0) AS INTEGER) AS {x}" for x in CAT_COLS.split(", "))
FLAGS = ("CAST(hour BETWEEN 7 AND 9 AS INTEGER) AS f_morning, CAST(hour BETWEEN 18 AND 20 AS INTEGER) AS f_evening_rush, "
         "CAST(hour BETWEEN 12 AND 13 AS INTEGER) AS f_lunch, CAST(hour BETWEEN 0 AND 5 AS INTEGER) AS f_late_night, "
         "CAST(hour BETWEEN 21 AND 23 AS INTEGER) AS f_night")
RUSH = ("CASE WHEN hour = 8 THEN 1.0 WHEN hour IN (7, 9) THEN 0.7 WHEN hour IN (18, 19) THEN 0.9 "
        "WHEN hour = 20 THEN 0.6 ELSE 0.0 END")
q("station_categories", f"""
SELECT v.use_date, v.line, v.station, v.hour, {CAT_COALESCE} FROM v_clean v LEFT JOIN cats c ON c.station = v.station""")
q("hour_flags", f"\nSELECT {KEYS}, {FLAGS} FROM v_clean")
q("rush_intensity", f"\nSELECT {KEYS}, CAST({RUSH} AS DOUBLE) AS rush_intensity FROM v_clean")
q("interactions", f"""
, b AS (
  SELECT v.use_date, v.line, v.station, v.hour, CAST(isodow(v.use_date) - 1 AS INTEGER) AS dow, {CAT_COALESCE},
         CAST({RUSH} AS DOUBLE) AS ri, CAST(v.hour BETWEEN 7 AND 9 AS INTEGER) AS fm,
         {PERIOD_CASE.format(h='v.hour')} AS period
  FROM v_clean v LEFT JOIN cats c ON c.station = v.station
), e AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY station) - 1 AS INTEGER) AS sidx,
         CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS pidx,
         CAST(dow >= 5 AS INTEGER) AS we FROM b
)
SELECT {KEYS}, pidx * 10 + dow AS time_dow, sidx * 10 + pidx AS station_time,
  round(cat_business * ri * 10, 6) AS business_rush, round(cat_transfer * ri * 10, 6) AS transfer_rush,
  cat_university * fm AS university_morning, cat_business * (1 - we) AS business_weekday,
  cat_commercial * we AS commercial_weekend, cat_group * 100 + pidx * 10 + dow AS group_time_dow,
  cat_transfer * fm * (1 - we) AS transfer_rush_weekday
FROM e""")

# the full feature chain over v_monthly, then the enhanced table
FEATURES = f"""
, p1 AS (
  SELECT use_month, trim(line) AS line, trim(station) AS station, hour, boardings, alightings, total,
         make_date(use_month // 100, use_month % 100, 1) AS use_date,
         CAST(use_month // 100 AS INTEGER) AS year, CAST(use_month % 100 AS INTEGER) AS month,
         {PERIOD_CASE.format(h='hour')} AS period, {LABEL_CASE.format(t='total')} AS congestion,
         {LEVEL_CASE.format(t='total')} AS level
  FROM v_monthly
){CAP.format(src='p1')}, p2 AS (
  SELECT use_month, line, station, hour, use_date, year, month, period, congestion, level,
         {_capped('boardings', 'ub_b')} AS boardings, {_capped('alightings', 'ub_a')} AS alightings,
         {_capped('total', 'ub_t')} AS total
  FROM p1, ub
), p3 AS (
  SELECT *, avg(total) OVER (PARTITION BY station) AS station_avg, avg(total) OVER (PARTITION BY hour) AS hour_avg,
         avg(total) OVER (PARTITION BY line) AS line_avg FROM p2
), f1 AS (
  SELECT *, CAST(isodow(use_date) - 1 AS INTEGER) AS dow, CAST(isodow(use_date) >= 6 AS INTEGER) AS is_weekend,
         CAST(quarter(use_date) AS INTEGER) AS quarter,
         CAST(use_date IN (SELECT date FROM v_holidays) AS INTEGER) AS is_holiday,
         CAST(use_date + 1 IN (SELECT date FROM v_holidays) AS INTEGER) AS holiday_eve,
         CAST(use_date - 1 IN (SELECT date FROM v_holidays) AS INTEGER) AS holiday_next
  FROM p3
), f2 AS (
  SELECT *, CAST(is_holiday = 1 OR is_weekend = 1 AS INTEGER) AS is_off_day,
    sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
    sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos,
    sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
    CAST(coalesce(lag(total, 1) OVER {W}), 0) AS DOUBLE) AS lag_1,
    CAST(coalesce(lag(total, 7) OVER {W}), 0) AS DOUBLE) AS lag_7,
    coalesce(avg(total) OVER {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS ma_3,
    coalesce(avg(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS ma_7,
    coalesce(stddev_samp(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS std_7,
    max(total) OVER (PARTITION BY station) AS station_max, min(total) OVER (PARTITION BY station) AS station_min,
    total / (station_avg + 1) AS rel_congestion,
    CAST(regexp_matches(line, '[-,]') AS INTEGER) AS is_transfer,
    CAST(dense_rank() OVER (ORDER BY line) - 1 AS INTEGER) AS line_idx,
    CAST(dense_rank() OVER (ORDER BY station) - 1 AS INTEGER) AS station_idx,
    CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS period_idx
  FROM f1
)"""
FEATURE_COLS = K.TRAINING_FEATURES + K.TRAINING_EXTRA
_DOUBLE_FEATURES = {"hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "station_avg",
                    "hour_avg", "line_avg", "station_max", "station_min", "rel_congestion", "lag_1", "lag_7",
                    "ma_3", "ma_7", "std_7", "boardings", "alightings", "total"}
q("feature_table", FEATURES + "\nSELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _DOUBLE_FEATURES else c for c in FEATURE_COLS
) + " FROM f2")

_LEAKS = set(K.TARGET_RELATED)
ENH_BASE_COLS = [c for c in FEATURE_COLS if c not in _LEAKS]
ENH_ADDED = (["cat_business", "cat_commercial", "cat_transfer", "cat_university", "cat_residential", "cat_group",
              "f_morning", "f_evening_rush", "f_lunch", "f_late_night", "f_night", "rush_intensity",
              "time_dow", "station_time", "business_rush", "transfer_rush", "university_morning",
              "business_weekday", "commercial_weekend", "group_time_dow", "transfer_rush_weekday"])
ENH_COLS = ENH_BASE_COLS + ENH_ADDED
ENHANCED = FEATURES + f"""
, e0 AS (
  SELECT f2.*, {CAT_COALESCE}, {FLAGS}, CAST({RUSH} AS DOUBLE) AS rush_intensity
  FROM f2 LEFT JOIN cats c ON c.station = f2.station
), enh AS (
  SELECT *, period_idx * 10 + dow AS time_dow, station_idx * 10 + period_idx AS station_time,
    cat_business * rush_intensity * 10 AS business_rush, cat_transfer * rush_intensity * 10 AS transfer_rush,
    cat_university * f_morning AS university_morning, cat_business * (1 - is_weekend) AS business_weekday,
    cat_commercial * is_weekend AS commercial_weekend, cat_group * 100 + period_idx * 10 + dow AS group_time_dow,
    cat_transfer * f_morning * (1 - is_weekend) AS transfer_rush_weekday
  FROM e0
)"""
q("flag_counts", ENHANCED + """
SELECT CAST(sum(f_morning) AS BIGINT) AS morning_rows, CAST(sum(f_evening_rush) AS BIGINT) AS evening_rows,
       count(*) FILTER (WHERE cat_transfer >= 2) AS transfer2_rows,
       count(*) FILTER (WHERE cat_business = 1) AS business_rows FROM enh""")
NZ_COLS = ["cat_business", "cat_commercial", "cat_transfer", "f_morning", "rush_intensity", "business_rush",
           "transfer_rush", "commercial_weekend", "lag_1", "std_7"]


def _nonzero_sql(cols, with_family=False) -> str:
    parts = []
    for i, c in enumerate(cols):
        cnt = f"count(*) FILTER (WHERE {c} <> 0 OR {c} IS NULL OR isnan(CAST({c} AS DOUBLE)))"
        if with_family:
            src = schemas.source_name(c)
            fam = "category" if "역_" in src else ("interaction" if "interaction" in src else "basic")
            marks = ["역_", "interaction", "시간대", "강도", "rush", "weekday", "weekend"]
            new = "true" if any(m in src for m in marks) else "false"
            parts.append(f"SELECT {_q(c)} AS column_name, {_q(src)} AS source_name, {_q(fam)} AS family, "
                         f"{new} AS is_new, {cnt} AS nonzero FROM enh")
        else:
            parts.append(f"SELECT {i} AS col_pos, {_q(c)} AS column_name, {cnt} AS nonzero FROM enh")
    return "\n" + "\nUNION ALL\n".join(parts)


q("nonzero_counts", ENHANCED + _nonzero_sql(NZ_COLS))
q("station_profile", ENHANCED + """
, s AS (SELECT * FROM enh WHERE station = '왕십리')
SELECT '왕십리' AS station, (SELECT count(*) FROM s) AS station_rows, (SELECT max(cat_transfer) FROM s) AS cat_transfer,
       (SELECT max(cat_group) FROM s) AS cat_group, level, count(*) AS n
FROM s GROUP BY level ORDER BY level""")
q("drop_target_leaks", ENHANCED + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS col_pos, {_q(c)} AS column_name, count({c}) AS non_null FROM enh" for i, c in enumerate(ENH_COLS)
))
FEATURE_ONLY = [c for c in ENH_COLS if c not in K.NON_FEATURE_COLUMNS]
q("feature_family", ENHANCED + _nonzero_sql(FEATURE_ONLY, with_family=True))

# --- phase 6 ----------------------------------------------------------------------
PEAK = """, ht AS (
  SELECT use_month, line, station, hour, CAST(coalesce(boardings, 0) AS DOUBLE) AS ride_on,
         CAST(coalesce(alightings, 0) AS DOUBLE) AS ride_off,
         CAST(coalesce(boardings, 0) AS DOUBLE) + CAST(coalesce(alightings, 0) AS DOUBLE) AS passengers_total
  FROM v_month
), hp AS (
  SELECT *, max(passengers_total) OVER (PARTITION BY station, line, use_month) AS pk FROM ht WHERE passengers_total > 0
), pk AS (
  SELECT use_month, line, station, hour, CAST(passengers_total AS BIGINT) AS passengers,
         CAST(ride_on AS BIGINT) AS ride_on, CAST(ride_off AS BIGINT) AS ride_off, CAST(pk AS BIGINT) AS max_passengers,
         round(passengers_total / pk * 100, 1) AS congestion_percent,
         CASE WHEN passengers_total / pk * 100 >= 90 THEN '매우혼잡' WHEN passengers_total / pk * 100 >= 70 THEN '혼잡'
              WHEN passengers_total / pk * 100 >= 40 THEN '보통' ELSE '여유' END AS peak_level,
         passengers_total = pk AS is_peak
  FROM hp
)"""
PEAK_SELECT = ("SELECT use_month, line, station, hour, passengers, ride_on, ride_off, max_passengers, "
               "congestion_percent, peak_level, is_peak FROM pk")
q("hourly_totals", PEAK + f"\nSELECT {MKEYS}, ride_on, ride_off, passengers_total FROM ht WHERE passengers_total > 0")
q("peak_congestion", PEAK + "\n" + PEAK_SELECT)
q("peak_at_hour", PEAK + "\n" + PEAK_SELECT + " WHERE hour = 8")
q("congestion_bar", PEAK + """
SELECT use_month, line, station, hour, congestion_percent,
       repeat('█', CAST(floor(congestion_percent / 5) AS INTEGER)) AS bar FROM pk""")

# --- phase 7 ----------------------------------------------------------------------
TRAIN_PERIOD_IDX = ("CASE WHEN {h} BETWEEN 7 AND 9 THEN 3 WHEN {h} BETWEEN 18 AND 20 THEN 4 "
                    "WHEN {h} BETWEEN 11 AND 13 THEN 2 WHEN {h} >= 22 OR {h} <= 5 THEN 0 ELSE 1 END")
# FIXED VALUES: the rule table. A row that applies lifts the base level to at least its value:
# hours from-to, p1 over, p1 + p2 over, p3 over, transfer grade from, business from, value
LIFTS = ", ".join(str(r) for r in [
    (7, 9, -1, -1, -1, 0, 0, 2), (18, 20, -1, -1, -1, 0, 0, 2), (12, 13, -1, -1, -1, 0, 0, 1),
    (7, 9, -1, -1, 0.02, 0, 0, 3), (18, 20, -1, -1, 0.02, 0, 0, 3),
    (7, 9, -1, -1, 0.01, 2, 0, 3), (18, 20, -1, -1, 0.01, 2, 0, 3), (7, 9, -1, -1, 0.015, 0, 1, 3),
    (21, 22, 0.03, -1, -1, 0, 0, 1), (10, 11, -1, 0.08, -1, 0, 0, 1), (14, 17, -1, 0.08, -1, 0, 0, 1)])
# hours from-to, weekday from, highest level
CAPS = "(0, 5, 0, 1), (23, 23, 5, 2)"
SCORE = f"""
, codes AS (
  SELECT station, line, min(sidx) AS station_idx, min(lidx) AS line_idx, min(tr) AS is_transfer FROM (
    SELECT station, line, CAST(dense_rank() OVER (ORDER BY station) - 1 AS INTEGER) AS sidx,
           CAST(dense_rank() OVER (ORDER BY line) - 1 AS INTEGER) AS lidx,
           CAST(regexp_matches(line, '[-,]') AS INTEGER) AS tr FROM v_clean) GROUP BY ALL
), reqs AS (
  SELECT p.station, p.line, CAST(h.range AS INTEGER) AS hour, CAST(d.range AS INTEGER) AS dow, 1 AS month,
         d.range = 0 AS is_holiday
  FROM (SELECT DISTINCT station, line FROM v_clean) p CROSS JOIN range(7) d CROSS JOIN range(24) h
), prob AS (
  SELECT station, hour, count(*) AS n,
    count(*) FILTER (WHERE lv = 0) AS n0, count(*) FILTER (WHERE lv = 1) AS n1,
    count(*) FILTER (WHERE lv = 2) AS n2, count(*) FILTER (WHERE lv = 3) AS n3
  FROM (SELECT station, hour, {LEVEL_CASE.format(t='total')} AS lv FROM v_clean) GROUP BY ALL
), pr AS (
  SELECT station, hour, (n0 + 0.26) / (n + 1.04) AS p0, (n1 + 0.26) / (n + 1.04) AS p1,
         (n2 + 0.26) / (n + 1.04) AS p2, (n3 + 0.26) / (n + 1.04) AS p3 FROM prob
), rf AS (
  SELECT r.*, coalesce(k.station_idx, 0) AS station_idx, coalesce(k.line_idx, 0) AS line_idx,
         coalesce(k.is_transfer, 0) AS is_transfer, {CAT_COALESCE},
         {TRAIN_PERIOD_IDX.format(h='r.hour')} AS period_idx,
         coalesce(pr.p0, 0.25) AS p0, coalesce(pr.p1, 0.25) AS p1, coalesce(pr.p2, 0.25) AS p2,
         coalesce(pr.p3, 0.25) AS p3
  FROM reqs r LEFT JOIN codes k ON k.station = r.station AND k.line = r.line
  LEFT JOIN cats c ON c.station = r.station
  LEFT JOIN pr ON pr.station = r.station AND pr.hour = r.hour
), s0 AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1
                 WHEN p2 >= p3 THEN 2 ELSE 3 END AS base_level FROM rf
), lifts AS (SELECT * FROM (VALUES {LIFTS}) t(h_from, h_to, p1_over, p12_over, p3_over, transfer_from, business_from, lift)
), caps AS (SELECT * FROM (VALUES {CAPS}) t(h_from, h_to, dow_from, cap)
), sc AS (
  SELECT *, CAST(least(
    greatest(base_level, coalesce((SELECT max(lift) FROM lifts WHERE hour BETWEEN h_from AND h_to AND p1 > p1_over AND p1 + p2 > p12_over
                                     AND p3 > p3_over AND cat_transfer >= transfer_from AND cat_business >= business_from), 0)),
    coalesce((SELECT min(cap) FROM caps WHERE hour BETWEEN h_from AND h_to AND dow >= dow_from), 3)) AS INTEGER) AS level
  FROM s0
)"""
REQ = "station, line, dow, hour"
q("validate_requests", """
, raw AS (
  SELECT p.station, p.line, CAST(d.range AS INTEGER) AS dow, CAST(h.range AS INTEGER) AS hour,
         CASE WHEN h.range = 5 THEN NULL ELSE CAST(h.range % 14 AS INTEGER) END AS month,
         CASE WHEN d.range = 3 THEN NULL ELSE d.range = 0 END AS is_holiday
  FROM (SELECT DISTINCT station, line FROM v_clean) p CROSS JOIN range(-1, 8) d CROSS JOIN range(0, 25) h
)
SELECT station, line, dow, hour, CAST(coalesce(month, 1) AS INTEGER) AS month, coalesce(is_holiday, false) AS is_holiday,
  CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour' WHEN dow NOT BETWEEN 0 AND 6 THEN 'day_of_week'
       WHEN month IS NOT NULL AND month NOT BETWEEN 1 AND 12 THEN 'month' END AS reject_reason
FROM raw""")
q("serving_period", f"""
SELECT {KEYS}, CAST(CASE WHEN hour <= 5 THEN 0 WHEN hour <= 8 THEN 1 WHEN hour <= 11 THEN 2 WHEN hour <= 13 THEN 3
                         WHEN hour <= 17 THEN 4 WHEN hour <= 20 THEN 5 ELSE 6 END AS INTEGER) AS serving_period
FROM v_clean""")
q("request_features", SCORE + f"""
SELECT {REQ}, period_idx, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter, CAST(dow >= 5 AS INTEGER) AS is_weekend,
  CAST(is_holiday AS INTEGER) AS is_holiday, CAST(dow >= 5 OR is_holiday AS INTEGER) AS is_off_day,
  station_idx, line_idx, is_transfer, cat_transfer, period_idx * 10 + dow AS time_dow,
  station_idx * 10 + period_idx AS station_time, cat_group * 100 + period_idx * 10 + dow AS group_time_dow,
  cat_transfer * CAST(hour BETWEEN 7 AND 9 AS INTEGER) * (1 - CAST(dow >= 5 AS INTEGER)) AS transfer_rush_weekday,
  round(sin(2 * pi() * dow / 7), 6) AS dow_sin, round(cos(2 * pi() * month / 12), 6) AS month_cos
FROM rf""")
q("base_level", SCORE + """
SELECT station, hour, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1
                          WHEN p2 >= p3 THEN 2 ELSE 3 END AS base_level FROM pr""")
q("adjust_level", SCORE + f"\nSELECT {REQ}, base_level, level FROM sc")
q("format_prediction", SCORE + f"""
SELECT {REQ}, level, ['여유', '보통', '혼잡', '매우혼잡'][level + 1] AS label,
  round(p0, 6) AS p_0, round(p1, 6) AS p_1, round(p2, 6) AS p_2, round(p3, 6) AS p_3,
  ['월요일', '화요일', '수요일', '목요일', '금요일', '토요일', '일요일'][dow + 1] AS day_name,
  dow >= 5 AS is_weekend_req FROM sc""")
q("recommendation", SCORE + f"""
SELECT {REQ}, level, CASE
  WHEN level = 0 THEN {_q(K.RECOMMEND_LEVEL0)} WHEN level = 1 THEN {_q(K.RECOMMEND_LEVEL1)}
  WHEN level = 2 AND hour IN (7, 8, 9, 18, 19, 20) THEN {_q(K.RECOMMEND_LEVEL2_RUSH)}
  WHEN level = 2 THEN {_q(K.RECOMMEND_LEVEL2_OTHER)}
  WHEN hour IN (7, 8, 9, 18, 19, 20) THEN {_q(K.RECOMMEND_LEVEL3_RUSH)}
  ELSE {_q(K.RECOMMEND_LEVEL3_OTHER)} END AS recommendation FROM sc""")
q("level_color", SCORE + f"""
SELECT {REQ}, level, ['#4CAF50', '#FFC107', '#FF9800', '#F44336'][level + 1] AS color FROM sc""")
ASKED = ", twice AS (SELECT k || '/' || station || '/' || line || '/' || dow AS request_id, sc.* FROM sc, (VALUES ('a'), ('b')) t(k))"
q("hourly_profile", SCORE + ASKED + """
SELECT request_id, station, line, dow, hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS time, level,
  ['여유', '보통', '혼잡', '매우혼잡'][level + 1] AS label, round([p0, p1, p2, p3][level + 1], 6) AS probability FROM twice""")
q("profile_summary", SCORE + ASKED + """
SELECT request_id, station, line, dow,
  coalesce(array_to_string(list_slice(list_sort(list(hour) FILTER (WHERE level >= 2)), 1, 5), ','), '') AS most_congested_hours,
  coalesce(array_to_string(list_slice(list_sort(list(hour) FILTER (WHERE level = 0)), 1, 5), ','), '') AS least_congested_hours,
  round(avg(level), 2) AS average_congestion
FROM twice GROUP BY request_id, station, line, dow""")
q("search_stations", STATION_DIM + """
, hit AS (SELECT * FROM sdim WHERE line = '2-HIGH' AND regexp_matches(station, '(?i)^[신사]'))
SELECT station, line, is_transfer, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY line, station LIMIT 100""")
q("no_lines", "\nSELECT * FROM (VALUES " + ", ".join(f"({_q(x)})" for x in K.DEFAULT_LINES) + ") t(line)")
q("head_rows", f"\nSELECT {KEYS}, total FROM v_clean ORDER BY {KEYS} LIMIT 5")
ORACLE["unparsable_payloads"] = "SELECT event_id FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0"
q("list_lines", STATION_DIM + "\nSELECT DISTINCT line FROM sdim ORDER BY line")
q("suggest", STATION_DIM + """
SELECT DISTINCT station, line FROM sdim WHERE contains(station, '입구') ORDER BY station, line LIMIT 15""")

# --- phase 6b: payloads, holidays, files --------------------------------------------
PJ = f""", pj AS (
  SELECT event_id, n, user_id, ts, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%Y%m') AS ym,
         CAST(hour(ts) AS INTEGER) AS h, {LINE_CASE} AS line, {STATION_CASE.format(c='user_id')} AS station,
         event_id % 7 = 0 AS err
  FROM ev
)"""
q("flatten_ridership", PJ + """
, ok AS (SELECT * FROM pj WHERE NOT err AND (event_id % 11 = 0 OR event_id % 13 <> 0))
SELECT event_id, 0 AS row_no, d AS use_dt, line, station, n AS ride, user_id AS alight, d AS work_dt FROM ok
UNION ALL
SELECT event_id, 1, d, line, station, n + 1, user_id + 1, d FROM ok WHERE event_id % 3 = 0""")
_ARR = """SELECT event_id, {no} AS item_no, CAST(1001 + event_id % 9 AS VARCHAR) AS line, station,
  CASE WHEN (event_id % 2 = 0) = {first} THEN '상행' ELSE '하행' END AS updnLine,
  line || ' 방면' AS trainLineNm, CAST(n + {no} AS VARCHAR) || '분 후' AS arvlMsg2,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE station END AS arvlMsg3,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE '일반' END AS btrainSttus,
  CAST(event_id % 6 AS VARCHAR) AS arvlCd FROM ok"""
q("flatten_arrivals", PJ + """
, ok AS (SELECT * FROM pj WHERE NOT err AND event_id % 13 <> 0)
""" + _ARR.format(no=0, first="true") + "\nUNION ALL\n" + _ARR.format(no=1, first="false") + " WHERE event_id % 3 = 0")
_FC = """SELECT event_id, {no} AS item_no, d AS baseDate, '0500' AS baseTime, '{cat}' AS category, d AS fcstDate,
  lpad(CAST(h AS VARCHAR), 2, '0') || '00' AS fcstTime, CAST({val} AS VARCHAR) AS fcstValue,
  CAST(60 AS BIGINT) AS nx, CAST(127 AS BIGINT) AS ny FROM ok"""
q("flatten_forecast", PJ + """
, ok AS (SELECT * FROM pj WHERE NOT err AND event_id % 11 <> 0)
""" + _FC.format(no=0, cat="TMP", val="n % 40") + "\nUNION ALL\n" + _FC.format(no=1, cat="POP", val="user_id % 100"))
HOURLY = PJ + """
, hr AS (
  SELECT event_id, ym AS use_month_text, line, station, CAST(hh.range AS INTEGER) AS hour,
    CAST(CASE WHEN (event_id + hh.range) % 11 <> 0 THEN (n * (hh.range + 1) + event_id) % 500 ELSE 0 END AS DOUBLE) AS ride_on,
    CAST(CASE WHEN (event_id + hh.range) % 11 <> 0 THEN (user_id * (hh.range + 3) + n) % 400 ELSE 0 END AS DOUBLE) AS ride_off
  FROM pj CROSS JOIN range(24) hh WHERE NOT err AND event_id % 13 <> 0
)"""
q("flatten_hourly", HOURLY + "\nSELECT * FROM hr")
q("payload_peak", HOURLY + """
, t AS (SELECT event_id, hour, ride_on + ride_off AS tot FROM hr WHERE ride_on + ride_off > 0),
p AS (SELECT *, max(tot) OVER (PARTITION BY event_id) AS pk FROM t)
SELECT event_id, hour, CAST(tot AS BIGINT) AS passengers, CAST(pk AS BIGINT) AS max_passengers,
  round(tot / pk * 100, 1) AS congestion_percent,
  CASE WHEN tot / pk * 100 >= 90 THEN '매우혼잡' WHEN tot / pk * 100 >= 70 THEN '혼잡'
       WHEN tot / pk * 100 >= 40 THEN '보통' ELSE '여유' END AS peak_level,
  tot = pk AS is_peak FROM p""")
_CH = ", ".join(f"({_q(dd)}, {_q(nm)})" for dd, nm in K.COLLECTOR_HOLIDAYS_2025)
q("holiday_dim", f"""
, hd AS (SELECT * FROM (VALUES {_CH}) t(date, holiday_name)),
days AS (SELECT strftime(use_date, '%m%d') AS mmdd, count(*) AS n_rows FROM v_clean GROUP BY ALL)
SELECT hd.date, 1 AS is_holiday, hd.holiday_name, strptime(hd.date, '%Y%m%d')::DATE AS holiday_date,
       CAST(coalesce(days.n_rows, 0) AS BIGINT) AS n_rows
FROM hd LEFT JOIN days ON days.mmdd = substr(hd.date, 5, 4)""")
_HOL = ", ".join(f"(DATE '{x}')" for x in K.HOLIDAYS)
q("is_holiday", f"""
, cal AS (SELECT * FROM (VALUES {_HOL}) t(date))
SELECT DISTINCT use_date, use_date IN (SELECT date FROM cal) AS is_holiday FROM v_clean""")
q("csv_roundtrip", LONG + f"\nSELECT {MKEYS}, boardings, alightings, total FROM long")
q("stage_roundtrip", f"""
SELECT {KEYS}, use_month, total, {LABEL_CASE.format(t='total')} AS congestion, {LEVEL_CASE.format(t='total')} AS level
FROM v_clean""")
q("schema_report", """
, c AS (SELECT count(use_month) AS c0, count(use_date) AS c1, count(line) AS c2, count(station) AS c3,
               count(hour) AS c4, count(boardings) AS c5, count(alightings) AS c6 FROM v_ridership)
SELECT t.col_pos, t.column_name, t.data_type, [c0, c1, c2, c3, c4, c5, c6][t.col_pos + 1] AS non_null
FROM (VALUES (0, 'use_month', 'int'), (1, 'use_date', 'date'), (2, 'line', 'string'), (3, 'station', 'string'),
             (4, 'hour', 'int'), (5, 'boardings', 'bigint'), (6, 'alightings', 'bigint')) t(col_pos, column_name, data_type),
     c""")

_ENH_DOUBLE = _DOUBLE_FEATURES | {"rush_intensity", "business_rush", "transfer_rush"}
q("enhanced_table", ENHANCED + "\nSELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _ENH_DOUBLE else c for c in ENH_COLS) + " FROM enh")

# --- phase 8 ----------------------------------------------------------------------
LV = f", lv AS (SELECT {KEYS}, total, {LEVEL_CASE.format(t='total')} AS level FROM v_clean)"
q("stratified_split", LV + f"""
SELECT {KEYS}, level,
  row_number() OVER (PARTITION BY level ORDER BY {KEYS}) <= round(0.2 * count(*) OVER (PARTITION BY level)) AS is_test
FROM lv""")
q("balance_classes", LV + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {KEYS}) AS rn FROM lv)
SELECT {KEYS}, level FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM lv GROUP BY level))""")
VP = f""", vp AS (
  SELECT {KEYS}, {LEVEL_CASE.format(t='total')} AS label,
         {LEVEL_CASE.format(t='avg(total) OVER (PARTITION BY hour)')} AS prediction FROM v_clean
)"""
q("accuracy", VP + "\nSELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM vp")
q("confusion", VP + "\nSELECT label, " + ", ".join(
    f"count(*) FILTER (WHERE prediction = {k}) AS n_{k}" for k in range(4)) + ", " + ", ".join(
    f"round(count(*) FILTER (WHERE prediction = {k}) / count(*) * 100, 6) AS pct_{k}" for k in range(4)
) + " FROM vp GROUP BY label")
REPORT = VP + """
, cells AS (SELECT label AS t, prediction AS p, count(*) AS c FROM vp GROUP BY ALL),
ks AS (SELECT t AS k FROM cells UNION SELECT p FROM cells),
per AS (
  SELECT k, coalesce((SELECT sum(c) FROM cells WHERE t = k AND p = k), 0) AS tp,
         coalesce((SELECT sum(c) FROM cells WHERE t = k), 0) AS support,
         coalesce((SELECT sum(c) FROM cells WHERE p = k), 0) AS npred FROM ks
), m AS (
  SELECT k, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS prec,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec, support FROM per
), f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)"""
q("class_report", REPORT + """
SELECT CAST(k AS VARCHAR) AS row_label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL
SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM vp), 6),
       CAST((SELECT sum(support) FROM f) AS BIGINT)
UNION ALL
SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
q("weighted_f1", REPORT + "\nSELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
q("overfit_report", VP + f"""
, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEYS})
                  <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM vp),
a AS (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT is_test) AS tr,
             avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_test) AS te FROM s)
SELECT round(tr, 6) AS train_accuracy, round(te, 6) AS test_accuracy, round(tr - te, 6) AS gap,
       CASE WHEN tr - te < 0.05 THEN 'none' WHEN tr - te < 0.10 THEN 'slight' ELSE 'severe' END AS verdict FROM a""")

def _hash(keys: str, seed: int = 42) -> str:
    parts = ", ".join(f"coalesce(CAST({k.strip()} AS VARCHAR), 'null')" for k in keys.split(","))
    return f"substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15)"


q("sample_rows", LV + f"\nSELECT {KEYS}, level FROM lv ORDER BY {_hash(KEYS)}, {KEYS} LIMIT 1000")
q("hash_split", LV + f"""
SELECT {KEYS}, level, row_number() OVER (PARTITION BY level ORDER BY {_hash(KEYS)}, {KEYS})
                      <= round(0.2 * count(*) OVER (PARTITION BY level)) AS is_test FROM lv""")
SPLIT = ENHANCED + f""", sp AS (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY {_hash(KEYS)}, {KEYS}) <= round(0.2 * count(*) OVER (PARTITION BY level)) AS is_test
  FROM enh
)"""
q("rf_predict_checks", SPLIT + f"\nSELECT {KEYS}, level, 1.0::DOUBLE AS prob_sum, true AS is_argmax, true AS nodes_agree FROM sp WHERE is_test")
_FAMILY = [(c, schemas.source_name(c)) for c in FEATURE_ONLY]
q("rf_importance_checks", "\n" + "\nUNION ALL\n".join(
    f"SELECT {_q(c)} AS feature, {_q(n)} AS source_name, "
    f"{_q('category' if '역_' in n else 'interaction' if 'interaction' in n else 'basic')} AS family, true AS in_range, 1.0::DOUBLE AS total, true AS nodes_agree"
    for c, n in _FAMILY))
q("rf_time_importance_checks", "\n" + "\nUNION ALL\n".join(
    f"SELECT {_q(c)} AS feature, true AS in_range, true AS nodes_agree" for c in FEATURE_ONLY if c in ("hour", "hour_sin", "hour_cos", "dow", "is_weekend")))
q("rf_overfit_checks", SPLIT + """
SELECT count(*) FILTER (WHERE NOT is_test) AS train_rows, count(*) FILTER (WHERE is_test) AS test_rows, true AS gap_fits,
       true AS verdict_fits, true AS beats_majority FROM sp""")
q("rf_min_split_checks", '''
SELECT CAST(100 AS BIGINT) AS trees, true AS splits_fit, true AS leaves_fit, CAST(100 AS BIGINT) AS roots, true AS "binary"''')
q("learning_curve_checks", SPLIT + f"""
, tr AS (SELECT * FROM sp WHERE NOT is_test ORDER BY {_hash(KEYS)}, {KEYS} LIMIT 100000),
fo AS (SELECT (row_number() OVER (PARTITION BY level ORDER BY {_hash(KEYS)}, {KEYS}) - 1) % 3 AS f FROM tr),
pools AS (SELECT min((SELECT count(*) FROM fo) - n) AS n_max FROM (SELECT f, count(*) AS n FROM fo GROUP BY f))
SELECT DISTINCT CAST(greatest(1, n_max * i // 10) AS BIGINT) AS train_size, true AS scores_fit FROM pools, range(1, 11) r(i)""")
q("model_info_checks", f"""
SELECT 'RandomForestClassifier' AS model_type, '2024-01-01 00:00:00' AS train_date, {len(FEATURE_ONLY)} AS feature_count,
       {_q(",".join(FEATURE_ONLY[:10]))} AS features, 'station categories and interaction features' AS note,
       true AS metrics_fit, true AS trained""")
q("rf_hourly_profile_checks", FEATURES + """
, k AS (SELECT DISTINCT station, line, station_idx, line_idx, is_transfer FROM f2)
SELECT station, line, CAST(d.range AS INTEGER) AS dow, CAST(h.range AS INTEGER) AS hour, station_idx, line_idx, is_transfer,
       1.0::DOUBLE AS prob_sum, true AS is_argmax, true AS level_fits
FROM k CROSS JOIN range(7) d CROSS JOIN range(24) h""")

# --- phase 9 ----------------------------------------------------------------------
ORACLE["arrivals_stream"] = ORACLE["flatten_arrivals"]

_SERVING = ("CASE WHEN hour <= 5 THEN 0 WHEN hour <= 8 THEN 1 WHEN hour <= 11 THEN 2 WHEN hour <= 13 THEN 3 "
            "WHEN hour <= 17 THEN 4 WHEN hour <= 20 THEN 5 ELSE 6 END")
q("request_features_serving", SCORE + f"""
, sv AS (SELECT *, CAST({_SERVING} AS INTEGER) AS sp FROM rf)
SELECT {REQ}, sp AS period_idx, sp * 10 + dow AS time_dow, station_idx * 10 + sp AS station_time,
       cat_group * 100 + sp * 10 + dow AS group_time_dow FROM sv""")
ORACLE["payload_peak_stream"] = ORACLE["payload_peak"]

# --- strict mode and month by month ---------------------------------------------------
q("drop_target_leaks_strict", ENHANCED + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS col_pos, {_q(c)} AS column_name, count({c}) AS non_null FROM enh"
    for i, c in enumerate(c for c in ENH_COLS if c not in K.TARGET_RELATED_STRICT_EXTRA)))
q("monthly_history", MDATED + f"""
SELECT {MKEYS}, total,
  CAST(coalesce(lag(total, 1) OVER {W}), 0) AS DOUBLE) AS lag_1,
  CAST(coalesce(lag(total, 7) OVER {W}), 0) AS DOUBLE) AS lag_7,
  round(coalesce(avg(total) OVER {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 6) AS ma_3,
  round(coalesce(avg(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS ma_7,
  round(coalesce(stddev_samp(total) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS std_7
FROM md""")
q("monthly_stats", "\n" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, round(avg(total), 6) AS mean_total, max(total) AS max_total, "
    f"min(total) AS min_total, count(*) AS n_rows FROM v_monthly GROUP BY {k}" for k in ("station", "hour", "line")))
q("monthly_means", f"""
SELECT {MKEYS}, round(avg(total) OVER (PARTITION BY station), 6) AS station_avg, round(avg(total) OVER (PARTITION BY hour), 6) AS hour_avg,
       round(avg(total) OVER (PARTITION BY line), 6) AS line_avg, max(total) OVER (PARTITION BY station) AS station_max,
       min(total) OVER (PARTITION BY station) AS station_min FROM v_monthly""")
q("monthly_codes", """
, mm AS (SELECT use_month, greatest(0, row_number() OVER (ORDER BY use_month) - (count(*) OVER () - 3)) AS batch FROM (SELECT DISTINCT use_month FROM v_monthly)),
vals AS (
  SELECT 'line' AS column_name, line AS value, min(batch) AS batch FROM v_monthly JOIN mm USING (use_month) GROUP BY line
  UNION ALL SELECT 'station', station, min(batch) FROM v_monthly JOIN mm USING (use_month) GROUP BY station)
SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY batch, value) - 1 AS INTEGER) AS code FROM vals""")
q("monthly_distinct", """
SELECT count(DISTINCT line) AS n_line, count(DISTINCT station) AS n_station, count(DISTINCT hour) AS n_hour FROM v_monthly""")
ORACLE["duplicate_bits"] = ORACLE["duplicate_count"]
ORACLE["payload_outcomes"] = """
WITH o AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'no json' WHEN event_id % 23 = 0 THEN 'no object' WHEN event_id % 19 = 0 THEN 'missing'
                                 WHEN event_id % 7 = 0 THEN 'refused' ELSE 'rows' END AS outcome FROM events)
SELECT event_id, outcome, CAST(CASE WHEN outcome <> 'rows' OR event_id % 13 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_items FROM o"""
