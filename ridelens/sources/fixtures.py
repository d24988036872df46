"""Fixture views over the driver's tables (see FIXTURES.md section 2).

The driver ships TPC-H-like tables plus an ``events`` stream table; these
functions turn them into the ridership shapes the operators work on. Every
view is a lazy DataFrame over the parquet files, so its work grows with the
tables. Station and line names below are the fixture's own mapping rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens import schemas

# fixture mapping: user_id % 20 -> station, event_type -> line
FIXTURE_STATIONS = [
    "강남", "역삼", "선릉", "여의도", "종각", "홍대입구", "신촌", "명동", "신림", "건대입구",
    "왕십리", "신도림", "사당", "잠실", "노원", "까치산", "가상1", "가상2", "가상3", "가상4",
]
FIXTURE_LINES = {
    "click": "1호선",
    "view": "2호선",
    "purchase": "3호선",
    "signup": "경의-중앙선",
    "error": "9호선",
}
FIXTURE_HOLIDAY_MONTH_DAYS = ["01-01", "03-01", "05-05", "06-06", "08-15", "10-03", "10-09", "12-25"]
FIXTURE_HOLIDAY_YEARS = range(1995, 2002)
FIXTURE_HOLIDAY_EXTRA = ["2024-01-01"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(keys_to_values: dict, key: Column) -> Column:
    expr = None
    for k, v in keys_to_values.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def station_of(user_id: Column) -> Column:
    return _lookup(dict(enumerate(FIXTURE_STATIONS)), user_id % 20)


def line_of(event_type: Column) -> Column:
    return _lookup(FIXTURE_LINES, event_type)


def event_count(value: Column) -> Column:
    return F.round(value * 20).cast("bigint")


def v_ridership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(use_month, use_date, line, station, hour) with nullable boardings / alightings."""
    ev = read_table(spark, sf_dir, "events")
    n = event_count(F.col("value"))
    return (
        ev.select(
            (F.year("ts") * 100 + F.month("ts")).cast("int").alias("use_month"),
            F.to_date("ts").alias("use_date"),
            line_of(F.col("event_type")).alias("line"),
            station_of(F.col("user_id")).alias("station"),
            F.hour("ts").cast("int").alias("hour"),
            F.when(F.col("event_id") % 2 == 0, n).alias("b"),
            F.when(F.col("event_id") % 2 == 1, n).alias("a"),
        )
        .groupBy("use_month", "use_date", "line", "station", "hour")
        .agg(F.sum("b").alias("boardings"), F.sum("a").alias("alightings"))
    )


def v_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_ridership with nulls as 0 and total = boardings + alightings."""
    r = v_ridership(spark, sf_dir)
    return r.select(
        "use_month", "use_date", "line", "station", "hour",
        F.coalesce("boardings", F.lit(0)).alias("boardings"),
        F.coalesce("alightings", F.lit(0)).alias("alightings"),
    ).withColumn("total", F.col("boardings") + F.col("alightings"))


def v_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        v_clean(spark, sf_dir)
        .groupBy("use_month", "line", "station", "hour")
        .agg(F.sum("boardings").alias("boardings"), F.sum("alightings").alias("alightings"))
    )


def v_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_month pivoted to the 48 hour-slot columns of the source CSV layout
    (conditional aggregation: one pass, no distinct-values job)."""
    m = v_month(spark, sf_dir)
    aggs = []
    for h in range(24):
        aggs.append(F.max(F.when(F.col("hour") == h, F.col("boardings"))).alias(schemas.boarding_column(h)))
        aggs.append(F.max(F.when(F.col("hour") == h, F.col("alightings"))).alias(schemas.alighting_column(h)))
    return m.groupBy("use_month", "line", "station").agg(*aggs)


def v_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly history from ``orders`` (80 months): the input of the lag /
    rolling / feature chain. boardings are orders with an even
    o_orderkey div 24, alightings the others. Every fourth station has one
    line only."""
    o = read_table(spark, sf_dir, "orders")
    n = F.round(F.col("o_totalprice") / 100).cast("bigint")
    even = (F.floor(F.col("o_orderkey") / 24) % 2) == 0
    return (
        o.select(
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("use_month"),
            F.when(F.col("o_custkey") % 20 % 4 == 0, F.lit("2-HIGH")).otherwise(F.col("o_orderpriority")).alias("line"),
            station_of(F.col("o_custkey")).alias("station"),
            (F.col("o_orderkey") % 24).cast("int").alias("hour"),
            F.when(even, n).otherwise(F.lit(0)).alias("b"),
            F.when(~even, n).otherwise(F.lit(0)).alias("a"),
        )
        .groupBy("use_month", "line", "station", "hour")
        .agg(F.sum("b").alias("boardings"), F.sum("a").alias("alightings"))
        .withColumn("total", F.col("boardings") + F.col("alightings"))
    )


def v_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("use_date")).agg(F.count(F.lit(1)).alias("n_orders"))


def fixture_holiday_dates() -> list[str]:
    """The fixture calendar as ISO dates (a literal list: its size is known)."""
    dates = [f"{y}-{md}" for y in FIXTURE_HOLIDAY_YEARS for md in FIXTURE_HOLIDAY_MONTH_DAYS]
    return dates + FIXTURE_HOLIDAY_EXTRA


def v_holidays(spark: SparkSession) -> DataFrame:
    dates = fixture_holiday_dates()
    from ridelens.sources.dims import literal_table
    from pyspark.sql import types as T

    t = literal_table(spark, [(d,) for d in dates], T.StructType([T.StructField("d", T.StringType())]))
    return t.select(F.to_date("d").alias("date"))


def v_requests(spark: SparkSession, sf_dir: str, clean: DataFrame | None = None) -> DataFrame:
    """Scoring requests: every distinct (station, line) x dow 0-6 x hour 0-23,
    month 1, holiday on Mondays. Generated by explode, not by a join."""
    clean = v_clean(spark, sf_dir) if clean is None else clean
    pairs = clean.select("station", "line").distinct()
    return (
        pairs.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .withColumn("month", F.lit(1))
        .withColumn("is_holiday", F.col("dow") == 0)
        .select("station", "line", "hour", "dow", "month", "is_holiday")
    )


PROB_SMOOTH_K = 0.26
PROB_SMOOTH_N = 1.04


def v_prob(spark: SparkSession, sf_dir: str, clean: DataFrame | None = None) -> DataFrame:
    """Empirical class probabilities per (station, hour), smoothed so that
    every class has a non-zero share: probs = [p0, p1, p2, p3]."""
    from ridelens.functions.exprs import level_of_total

    clean = v_clean(spark, sf_dir) if clean is None else clean
    c = clean.withColumn("level", level_of_total("total"))
    agg = c.groupBy("station", "hour").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col("level") == k, 1)).alias(f"n{k}") for k in range(4)],
    )
    probs = [
        ((F.col(f"n{k}").cast("double") + PROB_SMOOTH_K) / (F.col("n").cast("double") + PROB_SMOOTH_N))
        for k in range(4)
    ]
    return agg.select("station", "hour", F.array(*probs).alias("probs"))


def v_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_clean with blanks around names and, every fifth day, negative counts."""
    c = v_clean(spark, sf_dir)
    fifth = F.dayofmonth("use_date") % 5 == 0
    sign = F.when(fifth & (F.col("hour") % 4 == 0), -1).otherwise(1)
    return c.withColumns({
        "line": F.when(fifth, F.concat(F.lit(" "), "line", F.lit("\t"))).otherwise(F.col("line")),
        "station": F.when(F.col("hour") % 3 == 0, F.concat(F.lit("\u3000"), "station", F.lit("  "))).otherwise(F.col("station")),
        "boardings": F.col("boardings") * sign, "alightings": F.col("alightings") * sign, "total": F.col("total") * sign})


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictions: label = level of total, prediction = level
    of that hour's mean total."""
    from ridelens.functions.exprs import level_of_total
    from ridelens.operators.stats import with_group_means

    c = with_group_means(v_clean(spark, sf_dir), which=("hour",))
    return c.select(
        "use_date", "line", "station", "hour",
        level_of_total("total").alias("label"),
        level_of_total("hour_avg").alias("prediction"),
    )


# --- landed payload texts (FIXTURES.md v_json) ------------------------------------
def _js(c) -> Column:
    """A JSON string literal from a column (the fixture values need no escaping)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def _kv(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), value)


def _obj(*parts: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def v_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with four payload texts built by string
    concatenation: ~1 in 7 carries an error code, ~1 in 11 misses a key,
    ~1 in 13 has an empty list, ~1 in 3 has two items."""
    return payload_texts(read_table(spark, sf_dir, "events"))


def payload_texts(ev: DataFrame) -> DataFrame:
    """The payload texts for any events DataFrame (batch or streaming)."""
    e = F.col("event_id")
    n = event_count(F.col("value")).cast("string")
    n1 = (event_count(F.col("value")) + 1).cast("string")
    uid = F.col("user_id").cast("string")
    uid1 = (F.col("user_id") + 1).cast("string")
    st = station_of(F.col("user_id"))
    ln = line_of(F.col("event_type"))
    d = F.date_format("ts", "yyyyMMdd")
    ym = F.date_format("ts", "yyyyMM")
    hh = F.lpad(F.hour("ts").cast("string"), 2, "0")
    err = (e % 7) == 0
    two = (e % 3) == 0

    # daily ridership
    # the counts occur as numbers, numbers with a point and quoted numbers
    ride = F.when((e % 5) == 0, F.concat(n, F.lit(".0"))).when((e % 5) == 1, _js(n)).otherwise(n)

    def rrow(ride, alight):
        return _obj(_kv("USE_DT", _js(d)), _kv("LINE_NUM", _js(ln)), _kv("SUB_STA_NM", _js(st)),
                    _kv("RIDE_PASGR_NUM", ride), _kv("ALIGHT_PASGR_NUM", alight), _kv("WORK_DT", _js(d)))

    rows = F.concat(F.lit("["), rrow(ride, uid), F.when(two, F.concat(F.lit(","), rrow(n1, uid1))).otherwise(F.lit("")),
                    F.lit("]"))
    ok_result = F.lit('"RESULT":{"CODE":"INFO-000","MESSAGE":"정상 처리되었습니다"}')
    ridership = (
        F.when(err & ((e % 14) == 0), F.lit(
            '{"CardSubwayStatsNew":{"list_total_count":0,"RESULT":{"CODE":"INFO-200","MESSAGE":"해당하는 데이터가 없습니다."}}}'))
        .when(err, F.lit('{"CardSubwayStatsNew":{"list_total_count":0,"RESULT":{"CODE":"ERROR-500","MESSAGE":"서버 오류"}}}'))
        .when((e % 11) == 0, F.concat(F.lit('{"CardSubwayStatsNew":{"list_total_count":1,"row":'), rows, F.lit("}}")))
        .when((e % 13) == 0, F.concat(F.lit('{"CardSubwayStatsNew":{"list_total_count":0,'), ok_result, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"CardSubwayStatsNew":{"list_total_count":1,'), ok_result, F.lit(',"row":'), rows,
                            F.lit("}}")))
    )

    # live arrivals
    def item(updn, msg2):
        missing = (e % 11) == 0
        return _obj(
            _kv("subwayId", _js((F.lit(1001) + e % 9).cast("string"))), _kv("statnNm", _js(st)),
            _kv("updnLine", _js(updn)), _kv("trainLineNm", _js(F.concat(ln, F.lit(" 방면")))),
            _kv("arvlMsg2", _js(F.concat(msg2, F.lit("분 후")))),
            F.when(~missing, _kv("arvlMsg3", _js(st))),
            F.when(~missing, _kv("btrainSttus", _js(F.lit("일반")))),
            _kv("arvlCd", _js((e % 6).cast("string"))),
        )

    up = F.when((e % 2) == 0, F.lit("상행")).otherwise(F.lit("하행"))
    down = F.when((e % 2) == 0, F.lit("하행")).otherwise(F.lit("상행"))
    items = F.when((e % 13) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), item(up, n), F.when(two, F.concat(F.lit(","), item(down, n1))).otherwise(F.lit("")),
                 F.lit("]")))
    arrivals = F.when(err, F.lit('{"errorMessage":{"status":500,"code":"ERROR-500","message":"서버 오류"}}')).otherwise(
        F.concat(F.lit('{"errorMessage":{"status":200,"code":"INFO-000","message":"정상 처리되었습니다."},'
                       '"realtimeArrivalList":'), items, F.lit("}")))

    # weather forecast
    def fitem(cat, val):
        return _obj(_kv("baseDate", _js(d)), _kv("baseTime", F.lit('"0500"')), _kv("category", F.lit(f'"{cat}"')),
                    _kv("fcstDate", _js(d)), _kv("fcstTime", _js(F.concat(hh, F.lit("00")))),
                    _kv("fcstValue", _js(val.cast("string"))), _kv("nx", F.lit("60")), _kv("ny", F.lit("127")))

    ok_header = '{"response":{"header":{"resultCode":"00","resultMsg":"NORMAL_SERVICE"},'
    forecast = (
        F.when(err, F.lit('{"response":{"header":{"resultCode":"03","resultMsg":"NO_DATA"}}}'))
        .when((e % 11) == 0, F.lit(ok_header + '"body":{"dataType":"JSON","totalCount":0}}}'))
        .otherwise(F.concat(
            F.lit(ok_header + '"body":{"dataType":"JSON","items":{"item":['),
            fitem("TMP", event_count(F.col("value")) % 40), F.lit(","), fitem("POP", F.col("user_id") % 100),
            F.lit("]}}}}")))
    )

    # hourly ridership, first row counts
    nn = event_count(F.col("value"))
    hour_parts = []
    for h in range(24):
        on = ((nn * (h + 1) + e) % 500).cast("string")
        off = ((F.col("user_id") * (h + 3) + nn) % 400).cast("string")
        hour_parts.append(F.when(((e + h) % 11) != 0, F.concat(
            F.lit(f'"HR_{h}_GET_ON_NOPE":'), on, F.lit(f',"HR_{h}_GET_OFF_NOPE":'), off)))
    head = [_kv("USE_MM", _js(ym)), _kv("SBWY_ROUT_LN_NM", _js(ln)), _kv("STTN", _js(st))]
    r1 = _obj(*head, *hour_parts)
    r2 = _obj(*head, F.lit('"HR_0_GET_ON_NOPE":999999'))
    empty = F.concat(F.lit('{"CardSubwayTime":{"list_total_count":0,'), ok_result, F.lit(',"row":[]}}'))
    hourly = F.when(err, F.lit('{"RESULT":{"CODE":"INFO-200","MESSAGE":"해당하는 데이터가 없습니다."}}')).when((e % 13) == 0, empty).otherwise(
        F.concat(F.lit('{"CardSubwayTime":{"list_total_count":2,'), ok_result, F.lit(',"row":['), r1, F.lit(","), r2,
                 F.lit("]}}")))
    return ev.select(
        "event_id", ridership.alias("ridership_json"), arrivals.alias("arrivals_json"),
        forecast.alias("forecast_json"), hourly.alias("hourly_json"),
    )
