"""Column names and schemas.

The source data uses Korean column headers; inside the library every column
has an English name. ``SOURCE_NAMES`` is the translation table (FIXED VALUES:
header texts as they appear in the source files), used at the edges: reading
source CSVs, writing stage files in the source layout, and the substring
tests of feature families, which are defined on the source names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- FIXED VALUES: source header -> library column name ----------------------
SOURCE_NAMES = {
    "사용월": "use_month",
    "호선명": "line",
    "지하철역": "station",
    "시간": "hour",
    "승차인원": "boardings",
    "하차인원": "alightings",
    "총승하차인원": "total",
    "사용일자": "use_date",
    "연도": "year",
    "월": "month",
    "분기": "quarter",
    "시간대구분": "period",
    "혼잡도": "congestion",
    "혼잡도레벨": "level",
    "역_평균승하차": "station_avg",
    "시간_평균승하차": "hour_avg",
    "호선_평균승하차": "line_avg",
    "역_최대승하차": "station_max",
    "역_최소승하차": "station_min",
    "요일": "dow",
    "요일명": "day_name",
    "주말여부": "is_weekend",
    "월_구간": "month_third",
    "시간_sin": "hour_sin",
    "시간_cos": "hour_cos",
    "요일_sin": "dow_sin",
    "요일_cos": "dow_cos",
    "월_sin": "month_sin",
    "월_cos": "month_cos",
    "공휴일여부": "is_holiday",
    "공휴일전날": "holiday_eve",
    "공휴일다음날": "holiday_next",
    "연휴여부": "is_off_day",
    "승하차_1일전": "lag_1",
    "승하차_7일전": "lag_7",
    "승하차_3일평균": "ma_3",
    "승하차_7일평균": "ma_7",
    "승하차_7일표준편차": "std_7",
    "승하차_14일평균": "ma_14",
    "승하차_30일평균": "ma_30",
    "역내_상대혼잡도": "rel_congestion",
    "상대적혼잡도": "relative_congestion",
    "시간_최대승하차": "hour_max",
    "시간_최소승하차": "hour_min",
    "환승역여부": "is_transfer",
    "시간_요일_조합": "hour_dow",
    "시간_주말_조합": "hour_weekend",
    "호선_시간_조합": "line_hour",
    "호선명_encoded": "line_idx",
    "지하철역_encoded": "station_idx",
    "시간대구분_encoded": "period_idx",
    "혼잡도_encoded": "congestion_idx",
    "월_구간_encoded": "month_third_idx",
    "역_업무지구": "cat_business",
    "역_상업지구": "cat_commercial",
    "역_환승역등급": "cat_transfer",
    "역_대학가": "cat_university",
    "역_주거지역": "cat_residential",
    "역_그룹": "cat_group",
    "출근시간대": "f_morning",
    "퇴근시간대": "f_evening_rush",
    "점심시간대": "f_lunch",
    "심야시간대": "f_late_night",
    "저녁시간대": "f_night",
    "러시아워강도": "rush_intensity",
    "time_dow_interaction": "time_dow",
    "station_time_interaction": "station_time",
    "business_rush_interaction": "business_rush",
    "transfer_rush_interaction": "transfer_rush",
    "university_morning_interaction": "university_morning",
    "business_weekday": "business_weekday",
    "commercial_weekend": "commercial_weekend",
    "group_time_dow": "group_time_dow",
    "transfer_rush_weekday": "transfer_rush_weekday",
}
LIBRARY_NAMES = {v: k for k, v in SOURCE_NAMES.items()}

# substrings that mark hour-slot columns of the wide table (FIXED VALUES)
BOARDING_MARK = "승차인원"
ALIGHTING_MARK = "하차인원"
SLOT_HOUR_PATTERN = r"(\d+)시-"


def slot_label(hour: int) -> str:
    """Hour-slot label of the wide table, e.g. 4 -> '04시-05시'."""
    return f"{hour:02d}시-{hour + 1:02d}시"


def boarding_column(hour: int) -> str:
    return f"{slot_label(hour)} {BOARDING_MARK}"


def alighting_column(hour: int) -> str:
    return f"{slot_label(hour)} {ALIGHTING_MARK}"


def source_name(column: str) -> str:
    """Source (reference) name of a library column; unknown names unchanged."""
    return LIBRARY_NAMES.get(column, column)


WIDE_ID_COLUMNS = ["use_month", "line", "station"]

WIDE_SCHEMA = T.StructType(
    [
        T.StructField("사용월", T.IntegerType()),
        T.StructField("호선명", T.StringType()),
        T.StructField("지하철역", T.StringType()),
    ]
    + [
        T.StructField(col, T.LongType())
        for h in range(24)
        for col in (boarding_column(h), alighting_column(h))
    ]
)

LONG_SCHEMA = T.StructType(
    [
        T.StructField("use_month", T.IntegerType()),
        T.StructField("line", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("boardings", T.LongType()),
        T.StructField("alightings", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("dow", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("is_holiday", T.BooleanType()),
    ]
)
