"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the source
project's for results to match: labels, thresholds, lookup tables and
texts. They are stated plainly, in their natural order, and nothing else
lives here. Korean label *values* are kept verbatim because they are data.
"""

from __future__ import annotations

# --- FIXED VALUES: congestion labels by level (absolute thresholds) ---------
CONGESTION_LABELS = ["여유", "보통", "혼잡", "매우혼잡"]
CONGESTION_THRESHOLDS = (500, 1500, 3000)

# --- FIXED VALUES: peak-relative level thresholds (percent of peak) ---------
PEAK_LEVEL_THRESHOLDS = ((90, "매우혼잡"), (70, "혼잡"), (40, "보통"))
PEAK_LEVEL_DEFAULT = "여유"

# --- FIXED VALUES: training-time period labels ------------------------------
PERIOD_MORNING = "출근시간"     # 7-9
PERIOD_EVENING = "퇴근시간"     # 18-20
PERIOD_LUNCH = "점심시간"       # 11-13
PERIOD_LATE_NIGHT = "심야시간"  # >= 22 or <= 5
PERIOD_OTHER = "일반시간"       # everything else

# --- FIXED VALUES: month thirds (day 1-10, 11-20, 21-31) ---------------------
MONTH_THIRDS = ["초", "중", "말"]

# --- FIXED VALUES: rush-hour intensity by hour ------------------------------
RUSH_INTENSITY = {8: 1.0, 7: 0.7, 9: 0.7, 18: 0.9, 19: 0.9, 20: 0.6}

# --- FIXED VALUES: hours treated as rush hour in recommendations ------------
RUSH_HOURS = [7, 8, 9, 18, 19, 20]

# --- FIXED VALUES: colour per level -----------------------------------------
LEVEL_COLORS = ["#4CAF50", "#FFC107", "#FF9800", "#F44336"]

# --- FIXED VALUES: Korean day names, Monday first ---------------------------
DAY_NAMES_KO = ["월요일", "화요일", "수요일", "목요일", "금요일", "토요일", "일요일"]

# --- FIXED VALUES: recommendation texts --------------------------------------
RECOMMEND_LEVEL0 = "여유로운 시간대입니다. 편하게 이용하세요."
RECOMMEND_LEVEL1 = "보통 수준의 혼잡도입니다."
RECOMMEND_LEVEL2_RUSH = "혼잡한 시간대입니다. 가능하면 30분 전후 이용을 권장합니다."
RECOMMEND_LEVEL2_OTHER = "다소 혼잡할 수 있습니다."
RECOMMEND_LEVEL3_RUSH = "매우 혼잡한 시간대입니다. 다음 시간대 이용을 적극 권장합니다."
RECOMMEND_LEVEL3_OTHER = "매우 혼잡합니다. 시간 조정을 권장합니다."

# --- FIXED VALUES: line code fallback, used only without a line code column --
LINE_CODE_FALLBACK = {
    "1호선": 0, "2호선": 1, "3호선": 2, "4호선": 3,
    "5호선": 4, "6호선": 5, "7호선": 6, "8호선": 7, "9호선": 8,
    "경의중앙선": 9, "공항철도": 10, "경춘선": 11, "수인분당선": 12,
    "신분당선": 13, "경강선": 14, "서해선": 15, "인천1호선": 16,
    "인천2호선": 17, "우이신설선": 18, "신림선": 19,
}

# --- FIXED VALUES: line list shown when no station data is loaded -----------
DEFAULT_LINES = ["1호선", "2호선", "3호선", "4호선", "5호선", "6호선", "7호선", "8호선", "9호선"]

# --- FIXED VALUES: station categories ----------------------------------------
# columns: business, commercial, transfer grade, university, residential, group
STATION_CATEGORY_COLUMNS = [
    "cat_business", "cat_commercial", "cat_transfer",
    "cat_university", "cat_residential", "cat_group",
]
STATION_CATEGORIES = {
    "강남": (1, 1, 2, 0, 0, 1),
    "역삼": (1, 1, 0, 0, 0, 1),
    "선릉": (1, 0, 1, 0, 0, 1),
    "삼성": (1, 1, 0, 0, 0, 1),
    "여의도": (1, 0, 2, 0, 0, 1),
    "광화문": (1, 1, 0, 0, 0, 1),
    "종각": (1, 1, 1, 0, 0, 1),
    "을지로입구": (1, 1, 1, 0, 0, 1),
    "홍대입구": (0, 1, 2, 1, 0, 2),
    "신촌": (0, 1, 0, 1, 0, 2),
    "명동": (0, 1, 0, 0, 0, 2),
    "동대문": (0, 1, 2, 0, 0, 2),
    "신림": (0, 0, 0, 1, 1, 3),
    "서울대입구": (0, 0, 0, 1, 0, 3),
    "이대": (0, 1, 0, 1, 0, 3),
    "건대입구": (0, 1, 1, 1, 0, 3),
    "왕십리": (0, 0, 4, 0, 0, 4),
    "신도림": (0, 1, 3, 0, 0, 4),
    "사당": (0, 0, 3, 0, 1, 4),
    "잠실": (0, 1, 2, 0, 1, 4),
    "교대": (0, 0, 2, 0, 0, 4),
    "고속터미널": (0, 1, 3, 0, 0, 4),
    "목동": (0, 0, 0, 0, 1, 5),
    "노원": (0, 0, 2, 0, 1, 5),
    "수유": (0, 0, 0, 0, 1, 5),
    "구로디지털단지": (1, 0, 1, 0, 0, 1),
    "까치산": (0, 0, 0, 0, 1, 6),
    "신정네거리": (0, 0, 0, 0, 1, 6),
}

# --- FIXED VALUES: holiday calendar used by the feature pipeline (2015-2025) --
HOLIDAYS = [
    "2015-01-01", "2015-02-18", "2015-02-19", "2015-02-20",
    "2015-03-01", "2015-05-05", "2015-05-25", "2015-06-06",
    "2015-08-15", "2015-09-26", "2015-09-27", "2015-09-28", "2015-09-29",
    "2015-10-03", "2015-10-09", "2015-12-25",
    "2016-01-01", "2016-02-07", "2016-02-08", "2016-02-09", "2016-02-10",
    "2016-03-01", "2016-04-13", "2016-05-05", "2016-05-14", "2016-06-06",
    "2016-08-15", "2016-09-14", "2016-09-15", "2016-09-16",
    "2016-10-03", "2016-10-09", "2016-12-25",
    "2017-01-01", "2017-01-27", "2017-01-28", "2017-01-29", "2017-01-30",
    "2017-03-01", "2017-05-03", "2017-05-05", "2017-05-09", "2017-06-06",
    "2017-08-15", "2017-10-02", "2017-10-03", "2017-10-04", "2017-10-05", "2017-10-06",
    "2017-10-09", "2017-12-25",
    "2018-01-01", "2018-02-15", "2018-02-16", "2018-02-17",
    "2018-03-01", "2018-05-05", "2018-05-07", "2018-05-22", "2018-06-06", "2018-06-13",
    "2018-08-15", "2018-09-23", "2018-09-24", "2018-09-25", "2018-09-26",
    "2018-10-03", "2018-10-09", "2018-12-25",
    "2019-01-01", "2019-02-04", "2019-02-05", "2019-02-06",
    "2019-03-01", "2019-05-05", "2019-05-06", "2019-05-12", "2019-06-06",
    "2019-08-15", "2019-09-12", "2019-09-13", "2019-09-14",
    "2019-10-03", "2019-10-09", "2019-12-25",
    "2020-01-01", "2020-01-24", "2020-01-25", "2020-01-26", "2020-01-27",
    "2020-03-01", "2020-04-15", "2020-04-30", "2020-05-05", "2020-06-06",
    "2020-08-15", "2020-08-17", "2020-09-30", "2020-10-01", "2020-10-02",
    "2020-10-03", "2020-10-09", "2020-12-25",
    "2021-01-01", "2021-02-11", "2021-02-12", "2021-02-13",
    "2021-03-01", "2021-05-05", "2021-05-19", "2021-06-06",
    "2021-08-15", "2021-09-20", "2021-09-21", "2021-09-22",
    "2021-10-03", "2021-10-04", "2021-10-09", "2021-12-25",
    "2022-01-01", "2022-01-31", "2022-02-01", "2022-02-02",
    "2022-03-01", "2022-03-09", "2022-05-05", "2022-05-08", "2022-06-01", "2022-06-06",
    "2022-08-15", "2022-09-09", "2022-09-10", "2022-09-11", "2022-09-12",
    "2022-10-03", "2022-10-09", "2022-10-10", "2022-12-25",
    "2023-01-01", "2023-01-21", "2023-01-22", "2023-01-23", "2023-01-24",
    "2023-03-01", "2023-05-05", "2023-05-27", "2023-05-29", "2023-06-06",
    "2023-08-15", "2023-09-28", "2023-09-29", "2023-09-30",
    "2023-10-03", "2023-10-09", "2023-12-25",
    "2024-01-01", "2024-02-09", "2024-02-10", "2024-02-11", "2024-02-12",
    "2024-03-01", "2024-04-10", "2024-05-05", "2024-05-06", "2024-05-15", "2024-06-06",
    "2024-08-15", "2024-09-16", "2024-09-17", "2024-09-18",
    "2024-10-03", "2024-10-09", "2024-12-25",
    "2025-01-01", "2025-01-28", "2025-01-29", "2025-01-30",
    "2025-03-01", "2025-03-03", "2025-05-05", "2025-05-06", "2025-06-06",
    "2025-08-15", "2025-10-03", "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-08",
    "2025-10-09", "2025-12-25",
]

# --- FIXED VALUES: the collector's 2025 holiday file (yyyymmdd, name) --------
COLLECTOR_HOLIDAYS_2025 = [
    ("20250101", "신정"),
    ("20250128", "설날 연휴"),
    ("20250129", "설날"),
    ("20250130", "설날 연휴"),
    ("20250301", "삼일절"),
    ("20250505", "어린이날"),
    ("20250506", "대체공휴일"),
    ("20250815", "광복절"),
    ("20251003", "개천절"),
    ("20251009", "한글날"),
    ("20251225", "크리스마스"),
]

# --- FIXED VALUES: columns dropped as target-derived (names as written) ------
TARGET_RELATED = [
    "boardings", "alightings", "total",
    "station_avg", "hour_avg",
    "ma_3", "ma_7",
    "ma_14", "ma_30",
    "congestion", "relative_congestion",
    "station_max", "station_min",
    "hour_max", "hour_min",
]
# strict mode also drops what the list above misses (leaks kept by the source)
TARGET_RELATED_STRICT_EXTRA = ["rel_congestion", "lag_1", "lag_7", "std_7", "line_avg"]

# --- FIXED VALUES: columns never used as features ----------------------------
NON_FEATURE_COLUMNS = ["level", "use_date", "Unnamed: 0", "station", "line"]

# --- FIXED VALUES: the training feature list, in order ----------------------
TRAINING_FEATURES = [
    "hour", "dow", "month", "year", "quarter",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "is_weekend", "is_holiday", "holiday_eve", "holiday_next", "is_off_day",
    "station_avg", "hour_avg", "line_avg",
    "station_max", "station_min", "rel_congestion",
    "lag_1", "lag_7", "ma_3", "ma_7", "std_7",
    "line_idx", "station_idx", "period_idx",
    "is_transfer", "boardings", "alightings",
]
TRAINING_EXTRA = ["level", "use_date", "station", "line", "total"]
