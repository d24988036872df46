"""Column expressions: every rule of the source project as a built-in Spark
expression (CASE WHEN, arithmetic, literal maps), so that it runs inside
whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.functions import constants as K


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def between(c: Column | str, lo: int, hi: int) -> Column:
    c = col_(c)
    return (c >= lo) & (c <= hi)


# --- labels -----------------------------------------------------------------
def period_label(hour: Column | str) -> Column:
    """Training-time period of an hour (5 classes)."""
    h = col_(hour)
    return (
        F.when(between(h, 7, 9), K.PERIOD_MORNING)
        .when(between(h, 18, 20), K.PERIOD_EVENING)
        .when(between(h, 11, 13), K.PERIOD_LUNCH)
        .when((h >= 22) | (h <= 5), K.PERIOD_LATE_NIGHT)
        .otherwise(K.PERIOD_OTHER)
    )


def congestion_label(total: Column | str, thresholds=K.CONGESTION_THRESHOLDS) -> Column:
    """Absolute congestion label. A null total fails every comparison and so
    lands in the last class, as NaN does in the source."""
    t = col_(total)
    lo, mid, hi = thresholds
    return (
        F.when(t < lo, K.CONGESTION_LABELS[0])
        .when(t < mid, K.CONGESTION_LABELS[1])
        .when(t < hi, K.CONGESTION_LABELS[2])
        .otherwise(K.CONGESTION_LABELS[3])
    )


def level_of_label(label: Column | str) -> Column:
    """Congestion label -> level 0..3 (null for unknown labels)."""
    lab = col_(label)
    expr = None
    for i, name in enumerate(K.CONGESTION_LABELS):
        expr = (F.when(lab == name, F.lit(i)) if expr is None else expr.when(lab == name, F.lit(i)))
    return expr.cast("int")


def level_of_total(total: Column | str, thresholds=K.CONGESTION_THRESHOLDS) -> Column:
    t = col_(total)
    lo, mid, hi = thresholds
    return F.when(t < lo, 0).when(t < mid, 1).when(t < hi, 2).otherwise(3).cast("int")


def label_of_level(level: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in K.CONGESTION_LABELS]), col_(level) + 1)


def color_of_level(level: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in K.LEVEL_COLORS]), col_(level) + 1)


def day_name_ko(dow: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in K.DAY_NAMES_KO]), col_(dow) + 1)


def peak_level(pct: Column | str) -> Column:
    p = col_(pct)
    expr = None
    for bound, name in K.PEAK_LEVEL_THRESHOLDS:
        expr = F.when(p >= bound, name) if expr is None else expr.when(p >= bound, name)
    return expr.otherwise(K.PEAK_LEVEL_DEFAULT)


def month_third(day: Column | str) -> Column:
    """Right-closed bins (0,10], (10,20], (20,31]."""
    d = col_(day)
    return (
        F.when(between(d, 1, 10), K.MONTH_THIRDS[0])
        .when(between(d, 11, 20), K.MONTH_THIRDS[1])
        .when(between(d, 21, 31), K.MONTH_THIRDS[2])
    )


# --- hour flags and intensity -------------------------------------------------
HOUR_FLAGS = {
    "f_morning": (7, 9),
    "f_evening_rush": (18, 20),
    "f_lunch": (12, 13),
    "f_late_night": (0, 5),
    "f_night": (21, 23),
}


def hour_flag(hour: Column | str, name: str) -> Column:
    lo, hi = HOUR_FLAGS[name]
    return between(hour, lo, hi).cast("int")


def rush_intensity(hour: Column | str) -> Column:
    h = col_(hour)
    expr = None
    for hh, v in K.RUSH_INTENSITY.items():
        expr = F.when(h == hh, F.lit(v)) if expr is None else expr.when(h == hh, F.lit(v))
    return expr.otherwise(F.lit(0.0)).cast("double")


def serving_period(hour: Column | str) -> Column:
    """Serving-time period index, 7 ordinal buckets."""
    h = col_(hour)
    return (
        F.when(between(h, 0, 5), 0)
        .when(between(h, 6, 8), 1)
        .when(between(h, 9, 11), 2)
        .when(between(h, 12, 13), 3)
        .when(between(h, 14, 17), 4)
        .when(between(h, 18, 20), 5)
        .otherwise(6)
        .cast("int")
    )


# --- cyclic encodings ---------------------------------------------------------
def cyclic_sin(c: Column | str, period: int) -> Column:
    return F.sin(F.lit(2 * math.pi) * col_(c) / F.lit(float(period)))


def cyclic_cos(c: Column | str, period: int) -> Column:
    return F.cos(F.lit(2 * math.pi) * col_(c) / F.lit(float(period)))


def whole_number(c: Column | str) -> Column:
    """A count written as ``123``, ``123.0`` or ``1,234`` as BIGINT, exact at any size; null if it is no whole number."""
    number = F.regexp_replace(col_(c).cast("string"), ",", "").try_cast("decimal(38,18)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


# --- text ---------------------------------------------------------------------
# Python's str.strip() removes Unicode white space plus the separators
# U+001C..U+001F; Java's (?U)\s covers the former.
_STRIP_PATTERN = r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$"


def strip_unicode(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), _STRIP_PATTERN, "")


# --- scoring rules --------------------------------------------------------------
def argmax_level(probs: Column | str) -> Column:
    """0-based index of the largest probability; the first one on ties."""
    p = col_(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def adjusted_level(base: Column | str, probs: Column | str, hour: Column | str, dow: Column | str,
                   cat_transfer: Column | str, cat_business: Column | str) -> Column:
    """Rule adjustment of the argmax level (closed form).

    Rush hours (7-9, 18-20) end at 3 when p3 > 0.02, or p3 > 0.01 at a
    transfer grade >= 2, or p3 > 0.015 at a business station in the morning,
    and at 2 otherwise. Lunch lifts 0 to 1; 21-22 lift 0 to 1 when p1 > 0.03;
    10-11 and 14-17 lift 0 to 1 when p1 + p2 > 0.08. Then hours <= 5 are
    capped at 1 and weekend hours >= 23 at 2.
    """
    b, p, h, d = col_(base), col_(probs), col_(hour), col_(dow)
    tr, bu = col_(cat_transfer), col_(cat_business)
    p1, p2, p3 = F.element_at(p, 2), F.element_at(p, 3), F.element_at(p, 4)
    rush = between(h, 7, 9) | between(h, 18, 20)
    rush_level = F.when(
        (p3 > 0.02) | ((tr >= 2) & (p3 > 0.01)) | ((bu == 1) & between(h, 7, 9) & (p3 > 0.015)), 3
    ).otherwise(2)
    lifted = (
        F.when(rush, rush_level)
        .when(between(h, 12, 13), F.greatest(b, F.lit(1)))
        .when(between(h, 21, 22) & (b == 0) & (p1 > 0.03), 1)
        .when((between(h, 10, 11) | between(h, 14, 17)) & (b == 0) & ((p1 + p2) > 0.08), 1)
        .otherwise(b)
    )
    capped = F.when(h <= 5, F.least(lifted, F.lit(1))).otherwise(lifted)
    capped = F.when((d >= 5) & (h >= 23), F.least(capped, F.lit(2))).otherwise(capped)
    return capped.cast("int")


def recommendation(level: Column | str, hour: Column | str) -> Column:
    lv, h = col_(level), col_(hour)
    rush = h.isin(K.RUSH_HOURS)
    return (
        F.when(lv == 0, K.RECOMMEND_LEVEL0)
        .when(lv == 1, K.RECOMMEND_LEVEL1)
        .when(lv == 2, F.when(rush, K.RECOMMEND_LEVEL2_RUSH).otherwise(K.RECOMMEND_LEVEL2_OTHER))
        .otherwise(F.when(rush, K.RECOMMEND_LEVEL3_RUSH).otherwise(K.RECOMMEND_LEVEL3_OTHER))
    )
