"""Exact quantiles by radix selection: histograms of order-preserving buckets, narrowed until a bucket is one value.

A value's bucket is its sign, the exponent of its size and the next 12 binary
digits: bucket numbers rise with the values, and counts below 8,192 have a
bucket each. One pre-aggregated pass counts the values of every column's
buckets and keeps each bucket's least and largest value. The buckets that hold
the wanted ranks follow from running counts over that small table (at most
8,192 rows per power of two that occurs). Where such a bucket has one value,
that is the answer; only the rows inside the others are counted again, each
bucket cut into 8,192 equal parts of its range. No sort and no exchange of the
values, no written stage; for counts one pass is the rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 8192
LEAST_EXPONENT = -1000  # sizes below 2**-1000 share one exponent


def bucket(v: Column) -> Column:
    """A whole number that never falls as the double ``v`` rises (NaN, the largest, has the last)."""
    size = F.abs(v)
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT))
    digits = F.floor(size * F.pow(F.lit(2.0), (F.lit(12) - exponent).cast("double")))
    number = (exponent - LEAST_EXPONENT + 1) * PARTS + digits
    inf = F.lit(1 << 40)
    return (F.when(F.isnan(v), inf * 2).when(v == float("inf"), inf).when(v == float("-inf"), -inf)
            .when(v > 0, number).when(v < 0, -number).otherwise(F.lit(0)).cast("long"))


def _ranks(total: Column, probs) -> list[Column]:
    """The 0-based ranks whose values the quantiles lie between."""
    place = [F.lit(p) * (total - 1) for p in probs]
    return [f(x).cast("long") for x in place for f in (F.floor, F.ceil)]


def _holding(hist: DataFrame, group: str, ranks) -> list:
    """Of a histogram (group, key, n, lo, hi): the buckets that hold a wanted rank, with the rows before them and in all."""
    ordered = Window.partitionBy(group).orderBy("key")
    hist = hist.withColumns({"before": F.sum("n").over(ordered) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(group))})
    inside = [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in ranks(F.col("total"))]
    return hist.filter(F.array_contains(F.array(*inside), True)).collect()


def _one_value(b) -> bool:
    return b["lo"] == b["hi"] or math.isnan(b["lo"])


def _hist(pairs: DataFrame, group: str, key: Column) -> DataFrame:
    return pairs.groupBy(group, key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def quantiles(df: DataFrame, columns, probs) -> dict[str, list[float | None]]:
    """Per column its exact quantiles, interpolated linearly between neighbours; nulls are left out, a column without
    values has None. What reaches the driver is at most two buckets a quantile and pass."""
    columns, probs = list(columns), list(probs)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.inline(pairs)).filter("v is not null")
    found = _holding(_hist(values, "c", bucket(F.col("v"))), "c", lambda total: _ranks(total, probs))
    totals = {b["c"]: b["total"] for b in found}
    wanted = {(c, r): None for c, total in totals.items() for p in probs for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}
    open_buckets = [(b["c"], b["before"], b["n"], b["lo"], b["hi"]) for b in found]
    while True:
        narrow = []
        for c, before, n, lo, hi in open_buckets:
            ranks = [r for (cc, r), v in wanted.items() if cc == c and v is None and before <= r < before + n]
            if _one_value({"lo": lo, "hi": hi}):
                wanted.update({(c, r): lo for r in ranks})
            elif ranks:
                narrow.append((c, before, lo, hi, ranks))
        if not narrow:
            break
        # rows inside a bucket that is still open, under its number; the buckets of one column do not overlap
        case = None
        for t, (c, _, lo, hi, _) in enumerate(narrow):
            hit = (F.col("c") == c) & F.col("v").between(lo, hi)
            case = F.when(hit, t) if case is None else case.when(hit, t)
        inside = values.withColumn("t", case).filter("t is not null")
        at = lambda what: F.element_at(F.array(*[F.lit(x) for x in what]), F.col("t") + 1)
        low, high = at([b[2] for b in narrow]), at([b[3] for b in narrow])
        part = F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * (PARTS - 1))  # halves: no overflow
        ranks_of = F.array(*[F.array(*[F.lit(r - before) for r in ranks]) for _, before, _, _, ranks in narrow])
        hist = _hist(inside, "t", part)
        ordered = Window.partitionBy("t").orderBy("key")
        hist = hist.withColumn("before", F.sum("n").over(ordered) - F.col("n")).withColumn("ranks", F.element_at(ranks_of, F.col("t") + 1))
        holding = hist.filter(F.exists("ranks", lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n")))).collect()
        open_buckets = [(narrow[b["t"]][0], narrow[b["t"]][1] + b["before"], b["n"], b["lo"], b["hi"]) for b in holding]

    def value(i: int, p: float) -> float | None:
        if i not in totals:
            return None
        place = p * (totals[i] - 1)
        low, high = wanted[i, math.floor(place)], wanted[i, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return {c: [value(i, p) for p in probs] for i, c in enumerate(columns)}


def quantile_table(df: DataFrame, columns, probs) -> DataFrame:
    """One row: a column ``<c>`` per input column with its quantiles as an array of doubles."""
    found = quantiles(df, columns, probs)
    return df.sparkSession.range(1).select(*[F.array(*[F.lit(x).cast("double") for x in found[c]]).alias(c) for c in found])
