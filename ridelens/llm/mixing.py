"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels (domain, language, source by default) carry integer weights.
A token budget is propagated from the root: each parent's budget is shared
among its children by weight, no child getting more than its subtree can give
(tokens times the epoch limit). What a child cannot take goes to its siblings
in proportion to their weights; only what the whole subtree cannot take is
missing one level higher, where the parent's own siblings take it. This is
water-filling per parent: children sorted by capacity/weight, saturated ones
first; whole numbers throughout, shares rounded down.

A leaf with budget b and t tokens gives all its documents b div t times
(epochs 0, 1, ...) and, of one more epoch, the prefix of its documents in the
epoch's seeded order whose tokens fit in the rest. The prefix is found without
sorting a leaf in one task: token sums per (leaf, hash bucket) are aggregated,
their running sums name each leaf's boundary bucket, and only that bucket's
rows (1 / 4,096 of the leaf) are ordered one by one; no task holds more than
4,096 sums of a leaf.

Defined cases: a null level is the node ``(null)``; a null text has no tokens;
zero-token documents are taken with their epoch or prefix; nodes of weight 0
get nothing; repeated rows count each; an empty table gives no rows; an input
column ``epoch`` is replaced, ``domain`` and ``n_tokens`` are used as given.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import stage

LEVELS = ("domain", "lang", "source")
#: weight of the named nodes of a level; others weigh 1
WEIGHTS = {"domain": {}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
PERCENT, MAX_EPOCHS, SEED = 60, 2, 17
D = "decimal(38,0)"


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The example tree's domains: a fixed rule on the source's name."""
    return F.concat(F.lit("dom_"), F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1))


def tree_columns(docs: DataFrame, levels=LEVELS) -> DataFrame:
    """Adds n_tokens and makes the level columns non-null text. Columns ``domain`` and ``n_tokens`` of the input are
    used as given (a null or negative number of tokens is 0); where there is none, they are derived."""
    if "domain" not in docs.columns:
        docs = docs.withColumn("domain", source_domain(F.col("source")))
    out = docs.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("(null)")) for k in levels})
    given = "n_tokens" in docs.columns
    return out.withColumn("n_tokens", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long") if given else word_tokens(F.col("text")))


def weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast(D)


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent columns, name, cap, weight, parent's ``budget`` -> ``budget`` of each child."""
    children = children.filter("weight > 0 and cap > 0")
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.expr("cap / weight"), name)
    rows = children.withColumns({
        "_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(D),
        "_weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(D)})
    # the child is full if its level, given to all from here on, still fits
    rows = rows.withColumn("_full", F.expr("_before * weight + cap * _weights <= budget * weight"))
    rows = rows.withColumns({
        "_used": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0)).cast(D),
        "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group).cast(D)})
    got = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("((budget - _used) * weight) div _open"))
    return rows.withColumn("budget", got.cast("long")).drop("_before", "_weights", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, levels=LEVELS, weights=WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: level columns and ``tokens`` (a written table) -> level columns, tokens, ``budget``."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(D))
    total = leaves.agg(F.least(F.expr(f"cast(sum(tokens) * {percent} as {D}) div 100"), F.sum("cap").cast("long")).alias("budget"))
    known, path = total, []
    for level in levels:
        nodes = leaves.groupBy(*path, level).agg(F.sum("cap").cast(D).alias("cap")).withColumn("weight", weight(level, weights))
        # the root's budget is one row
        nodes = nodes.join(known, path) if path else nodes.crossJoin(F.broadcast(known))
        path = [*path, level]
        known = share_out(nodes.withColumn("budget", F.col("budget").cast(D)), path[:-1], level).select(*path, "budget")
    return leaves.drop("cap").join(known, list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast("long"))


def epoch_hash(seed: int, epoch: Column, id_col: str) -> Column:
    """The order of an epoch: 128 bits of a keyed digest as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, levels=LEVELS, weights=WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
                id_col: str = "doc_id") -> DataFrame:
    """The chosen rows, once per epoch in which they are chosen, with ``n_tokens`` and ``epoch``."""
    rows, levels = tree_columns(docs, levels), list(levels)
    keys = stage(rows.select(F.col(id_col).alias("_id"), *levels, "n_tokens"), "tokens")
    leaves = stage(keys.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = stage(leaf_budgets(leaves, levels, weights, percent, max_epochs), "budgets")
    budgets = budgets.withColumns({"_full": F.expr("case when tokens > 0 then budget div tokens else 0 end"),
                                   "_rest": F.expr("case when tokens > 0 then budget % tokens else -1 end")})

    place = lambda name: {"_hash": epoch_hash(seed, F.col("_full"), name)}
    bucket = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    sums = keys.join(budgets, levels).withColumns(place("_id")).withColumn("_bucket", bucket)
    sums = sums.groupBy(*levels, "_rest", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    run = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_to", F.sum("_sum").over(run))
    # the first bucket whose tokens no longer all fit
    edge = sums.filter("_to > _rest").groupBy(*levels).agg(F.min_by(F.struct("_bucket", (F.col("_to") - F.col("_sum")).alias("_before")), "_bucket").alias("_edge"))
    plan = stage(budgets.join(edge, levels, "left").select(*levels, "_full", "_rest", F.col("_edge._bucket").alias("_edge"), F.col("_edge._before").alias("_before")), "plan")

    kept = [c for c in rows.columns if c != "epoch"]
    found = rows.select(*kept).join(plan, levels).withColumns(place(id_col)).withColumn("_bucket", bucket)
    whole = found.withColumn("_n", F.col("_full") + F.when(F.col("_bucket") < F.coalesce("_edge", F.lit(1 << 12)), F.when(F.col("_rest") >= 0, 1).otherwise(0)).otherwise(0))
    whole = whole.filter("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    inside = Window.partitionBy(*levels).orderBy("_hash", id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = found.filter("_bucket = _edge").withColumn("_to", F.sum("n_tokens").over(inside))
    part = part.filter("_before + _to <= _rest").withColumn("epoch", F.col("_full").cast("int"))
    return whole.select(*kept, "epoch").unionByName(part.select(*kept, "epoch"))
