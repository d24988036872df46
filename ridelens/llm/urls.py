"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones. The trees learn from a
sample of about ``sample`` of them, taken by hash (a documented bound on the
labelled rows for fitting); everything else covers all rows: the suffix and
path statistics are aggregates of all labelled rows, joined back by key (a
hot suffix is one row on that side), and every URL is judged.

Defined cases: a null URL or one without ``://`` has an empty host and path,
meets no rule and is judged by its (empty) features; if no row is labelled the
verdict is allow, and if all labels agree it is theirs; repeated rows are
judged each; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import stage

# FIXED VALUES: rule text (host, then path) -> verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 12, 4, 7
PRIOR = 20.0  # labelled rows that a suffix's statistic starts with, at the overall rate

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["suffix1", "suffix2", "segment1"]
FEATURES = ["url_length", "host_length", "path_length", "depth", "n_labels", "digit_ratio", "host_digits", "n_hyphens", "n_params", "n_fragments",
            "entropy", "has_extension", "is_https", *[f"{k}_rate" for k in KEYS], *[f"{k}_seen" for k in KEYS]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, after, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWERED), part(2)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    count = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: s + count(c) * F.log2(count(c)))
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return rows.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/+[^/]"), "n_labels": F.size(labels).cast("double"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "host_digits": count(F.col("host"), "[0-9]"),
        "n_hyphens": count(url, "-"), "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "n_fragments": count(url, "#"),
        "entropy": entropy(url), "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), "is_https": url.startswith("https:").cast("double"),
        "suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2),
        "segment1": F.regexp_extract("path", "^/([^/]*)/", 1)})


def with_statistics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Smoothed block rate and log count of each key among all labelled rows; unseen keys get the overall rate."""
    overall = labelled.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("overall"))
    rows = rows.crossJoin(F.broadcast(overall))  # one row
    for k in KEYS:
        found = labelled.groupBy(F.col(k).alias("_k")).agg(F.sum("label").alias("_s"), F.count(F.lit(1)).alias("_c"))
        rows = rows.join(found, F.col(k) == F.col("_k"), "left")
        n = F.coalesce("_c", F.lit(0))
        rows = rows.withColumns({f"{k}_rate": (F.coalesce("_s", F.lit(0.0)) + PRIOR * F.col("overall")) / (n + PRIOR), f"{k}_seen": F.log1p(n)}).drop("_k", "_s", "_c")
    return rows.drop("overall")


def fit(labelled: DataFrame, sample: int = TRAIN_ROWS) -> GBTClassificationModel | None:
    """Trees from about ``sample`` labelled rows, chosen by hash; None if fewer than two classes are there."""
    by_label = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(by_label) < 2:
        return None
    share = min(1.0, sample / sum(by_label.values()))
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_statistics(chosen, labelled)).select("features", "label")
    data = stage(data.coalesce(4), "url-train")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(data)


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None, sample: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' ``score`` (probability of block)."""
    rules = rules if rules is not None else RULES
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    said = reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))
    rows = stage(lexical(rows.withColumn("said", said)).withColumn("label", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("double"))), "urls")
    labelled = rows.filter(F.col("label").isNotNull())
    model = fit(labelled, sample)
    if model is None:
        only = labelled.agg(F.max("said").alias("v")).first()["v"]
        one = F.lit(only or "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", one).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_statistics(rows, labelled))
    scored = model.transform(ready)
    from pyspark.ml.functions import vector_to_array

    verdict = F.coalesce("said", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), vector_to_array("probability")[1].alias("score"))
