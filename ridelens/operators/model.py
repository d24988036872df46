"""Split, train, evaluate, explain and persist the congestion classifier.

* Splits, class balancing and CV folds use the distributed exact rank of
  ``ranking.rank_within`` over a seeded hash order: exact per-class counts,
  reproducible, and no class is ever gathered into one task.
* The model is a Spark ML pipeline (VectorAssembler + RandomForest), so
  training is distributed; scoring is ``transform`` plus
  ``vector_to_array``. The source's smallest split is applied to the fitted
  trees (``forest.collapse``).
* Saved models are versions of a folder: a load during a save gets the whole
  old or the whole new one.
* Metrics are aggregates over (label, prediction) pairs: one small
  confusion table, from which accuracy, precision, recall and F1 follow.
"""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.operators.forest import write_collapsed
from ridelens.operators.ranking import hash_order, rank_within, select_first
from ridelens.session import checkpoint_stage, scratch_path
from ridelens.sources import versions

N_CLASSES = 4

# --- FIXED VALUES: the source's forest and overfit bands --------------------------
DEFAULT_FOREST = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt"}
MIN_SPLIT = 50
# each row's place in every tree is kept between levels instead of walking all trees anew: the same forest, sooner
TRAINING = {"cacheNodeIds": True}
OVERFIT_BANDS = ((0.05, "none"), (0.10, "slight"))
OVERFIT_OVER = "severe"


# --- splitting and sampling ------------------------------------------------------------
def stratified_split(df: DataFrame, label_col: str, key_cols, test_frac: float = 0.2, seed: int = 42,
                     order_cols=None) -> DataFrame:
    """Adds ``is_test``: per label, the first round(test_frac * n_label) rows
    in the seeded hash order of the key form the test set. Exact per-label
    counts; train and test partition the input. With ``order_cols`` (a total
    order) the rows are taken in that order instead, through the exact
    distributed rank."""
    if order_cols is None:
        return select_first(df, label_col, key_cols, lambda n: F.round(F.lit(test_frac) * n), seed, "is_test")
    r = rank_within(df, label_col, order_cols, rank_col="_r", size_col="_n")
    return r.withColumn("is_test", F.col("_r") <= F.round(F.lit(test_frac) * F.col("_n"))).drop("_r", "_n")


def balance_classes(df: DataFrame, label_col: str, key_cols, seed: int = 42, order_cols=None) -> DataFrame:
    """Down-sample every class to the size of the smallest one (rows taken in
    the seeded hash order, or in ``order_cols``). Our design: the source reads
    a balanced file without showing how it was made."""
    if order_cols is None:
        smallest = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).scalar()
        out = select_first(df, label_col, key_cols, lambda n: smallest, seed, "_keep")
        return out.filter("_keep").drop("_keep")
    r = rank_within(df, label_col, order_cols, rank_col="_r", size_col="_n")
    smallest = r.agg(F.min("_n")).scalar()
    return r.filter(F.col("_r") <= smallest).drop("_r", "_n")


def sample_rows(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the first n in the
    seeded hash order of the key. Selected through hash buckets, so no task
    ever merges more than one bucket's rows (a global ORDER BY ... LIMIT n
    would merge partitions x n rows in one task)."""
    out = select_first(df, None, key_cols, lambda size: F.least(size, F.lit(n)), seed, "_keep")
    return out.filter("_keep").drop("_keep")


# --- training and scoring ---------------------------------------------------------------
def forest(label_col: str = "level", seed: int = 42, **params) -> RandomForestClassifier:
    p = DEFAULT_FOREST | TRAINING | params
    return RandomForestClassifier(labelCol=label_col, featuresCol="features", seed=seed, **p)


def train(df: DataFrame, features, label_col: str = "level", seed: int = 42, **params) -> PipelineModel:
    """VectorAssembler + RandomForestClassifier; min_samples_leaf maps to
    minInstancesPerNode. ``fit_forest`` also applies the smallest split."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    pipe = Pipeline(stages=[assembler, forest(label_col, seed, **params)])
    return pipe.fit(df.withColumn(label_col, F.col(label_col).cast("double")))


def fit_forest(df: DataFrame, features, label_col: str = "level", seed: int = 42, min_split: int = MIN_SPLIT,
               path: str | None = None, **params) -> PipelineModel:
    """The source's forest with its smallest split: no inner node has fewer than ``min_split`` rows. The forest as
    fitted is under ``path``/fitted, the one returned under ``path``/collapsed (default: a scratch folder)."""
    path = path or scratch_path(df.sparkSession, "forest-fit")
    fitted = train(df, features, label_col, seed, **params)
    fitted.write().save(f"{path}/fitted")
    write_collapsed(df.sparkSession, fitted, f"{path}/fitted", f"{path}/collapsed", min_split)
    return PipelineModel.load(f"{path}/collapsed")


def predict(model: PipelineModel, df: DataFrame, label_col: str = "level") -> DataFrame:
    """prediction (int) and the class probabilities as an array."""
    out = model.transform(df.withColumn(label_col, F.col(label_col).cast("double")))
    return (
        out.withColumn("prediction", F.col("prediction").cast("int"))
        .withColumn("probs", vector_to_array("probability"))
        .withColumn(label_col, F.col(label_col).cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def feature_importance(model: PipelineModel, features) -> DataFrame:
    """(feature, importance) sorted by importance; the vector has one entry
    per feature, so this is model metadata, not data."""
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    from ridelens.sources.dims import literal_table

    return literal_table(spark, rows, schema).orderBy(F.col("importance").desc(), F.col("feature"))


# --- metrics ------------------------------------------------------------------------------
def accuracy(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction",
              n_classes: int = N_CLASSES) -> DataFrame:
    """label x prediction counts (n_0..n_3) and row percentages (pct_k, 0 for
    an empty row); one row per label present."""
    counts = pred.groupBy(label_col).pivot(pred_col, list(range(n_classes))).count().fillna(0)
    total = sum(F.col(str(k)) for k in range(n_classes))
    cols = {f"n_{k}": F.col(str(k)).cast("long") for k in range(n_classes)}
    cols.update({
        f"pct_{k}": F.when(total > 0, F.col(str(k)) / total * 100).otherwise(F.lit(0.0)) for k in range(n_classes)
    })
    out = counts.withColumns(cols)
    return out.select(F.col(label_col).alias("label"), *cols.keys())


def _cells(pred: DataFrame, label_col: str, pred_col: str, n_classes: int) -> DataFrame:
    """The whole confusion matrix as one row: array ``m`` of arrays, by one aggregate."""
    cell = lambda i, j: F.count_if((F.col(label_col) == i) & (F.col(pred_col) == j))
    rows = [F.array(*[cell(i, j) for j in range(n_classes)]) for i in range(n_classes)]
    return pred.agg(F.array(*rows).alias("m"))


def _scores(cells: DataFrame, n_classes: int) -> DataFrame:
    """Adds ``per`` (class scores of the classes that occur), ``n`` and the summary values to the one-row matrix."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def one(k: int):
        tp, support = F.col("m")[k][k], sum((F.col("m")[k][j] for j in range(n_classes)), F.lit(0))
        predicted = sum((F.col("m")[i][k] for i in range(n_classes)), F.lit(0))
        p, r = share(tp, predicted), share(tp, support)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return F.struct(F.lit(str(k)).alias("row_label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.cast("long").alias("support"),
                        predicted.alias("predicted"), tp.alias("tp"))

    out = cells.withColumn("per", F.filter(F.array(*[one(k) for k in range(n_classes)]), lambda x: x["support"] + x["predicted"] > 0))
    total = lambda value: F.aggregate("per", F.lit(0.0), lambda s, x: s + value(x))
    out = out.withColumn("n", F.aggregate("per", F.lit(0).cast("long"), lambda s, x: s + x["support"]))
    names = ["precision", "recall", "f1"]
    return out.withColumns({
        "accuracy": F.when(F.col("n") > 0, total(lambda x: x["tp"]) / F.col("n")),
        **{f"macro_{c}": F.when(F.size("per") > 0, total(lambda x, c=c: x[c]) / F.size("per")) for c in names},
        **{f"weighted_{c}": F.when(F.col("n") > 0, total(lambda x, c=c: x[c] * x["support"]) / F.col("n")) for c in names}})


def class_report(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction", n_classes: int = N_CLASSES) -> DataFrame:
    """Per class that occurs: precision, recall, f1, support; then 'accuracy', 'macro avg' and 'weighted avg' rows
    (a metric with a zero denominator is 0). One aggregate over the predictions; the rest is arithmetic on its one row."""
    s = _scores(_cells(pred, label_col, pred_col, n_classes), n_classes)

    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("row_label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support"))

    none = F.lit(None).cast("double")
    extra = F.array(row("accuracy", none, none, F.col("accuracy")), *[row(f"{k} avg", *[F.col(f"{k}_{c}") for c in ("precision", "recall", "f1")]) for k in ("macro", "weighted")])
    per = F.transform("per", lambda x: F.struct(x["row_label"].alias("row_label"), *[x[c].alias(c) for c in ("precision", "recall", "f1", "support")]))
    return s.select(F.inline(F.concat(per, extra)))


def weighted_f1(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction", n_classes: int = N_CLASSES) -> DataFrame:
    return _scores(_cells(pred, label_col, pred_col, n_classes), n_classes).select(F.col("weighted_f1"))


def overfit_report(scores: DataFrame, train_col: str = "train_accuracy", test_col: str = "test_accuracy") -> DataFrame:
    """gap = train - test accuracy; verdict by the bands < 0.05, < 0.10, else."""
    gap = F.col(train_col) - F.col(test_col)
    (b1, v1), (b2, v2) = OVERFIT_BANDS
    verdict = F.when(gap < b1, v1).when(gap < b2, v2).otherwise(OVERFIT_OVER)
    return scores.withColumns({"gap": gap, "verdict": verdict})


# --- learning curve ----------------------------------------------------------------------------
def bin_edges(df: DataFrame, columns, bins: int = 32) -> dict[str, list[float]]:
    """Per column the rising edges of at most ``bins`` bins: each value its own bin where there are so few, quantiles
    otherwise. One aggregate; for bounded samples, as it holds a column's distinct values."""
    probs = [i / bins for i in range(1, bins)]
    value = lambda c: F.col(f"`{c}`").cast("double")

    def edges(c):
        values = F.sort_array(F.collect_set(value(c)))
        return F.when(F.size(values) <= bins, values).otherwise(F.array_distinct(F.percentile(value(c), F.array(*[F.lit(p) for p in probs]))))

    row = df.agg(*[edges(c).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return {c: [float(x) for x in row[f"e{i}"] or []] for i, c in enumerate(columns)}


def with_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Every column of ``edges`` replaced by its bin's number (a value on an edge is in the bin above)."""
    names = list(edges)
    inf = float("inf")
    cut = Bucketizer(inputCols=[f"_v{i}" for i in range(len(names))], outputCols=[f"_b{i}" for i in range(len(names))], handleInvalid="keep",
                     splitsArray=[[-inf, *[e for e in edges[c] if -inf < e < inf], inf] if edges[c] else [-inf, 0.0, inf] for c in names])
    raw = df.withColumns({f"_v{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(names)})
    made = cut.transform(raw)
    # a plain number: with the bucket's own attributes the forest would take it for a category
    return made.withColumns({c: F.col(f"_b{i}") + F.lit(0.0) for i, c in enumerate(names)}).drop(*cut.getInputCols(), *cut.getOutputCols())


def learning_curve(df: DataFrame, features, label_col: str, key_cols, seed: int = 42, folds: int = 3,
                   steps: int = 10, max_rows: int = 100_000, parallelism: int = 8, min_split: int = MIN_SPLIT, bins: int = 32, **forest_params) -> DataFrame:
    """Accuracy on the used training rows and on the held-out fold (``df`` is the training part: test rows stay
    out) for training sizes 10 %..100 % of the training folds (stratified folds by
    rank modulo ``folds`` inside each class), averaged over folds with the
    population standard deviation. Fits run concurrently on the cluster.

    The sample is written once, with every feature as one of ``bins`` bins whose edges are found once, one vector a
    row, its fold, and its place in the training rows of each fold: a fit's rows are a filter of that table (nested:
    smaller sizes are part of larger ones), and no fit assembles vectors or looks for splits among raw values."""
    spark = df.sparkSession
    sample = checkpoint_stage(sample_rows(df, max_rows, key_cols, seed).select(*dict.fromkeys([*features, label_col, *key_cols])), "cv-sample")
    order = hash_order(key_cols, seed)
    ranked = rank_within(sample, label_col, order, rank_col="_r", size_col="_n")
    ranked = ranked.withColumn("_fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_r", "_n")
    # the place of a row among the training rows of every fold but its own: one running count a fold, over one order
    placed = rank_within(ranked, None, order, rank_col="_pos", size_col="_all").withColumn("_order", F.col("_pos"))
    binned = with_bins(placed, bin_edges(sample, features, bins))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(binned)
    table = checkpoint_stage(vectors.select("features", F.col(label_col).cast("double").alias(label_col), "_fold", "_order"), "cv")
    counts = {r["_fold"]: r["n"] for r in table.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    # one set of absolute sizes for every fold, from the smallest training pool
    n_max = min((total - counts.get(f, 0) for f in range(folds)), default=0)
    sizes = sorted({max(1, int(n_max * (i + 1) / steps)) for i in range(steps)})
    # the order number that ends the first s training rows of a fold: rows beyond it are left out
    ends = _cut_points(table, folds, sizes)

    def run(job):
        f, s = job
        part = table.filter((F.col("_fold") != f) & (F.col("_order") <= ends[f, s]))
        folder = scratch_path(spark, "curve")
        pipe = Pipeline(stages=[VectorAssembler(inputCols=["features"], outputCol="x", handleInvalid="keep"),
                                forest(label_col, seed, **forest_params).setFeaturesCol("x")])
        fitted = pipe.fit(part)
        fitted.write().save(f"{folder}/fitted")
        write_collapsed(spark, fitted, f"{folder}/fitted", f"{folder}/collapsed", min_split)
        m = PipelineModel.load(f"{folder}/collapsed")
        # training rows and the held-out fold scored in one pass
        held = F.col("_fold") == f
        both = m.transform(table.filter(held | (F.col("_order") <= ends[f, s])))
        hit = (F.col(label_col) == F.col("prediction")).cast("double")
        row = both.agg(F.avg(F.when(~held, hit)).alias("train"), F.avg(F.when(held, hit)).alias("val")).first()
        return (f, s, float(row["train"] or 0.0), float(row["val"] or 0.0))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        results = list(ex.map(run, [(f, s) for f in range(folds) for s in sizes] if total else []))
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("train_size", T.LongType()),
                           T.StructField("train_score", T.DoubleType()), T.StructField("val_score", T.DoubleType())])
    from ridelens.sources.dims import literal_table

    scores = literal_table(spark, results, schema)
    return scores.groupBy("train_size").agg(
        F.avg("train_score").alias("train_mean"), F.stddev_pop("train_score").alias("train_std"),
        F.avg("val_score").alias("val_mean"), F.stddev_pop("val_score").alias("val_std"),
    ).orderBy("train_size")


def _cut_points(table: DataFrame, folds: int, sizes) -> dict[tuple[int, int], int]:
    """(fold, size) -> the ``_order`` of the size-th row outside the fold, from row counts per fold and 1,024th of the
    order, then inside the 1,024ths that hold a cut."""
    span = F.floor(F.col("_order") / 1024).alias("span")
    per = table.groupBy(span, "_fold").agg(F.count(F.lit(1)).alias("n")).collect()  # at most max_rows / 1,024 spans
    ends: dict[tuple[int, int], int] = {}
    wanted: list[tuple[int, int, int, int]] = []
    for f in range(folds):
        others: dict[int, int] = {}
        for r in per:
            if r["_fold"] != f:
                others[r["span"]] = others.get(r["span"], 0) + r["n"]
        seen, todo = 0, list(sizes)
        for k in sorted(others):
            while todo and seen + others[k] >= todo[0]:
                wanted.append((f, todo[0], k, todo.pop(0) - seen))
            seen += others[k]
    hit = [(F.col("_fold") != f) & (F.floor(F.col("_order") / 1024) == k) for f, _, k, _ in wanted]
    if hit:
        lists = table.agg(*[F.sort_array(F.collect_list(F.when(h, F.col("_order")))).alias(f"w{i}") for i, h in enumerate(hit)]).first()
        for i, (f, s, _, nth) in enumerate(wanted):
            ends[f, s] = lists[f"w{i}"][nth - 1]
    return ends


# --- persistence ---------------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str, features, metrics: dict, note: str = "",
               trained_at: datetime.datetime | None = None) -> str:
    """The pipeline through Spark ML persistence plus a one-row metadata table, as a new version of the folder
    ``path``; returns the version's folder name. Published when both are written, so a load gets a whole version."""
    spark = SparkSession.getActiveSession()
    version = versions.new_version()
    model.write().save(f"{path}/{version}/model")
    ts = (trained_at or datetime.datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    meta = spark.range(1).select(
        F.lit("RandomForestClassifier").alias("model_type"), F.lit(ts).alias("train_date"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        *[F.lit(float(v)).alias(k) for k, v in metrics.items()],
        F.lit(note).alias("note"),
    )
    meta.write.parquet(f"{path}/{version}/meta")
    versions.publish(spark, path, version)
    return version


def load_model(spark: SparkSession, path: str, version: str | None = None):
    """(model, metadata DataFrame) of the last published version, or of ``version``."""
    version = version or versions.latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"no model is published in {path}")
    return PipelineModel.load(f"{path}/{version}/model"), spark.read.parquet(f"{path}/{version}/meta")


def fit_metrics(pred: DataFrame, label_col: str = "level", test_col: str = "is_test") -> dict:
    """train_accuracy, test_accuracy, train_f1, test_f1 of scored rows: the two confusion matrices from one pass."""
    part = lambda test: _scores(_cells(pred.filter(F.col(test_col) == test), label_col, "prediction", N_CLASSES), N_CLASSES)
    both = part(False).withColumn("part", F.lit("train")).unionByName(part(True).withColumn("part", F.lit("test")))
    return {f"{r['part']}_{name}": float(r[c] or 0.0) for r in both.select("part", "accuracy", "weighted_f1").collect()
            for name, c in (("accuracy", "accuracy"), ("f1", "weighted_f1"))}


def model_info(meta: DataFrame) -> DataFrame:
    """Type, date, feature count, first ten features, note and the metrics."""
    return meta.select(
        "model_type", "train_date", F.size("feature_names").alias("feature_count"),
        F.slice("feature_names", 1, 10).alias("features"), "note",
        *[c for c in ("train_accuracy", "test_accuracy", "train_f1", "test_f1") if c in meta.columns],
    )
