"""A fitted forest as a table of its nodes: smallest split, plain evaluation, importances.

Spark ML writes a forest as one row per node. That table is read here as rows
(tree, node, left, right, feature, threshold, ...), so rules over trees are
joins and aggregates:

* ``collapse``: the source does not split a node of fewer than 50 rows; Spark ML
  has no such parameter. Row counts fall from parent to child, so a node stays
  exactly when its parent has enough rows, and becomes a leaf when it has too
  few itself: one join of the table with itself, whatever the depth. Nodes are
  numbered anew in their order and written back as a loadable model.
* ``evaluate``: class probabilities by walking all trees level by level, a join
  per level: an independent second path beside the library's ``transform``.
* ``node_importance``: gain times rows per feature, normalised per tree and in
  all.

A tree has at most rows / (rows per leaf) nodes; the table is model-sized, not
data-sized, and joins on it are planned by its measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = ["tree", "node", "left", "right", "feature", "threshold", "categories", "n", "counts", "gain"]


def _forest_folder(path: str) -> str:
    """The forest is the last stage of the saved pipeline (assembler, forest)."""
    return f"{path}/stages/1_*"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved pipeline's forest. ``left`` and ``right`` are -1 at a leaf; a numeric split sends values up
    to ``threshold`` left, one with ``categories`` those in the list; ``n`` counts the drawn rows, ``counts`` per class."""
    d = F.col("nodeData")
    leaf = d["leftChild"] < 0
    numeric = d["split"]["numCategories"] < 0
    return spark.read.parquet(f"{_forest_folder(path)}/data").select(
        F.col("treeID").alias("tree"), d["id"].alias("node"), d["leftChild"].alias("left"), d["rightChild"].alias("right"),
        F.when(~leaf, d["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf & numeric, F.try_element_at(d["split"]["leftCategoriesOrThreshold"], F.lit(1))).alias("threshold"),
        F.when(~leaf & ~numeric, d["split"]["leftCategoriesOrThreshold"]).alias("categories"),
        d["rawCount"].alias("n"), d["impurityStats"].alias("counts"), d["gain"].alias("gain"))


def collapse(nodes: DataFrame, min_split: int = 50) -> DataFrame:
    """The nodes that a forest keeps which splits no node of fewer than ``min_split`` rows, numbered anew in order."""
    parents = nodes.filter("left >= 0").select("tree", "n", F.explode(F.array("left", "right")).alias("node"))
    parents = parents.withColumnRenamed("n", "above")
    kept = nodes.join(parents, ["tree", "node"], "left").filter(F.col("above").isNull() | (F.col("above") >= min_split))
    inner = (F.col("left") >= 0) & (F.col("n") >= min_split)
    order = Window.partitionBy("tree").orderBy("node")  # a tree: bounded by the rows per leaf
    kept = kept.withColumns({c: F.when(inner, F.col(c)) for c in ("left", "right", "feature", "threshold", "categories")})
    kept = kept.withColumn("number", (F.row_number().over(order) - 1).cast("int"))
    out = kept
    for side in ("left", "right"):
        to = kept.select("tree", F.col("node").alias(side), F.col("number").alias(f"{side}_number"))
        out = out.join(to, ["tree", side], "left")
    return out.select(
        "tree", F.col("number").alias("node"), *[F.coalesce(f"{s}_number", F.lit(-1)).alias(s) for s in ("left", "right")], "feature", "threshold",
        "categories", "n", "counts", F.when(F.col("left_number").isNull(), -1.0).otherwise(F.col("gain")).alias("gain"),
        F.col("node").alias("was"))


def write_collapsed(spark: SparkSession, model: PipelineModel, source: str, target: str, min_split: int = 50) -> None:
    """Writes ``model``, which is saved as ``source``, once more under ``target`` with its forest collapsed."""
    model.write().save(target)
    original = spark.read.parquet(f"{_forest_folder(source)}/data")
    kept = collapse(read_nodes(spark, source), min_split)
    d = F.col("nodeData")
    split = F.when(F.col("left") < 0, F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                                               F.lit(-1).alias("numCategories"))).otherwise(d["split"])
    new = {"id": F.col("node"), "leftChild": F.col("left"), "rightChild": F.col("right"), "gain": F.col("gain"), "split": split}
    fields = original.schema["nodeData"].dataType.fieldNames()
    rows = kept.join(original.withColumnRenamed("treeID", "tree").withColumn("was", d["id"]), ["tree", "was"])
    rows = rows.select(F.col("tree").alias("treeID"), F.struct(*[new.get(f, d[f]).cast(original.schema["nodeData"].dataType[f].dataType).alias(f) for f in fields]).alias("nodeData"))
    folder = [s for s in _stage_names(spark, target) if s.startswith("1_")][0]
    rows.repartition("treeID").sortWithinPartitions("treeID", "nodeData.id").write.mode("overwrite").parquet(f"{target}/stages/{folder}/data")


def _stage_names(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stages")
    return [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]


def _goes_left(value: Column) -> Column:
    """NaN goes right at a numeric split, as it is not up to any threshold."""
    return F.when(F.col("categories").isNotNull(), F.array_contains("categories", value)).otherwise(value <= F.col("threshold"))


def evaluate(df: DataFrame, nodes: DataFrame, features, key_cols, depth: int, n_classes: int = 4) -> DataFrame:
    """The key columns with ``probs`` and ``prediction`` (first largest): every row walks every tree, one join per
    level; its leaves' class shares are averaged over the trees. ``depth``: the deepest level of any tree."""
    trees = nodes.agg(F.sort_array(F.collect_set("tree"))).scalar()  # one number a tree
    table = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), "left", "right", "feature", "threshold", "categories")
    inner = table.filter("left >= 0")
    now = df.select(*key_cols, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        step = now.join(inner, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("m")), "left")
        to = F.when(F.col("left").isNull(), F.col("node")).when(_goes_left(F.get("x", F.col("feature"))), F.col("left")).otherwise(F.col("right"))
        now = step.select(*key_cols, "x", "tree", to.alias("node"))
    leaves = nodes.select("tree", "node", "counts", F.aggregate("counts", F.lit(0.0), lambda s, x: s + x).alias("total"))
    share = [F.sum(F.get("counts", F.lit(k)) / F.col("total")) for k in range(n_classes)]
    out = now.join(leaves, ["tree", "node"]).groupBy(*key_cols).agg(*[s.alias(f"_p{k}") for k, s in enumerate(share)])
    whole = reduce(lambda a, b: a + b, [F.col(f"_p{k}") for k in range(n_classes)])
    out = out.withColumn("probs", F.array(*[F.col(f"_p{k}") / whole for k in range(n_classes)])).drop(*[f"_p{k}" for k in range(n_classes)])
    return out.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def tree_depths(nodes: DataFrame, limit: int) -> DataFrame:
    """(tree, nodes, leaves, depth), by walking down from the roots; ``limit``: no tree is deeper."""
    below = nodes.filter("left >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    level = nodes.filter("node = 0").select("tree", "node")
    deepest = level.select("tree", F.lit(0).alias("depth"))
    for d in range(1, limit + 1):
        level = level.join(below, ["tree", "node"]).select("tree", F.col("child").alias("node"))
        deepest = deepest.unionByName(level.select("tree", F.lit(d).alias("depth")))
    size = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves"))
    return size.join(deepest.groupBy("tree").agg(F.max("depth").alias("depth")), "tree")


def node_importance(nodes: DataFrame, features) -> DataFrame:
    """(feature, importance) of every feature: gain times rows summed over a tree's splits, as a share of the tree's
    sum, averaged over the trees; a tree without a split has no say."""
    split = nodes.filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)).alias("g"))
    split = split.withColumn("share", F.col("g") / F.sum("g").over(Window.partitionBy("tree")))  # a tree has one row a feature
    per = split.groupBy("feature").agg(F.sum("share").alias("s"))
    whole = per.agg(F.sum("s")).scalar()
    names = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(features))]).alias("feature"), F.array(*[F.lit(f) for f in features]).alias("name")))
    wide = nodes.sparkSession.range(1).select(names.alias("f")).select("f.feature", "f.name")
    return wide.join(per, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("s") / whole, F.lit(0.0)).alias("importance"))
