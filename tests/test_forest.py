"""The forest's node table: smallest split, plain evaluation, importances, versions, learning curve."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.operators import forest as N
from ridelens.operators import model as M
from ridelens.sources import versions

FEATURES = ["a", "b", "c", "noise"]
SMALL = {"numTrees": 7, "maxDepth": 9, "minInstancesPerNode": 5}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        a, b, c = rng.random(), rng.randrange(6), rng.gauss(0, 1)
        level = min(3, max(0, int(4 * a + 0.5 * b - 1 + rng.gauss(0, 0.5))))
        rows.append((i, level, a, float(b), c, rng.random()))
    return spark.createDataFrame(rows, "id long, level int, a double, b double, c double, noise double")


@pytest.fixture(scope="module")
def fitted(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("forest"))
    model = M.fit_forest(data, FEATURES, path=path, min_split=50, **SMALL)
    return path, model


def walk(nodes, tree, x):
    """Plain recursion down one tree of {(tree, node): row}."""
    node = nodes[tree, 0]
    while node["left"] >= 0:
        value = x[node["feature"]]
        node = nodes[tree, node["left"] if value <= node["threshold"] else node["right"]]
    total = sum(node["counts"])
    return [v / total for v in node["counts"]]


def test_no_split_node_is_small(spark, fitted):
    path, _ = fitted
    before, after = N.read_nodes(spark, f"{path}/fitted").collect(), N.read_nodes(spark, f"{path}/collapsed").collect()
    assert min(r["n"] for r in before if r["left"] >= 0) < 50  # something to do
    assert all(r["n"] >= 50 for r in after if r["left"] >= 0) and all(r["n"] >= 5 for r in after)
    assert {r["tree"] for r in after} == set(range(7))
    for t in range(7):
        ids = sorted(r["node"] for r in after if r["tree"] == t)
        assert ids == list(range(len(ids)))  # numbered without gaps
        assert all(r["left"] > r["node"] and r["right"] > r["left"] for r in after if r["tree"] == t and r["left"] >= 0)


def test_collapse_keeps_what_top_down_growth_would(spark, fitted):
    path, _ = fitted
    before = {(r["tree"], r["node"]): r for r in N.read_nodes(spark, f"{path}/fitted").collect()}
    kept = set()

    def grow(t, i):
        kept.add((t, i))
        r = before[t, i]
        if r["left"] >= 0 and r["n"] >= 50:
            grow(t, r["left"])
            grow(t, r["right"])

    for t in range(7):
        grow(t, 0)
    got = N.collapse(N.read_nodes(spark, f"{path}/fitted"), 50).collect()
    assert {(r["tree"], r["was"]) for r in got} == kept
    assert all(r["counts"] == before[r["tree"], r["was"]]["counts"] for r in got)


def test_predictions_equal_plain_walks_and_the_relational_evaluation(spark, data, fitted):
    path, model = fitted
    nodes = {(r["tree"], r["node"]): r.asDict() for r in N.read_nodes(spark, f"{path}/collapsed").collect()}
    scored = {r["id"]: r for r in M.predict(model, data).collect()}
    depth = max(r["depth"] for r in N.tree_depths(N.read_nodes(spark, f"{path}/collapsed"), 9).collect())
    walked = {r["id"]: r for r in N.evaluate(data, N.read_nodes(spark, f"{path}/collapsed"), FEATURES, ["id"], depth).collect()}
    for r in data.collect():
        plain = np.mean([walk(nodes, t, [r[c] for c in FEATURES]) for t in range(7)], axis=0)
        assert np.allclose(scored[r["id"]]["probs"], plain, atol=1e-12) and np.allclose(walked[r["id"]]["probs"], plain, atol=1e-12)
        assert scored[r["id"]]["prediction"] == walked[r["id"]]["prediction"] == int(np.argmax(scored[r["id"]]["probs"]))


def test_importances_equal_the_node_table(spark, fitted):
    path, model = fitted
    lib = {r["feature"]: r["importance"] for r in M.feature_importance(model, FEATURES).collect()}
    own = {r["feature"]: r["importance"] for r in N.node_importance(N.read_nodes(spark, f"{path}/collapsed"), FEATURES).collect()}
    assert set(own) == set(FEATURES) and abs(sum(own.values()) - 1) < 1e-9
    assert all(abs(lib[c] - own[c]) < 1e-9 for c in FEATURES)
    shuffled = N.node_importance(N.read_nodes(spark, f"{path}/collapsed"), [*FEATURES, "unused"]).collect()
    assert {r["feature"]: r["importance"] for r in shuffled}["unused"] == 0.0


def test_single_node_trees(spark, data, tmp_path):
    model = M.fit_forest(data.limit(40), FEATURES, path=str(tmp_path), min_split=1000, numTrees=2, maxDepth=4, minInstancesPerNode=2)
    nodes = N.read_nodes(spark, f"{tmp_path}/collapsed")
    assert nodes.count() == 2 and nodes.filter("left >= 0").count() == 0
    assert {r["importance"] for r in N.node_importance(nodes, FEATURES).collect()} == {0.0}
    assert len({tuple(r["probs"]) for r in M.predict(model, data.limit(40)).collect()}) == 1


def test_load_gets_a_whole_version(spark, fitted, tmp_path):
    path, model = fitted
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, folder)
    first = M.save_model(model, folder, FEATURES, {"test_f1": 0.5}, note="first")
    # a writer that died before publishing, and one that left an empty file aside
    model.write().save(f"{folder}/v-dead/model")
    (tmp_path / "_publishing-dead").write_text("")
    assert M.load_model(spark, folder)[1].first()["note"] == "first"
    second = M.save_model(model, folder, FEATURES, {"test_f1": 0.5}, note="second")
    assert M.load_model(spark, folder)[1].first()["note"] == "second" and versions.latest(spark, folder) == second
    assert M.load_model(spark, folder, first)[1].first()["note"] == "first"  # a reader may still hold it
    M.save_model(model, folder, FEATURES, {"test_f1": 0.5}, note="third")
    assert versions.drop_old(spark, folder, keep=2) == [first]
    assert M.load_model(spark, folder)[1].first()["note"] == "third" and M.load_model(spark, folder, second)[1].count() == 1


def test_input_stamp_follows_the_files(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    one = versions.input_stamp(spark, [str(tmp_path)])
    assert one == versions.input_stamp(spark, [str(tmp_path)])
    (tmp_path / "y").write_text("1")
    assert one != versions.input_stamp(spark, [str(tmp_path)])


def test_bins_keep_few_values_apart_and_cut_many_evenly(spark, data):
    edges = M.bin_edges(data, ["a", "b"], bins=8)
    assert edges["b"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(edges["a"]) == 7
    out = M.with_bins(data, edges)
    assert out.columns == data.columns and out.select("b").distinct().count() == 6
    sizes = [r["n"] for r in out.groupBy("a").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2


def test_learning_curve_scores_equal_separate_fits(spark, data):
    got = M.learning_curve(data, FEATURES, "level", ["id"], steps=3, min_split=50, bins=16, **SMALL).collect()
    # the same folds, sizes and rows by hand
    from ridelens.operators.ranking import hash_order

    order = {r["id"]: (r["h"], r["id"]) for r in data.select("id", hash_order(["id"], 42)[0].alias("h")).collect()}
    rows = {r["id"]: r for r in M.with_bins(data, M.bin_edges(data, FEATURES, 16)).collect()}
    fold = {}
    for level in range(4):
        for k, i in enumerate(sorted((i for i in rows if rows[i]["level"] == level), key=order.get)):
            fold[i] = k % 3
    smallest = min(sum(f != k for f in fold.values()) for k in range(3))
    assert [r["train_size"] for r in got] == [int(smallest * k / 3) for k in (1, 2, 3)]
    ids = [i for i in sorted(rows, key=order.get) if fold[i] != 0][: got[0]["train_size"]]
    part = spark.createDataFrame([rows[i] for i in ids], data.schema)
    held = spark.createDataFrame([rows[i] for i in rows if fold[i] == 0], data.schema)
    model = M.fit_forest(part, FEATURES, **SMALL)
    scores = [M.accuracy(M.predict(model, x), "level").first()[0] for x in (part, held)]
    for r in got:
        assert 0 < r["val_mean"] <= r["train_mean"] + 0.1 and r["train_std"] >= 0
    # the fold's own scores lie around the mean of three
    assert abs(scores[0] - got[0]["train_mean"]) <= 3 * got[0]["train_std"] + 0.05
    assert abs(scores[1] - got[0]["val_mean"]) <= 3 * got[0]["val_std"] + 0.05


def test_learning_curve_does_not_grow_with_the_table(spark, data):
    more = data.unionByName(data.withColumn("id", F.col("id") + 1200))
    small, large = (M.learning_curve(x, FEATURES, "level", ["id"], steps=1, max_rows=300, bins=8, **SMALL).collect() for x in (data, more))
    # three folds of four classes: at most four rows more in one fold than in another
    assert all(len(c) == 1 and 196 <= c[0]["train_size"] <= 200 for c in (small, large))


def test_learning_curve_of_nothing(spark, data):
    assert M.learning_curve(data.limit(0), FEATURES, "level", ["id"], **SMALL).count() == 0


def test_cached_node_ids_give_the_same_forest(spark, data):
    a, b = (M.train(data, FEATURES, cacheNodeIds=c, **SMALL).stages[-1].toDebugString.split("\n", 1)[1] for c in (True, False))
    assert a == b
