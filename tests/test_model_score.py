from pyspark.sql import functions as F

from ridelens.operators import lookup, model as M, ranking, score, stats


def _labelled(spark, n=2000):
    # a separable problem: the label is the hour band
    rows = [(i, i % 24, float((i * 7) % 13), (i % 24) // 6) for i in range(n)]
    return spark.createDataFrame(rows, "id long, hour int, noise double, level int")


def test_rank_within_is_exact(spark):
    df = _labelled(spark, 3000)
    r = ranking.rank_within(df, "level", ["id"], num_partitions=7).collect()
    by = {}
    for x in r:
        by.setdefault(x.level, []).append((x.id, x.rank_in_group, x.group_size))
    for lv, items in by.items():
        items.sort()
        assert [k for _, k, _ in items] == list(range(1, len(items) + 1))
        assert {s for _, _, s in items} == {len(items)}


def test_stratified_split_partition_and_shares(spark):
    df = _labelled(spark, 2003)
    s = M.stratified_split(df, "level", ["id"])
    assert s.count() == 2003
    per = {r.level: (r.n, r.t) for r in s.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in per.values():
        assert abs(t - 0.2 * n) <= 0.5
    again = M.stratified_split(df, "level", ["id"]).filter("is_test").select("id").collect()
    assert sorted(again) == sorted(s.filter("is_test").select("id").collect())  # reproducible


def test_balance_classes(spark):
    df = _labelled(spark, 1000).filter((F.col("level") != 3) | (F.col("id") % 5 == 0))
    b = M.balance_classes(df, "level", ["id"])
    counts = {r.level: r["count"] for r in b.groupBy("level").count().collect()}
    assert len(set(counts.values())) == 1


def test_forest_invariants(spark):
    df = _labelled(spark, 1500)
    m = M.train(df, ["hour", "noise"], "level", numTrees=5, maxDepth=4)
    p = M.predict(m, df, "level")
    sums = [sum(r.probs) for r in p.select("probs").collect()]
    assert all(abs(s - 1) < 1e-9 for s in sums)
    imp = M.feature_importance(m, ["hour", "noise"]).collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9 and imp[0].feature == "hour"
    acc = M.accuracy(p, "level").first()[0]
    majority = max(r["count"] for r in df.groupBy("level").count().collect()) / 1500
    assert acc >= majority


def test_confusion_and_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 2), (3, 0)]
    pred = spark.createDataFrame(rows, "label int, prediction int")
    cm = {r.label: r for r in M.confusion(pred).collect()}
    assert sum(r.n_0 + r.n_1 + r.n_2 + r.n_3 for r in cm.values()) == len(rows)
    assert cm[0].pct_0 == 50.0
    rep = {r.row_label: r for r in M.class_report(pred).collect()}
    assert rep["0"].precision == 0.5 and rep["3"].recall == 0.0 and rep["accuracy"].f1 == 4 / 6
    w = M.weighted_f1(pred).first()[0]
    assert abs(w - rep["weighted avg"].f1) < 1e-12


def test_overfit_bands(spark):
    s = spark.createDataFrame([(0.9, 0.88), (0.9, 0.83), (0.9, 0.7)], "train_accuracy double, test_accuracy double")
    assert [r.verdict for r in M.overfit_report(s).collect()] == ["none", "slight", "severe"]


def test_scoring_profile_and_summary(spark):
    reqs = spark.createDataFrame([("왕십리", "2호선", 5, 1, False), ("가상1", "9호선", 0, None, None)],
                                 "station string, line string, dow int, month int, is_holiday boolean")
    ok, bad = score.split_requests(reqs.withColumn("hour", F.lit(8)), as_of_month=3)
    assert ok.count() == 2 and bad.count() == 0
    codes = spark.createDataFrame([("왕십리", "2호선", 3, 1, 0)],
                                  "station string, line string, station_idx int, line_idx int, is_transfer int")
    probs = spark.range(24).select(F.lit("왕십리").alias("station"), F.col("id").cast("int").alias("hour"),
                                   F.array(F.lit(0.9), F.lit(0.05), F.lit(0.04), F.lit(0.011)).alias("probs"))
    day = reqs.withColumn("month", F.coalesce("month", F.lit(3))).withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
    # the first request is made twice: its hours must not pile up
    day = day.withColumn("request_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    prof = score.hourly_profile(day, codes, probs, 2025)
    got = {(r.station, r.hour): r.level for r in prof.collect()}
    # transfer grade 4 and p3 > 0.01 in the rush -> 3; late night capped at 1; weekend 23h capped at 2
    assert got[("왕십리", 8)] == 3 and got[("왕십리", 3)] == 0 and got[("왕십리", 12)] == 1
    assert got[("가상1", 8)] == 3  # unknown station: uniform probabilities, p3 = 0.25 > 0.02
    both = score.profile_summary(prof).collect()
    assert len(both) == 4
    summ = {r.station: r for r in both if r.request_id == "a"}
    assert all(summ[r.station].most_congested_hours == r.most_congested_hours for r in both)
    assert summ["왕십리"].most_congested_hours == [7, 8, 9, 18, 19]
    assert len(summ["가상1"].least_congested_hours) == 5


def test_lookup(spark):
    df = spark.createDataFrame([("신촌", "2호선"), ("신림", "2호선"), ("강남", "2호선"), ("신촌", "경의-중앙선")],
                               "station string, line string")
    dim = stats.station_dim(df)
    s = lookup.search_stations(dim, line="2호선", pattern="^신").collect()
    assert [r.station for r in s] == ["신림", "신촌"] and s[0].total == 2
    assert [r.line for r in lookup.list_lines(dim).collect()] == ["2호선", "경의-중앙선"]
    assert lookup.list_lines(dim.limit(0)).count() == 9
    assert [(r.station, r.line) for r in lookup.suggest(dim, "신촌").collect()] == [("신촌", "2호선"), ("신촌", "경의-중앙선")]


def test_select_first_matches_brute_force(spark):
    from ridelens.operators.ranking import key_hash, select_first

    df = _labelled(spark, 5000)
    out = select_first(df, "level", ["id"], lambda n: F.round(F.lit(0.3) * n), seed=11, flag_col="sel",
                       bucket_bits=4)  # few buckets: many rows share the boundary bucket
    got = {r.id for r in out.filter("sel").collect()}
    assert out.count() == 5000
    rows = df.select("id", "level", key_hash(["id"], 11).alias("h")).collect()
    want = set()
    for lv in {r.level for r in rows}:
        grp = sorted((r.h, r.id) for r in rows if r.level == lv)
        want |= {i for _, i in grp[: int(0.3 * len(grp) + 0.5)]}
    assert got == want


def test_sample_rows_exact(spark):
    df = _labelled(spark, 3000)
    from ridelens.operators.ranking import key_hash

    s = M.sample_rows(df, 250, ["id"], seed=5)
    rows = df.select("id", key_hash(["id"], 5).alias("h")).collect()
    assert {r.id for r in s.collect()} == {i for _, i in sorted((r.h, r.id) for r in rows)[:250]}
    assert M.sample_rows(df, 10_000, ["id"]).count() == 3000


def test_hourly_profile_validates_like_single_requests(spark):
    # The 24-hour path applies the same range checks
    reqs = spark.createDataFrame([("강남", "2호선", 9, 1, False), ("강남", "2호선", 2, 13, False),
                                  ("강남", "2호선", 2, None, None)],
                                 "station string, line string, dow int, month int, is_holiday boolean")
    codes = spark.createDataFrame([("강남", "2호선", 0, 0, 0)],
                                  "station string, line string, station_idx int, line_idx int, is_transfer int")
    probs = spark.range(24).select(F.lit("강남").alias("station"), F.col("id").cast("int").alias("hour"),
                                   F.array(*[F.lit(0.25)] * 4).alias("probs"))
    prof = score.hourly_profile(reqs, codes, probs, 2025, as_of_month=6).collect()
    assert len(prof) == 24 and {r.month for r in prof} == {6} and {r.dow for r in prof} == {2}


def test_rank_within_matches_sorting(spark):
    from ridelens.operators import ranking

    df = _labelled(spark, 2500)
    got = {(r.id, r.rank_in_group, r.group_size) for r in ranking.rank_within(df, "level", ["noise", "id"], num_partitions=5).collect()}
    want, by = set(), {}
    for r in df.collect():
        by.setdefault(r.level, []).append((r.noise, r.id))
    for rows in by.values():
        want |= {(i, k + 1, len(rows)) for k, (_, i) in enumerate(sorted(rows))}
    assert got == want


def test_transfer_fallback_counts_lines(spark):
    # K4: without is_transfer in the feature table, more than one line per station
    feats = spark.createDataFrame([("a", "1", 0, 0), ("a", "2", 0, 1), ("b", "1", 1, 0)], "station string, line string, station_idx int, line_idx int")
    got = {(r.station, r.line): r.is_transfer for r in score.code_table(feats).collect()}
    assert got == {("a", "1"): 1, ("a", "2"): 1, ("b", "1"): 0}


def test_metrics_take_one_aggregate(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (3, 3)], "label int, prediction int")
    for out in (M.class_report(df), M.weighted_f1(df)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_line_code_fallback_only_for_known_pairs(spark):
    # K4: without a line-code column the fixed line map is used, and only for pairs seen in the data
    reqs = spark.createDataFrame([("강남", "9호선", 8, 1, 1, False), ("신촌", "공항철도", 8, 1, 1, False)],
                                 "station string, line string, hour int, dow int, month int, is_holiday boolean")
    codes = spark.createDataFrame([("강남", "9호선", 4)], "station string, line string, station_idx int")
    out = {r.station: (r.station_idx, r.line_idx) for r in score.request_features(reqs, codes, 2025).collect()}
    assert out == {"강남": (4, 8), "신촌": (0, 0)}
