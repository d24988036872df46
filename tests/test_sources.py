import tempfile

from pyspark.sql import functions as F

from ridelens.operators import reshape
from ridelens.sources import io, payloads


def test_cp949_csv_roundtrip(spark, wide_df):
    # cp949 needs the legacy charset switch; read_wide_csv sets it
    path = tempfile.mkdtemp(prefix="ridelens-csv-") + "/wide"
    io.write_wide_csv(wide_df, path)
    raw = open(next(__import__("glob").iglob(path + "/*.csv")), "rb").read()
    assert "사용월".encode("cp949") in raw
    back = io.read_wide_csv(spark, path)
    assert sorted(back.columns) == sorted(wide_df.columns)
    a = sorted(tuple(r) for r in reshape.wide_to_long(back).collect())
    b = sorted(tuple(r) for r in reshape.wide_to_long(wide_df).collect())
    assert a == b


def test_try_cast_bad_counts(spark):
    # A malformed count becomes null instead of failing under ANSI mode
    path = tempfile.mkdtemp(prefix="ridelens-csv-") + "/bad.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("사용월,호선명,지하철역,04시-05시 승차인원,04시-05시 하차인원\n202510,2호선,강남,,x12\n")
    df = io.read_wide_csv(spark, path, encoding="utf-8")
    r = reshape.wide_to_long(df).first()
    assert (r.use_month, r.hour, r.boardings, r.alightings) == (202510, 4, None, None)


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "event_id long, payload string")


def test_flatten_ridership_codes(spark):
    # Success code or no RESULT is accepted; INFO-200 / errors are not
    row = '{"USE_DT":"20250101","LINE_NUM":"2호선","SUB_STA_NM":"강남","RIDE_PASGR_NUM":5,"ALIGHT_PASGR_NUM":6}'
    docs = _docs(spark, [
        '{"CardSubwayStatsNew":{"RESULT":{"CODE":"INFO-000"},"row":[%s,%s]}}' % (row, row),
        '{"CardSubwayStatsNew":{"row":[%s]}}' % row,
        '{"CardSubwayStatsNew":{"RESULT":{"CODE":"INFO-200"}}}',
        '{"CardSubwayStatsNew":{"RESULT":{"CODE":"ERROR-500"},"row":[%s]}}' % row,
        'not json',
    ])
    out = payloads.flatten_ridership(docs).collect()
    assert sorted((r.event_id, r.row_no) for r in out) == [(0, 0), (0, 1), (1, 0)]
    assert out[0].station == "강남" and out[0].ride == 5


def test_flatten_arrivals_missing_fields(spark):
    docs = _docs(spark, [
        '{"errorMessage":{"status":200},"realtimeArrivalList":[{"subwayId":"1002","statnNm":"강남"}]}',
        '{"errorMessage":{"status":500}}',
        '{"errorMessage":{"status":200},"realtimeArrivalList":[]}',
    ])
    out = payloads.flatten_arrivals(docs).collect()
    assert len(out) == 1 and out[0].line == "1002" and out[0].arvlMsg2 == "" and out[0].btrainSttus == ""


def test_flatten_hourly_first_row_only(spark):
    docs = _docs(spark, [
        '{"CardSubwayTime":{"row":[{"USE_MM":"202510","HR_8_GET_ON_NOPE":7,"HR_8_GET_OFF_NOPE":3},'
        '{"HR_8_GET_ON_NOPE":999}]}}',
        '{"RESULT":{"CODE":"INFO-200"}}',
    ])
    out = payloads.flatten_hourly(docs)
    assert out.count() == 24
    r = out.filter(F.col("hour") == 8).first()
    assert (r.ride_on, r.ride_off) == (7.0, 3.0)
    assert out.filter(F.col("hour") == 9).first().ride_on == 0.0


def test_flatten_forecast(spark):
    item = '{"category":"TMP","fcstValue":"12","nx":60,"ny":127}'
    docs = _docs(spark, [
        '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":[%s]}}}}' % item,
        '{"response":{"header":{"resultCode":"03"}}}',
    ])
    out = payloads.flatten_forecast(docs).collect()
    assert len(out) == 1 and out[0].fcstValue == "12" and out[0].nx == 60


def test_cp949_without_the_session_setting(spark, tmp_path):
    """Every two-byte character of the charset survives; the legacy setting stays off; files are split at line ends."""
    chars = []
    for lead in range(0x81, 0xFF):
        for trail in range(0x41, 0xFF):
            try:
                chars.append(bytes([lead, trail]).decode("cp949"))
            except UnicodeDecodeError:
                pass
    chars = [c for c in chars if len(c) == 1]
    assert len(chars) > 8000
    names = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)] + ['a"b,c', " x\t", "o\\k"]
    rows = [(202501 + i % 12, f"{i}호선", name, i) for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "use_month int, line string, station string, `04시-05시 승차인원` long")
    io.write_wide_csv(df, str(tmp_path / "csv"))
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert "지하철역".encode("cp949") in raw and names[0].encode("cp949") in raw
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        back = io.read_wide_csv(spark, str(tmp_path / "csv"))
        assert back.rdd.getNumPartitions() > 4
        got = sorted((r[0], r[1], r[2], r[3]) for r in back.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back.columns == df.columns and got == sorted(rows)


def test_unsafe_charsets_raise():
    import pytest

    io._check_charset("euc-kr")
    for encoding in ("gbk", "shift_jis", "big5"):
        with pytest.raises(ValueError, match="UTF-8"):
            io._check_charset(encoding)


def test_whole_numbers_are_exact(spark):
    from ridelens.functions.exprs import whole_number

    texts = ["9007199254740993", "9,007,199,254,740,993.0", "123.7", "1e3", "", None, "x", "-5", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(whole_number("t")).collect()] == [9007199254740993, 9007199254740993, None, 1000, None, None, None, -5, None]


KINDS = {
    "ridership": (payloads.RIDERSHIP, payloads.flatten_ridership), "arrivals": (payloads.ARRIVALS, payloads.flatten_arrivals),
    "forecast": (payloads.FORECAST, payloads.flatten_forecast), "hourly": (payloads.HOURLY, payloads.flatten_hourly)}


def test_rows_and_rejects_come_from_one_parse(spark):
    """Rows as from the flatteners, every other text a reject with its reason, counts observed; the texts are scanned once."""
    from ridelens.sources import fixtures as V

    src = V.v_json(spark, "/root/testdata/sf0.001")
    for name, (kind, flatten) in KINDS.items():
        texts = src.select("event_id", F.when(F.col("event_id") % 5 == 1, F.lit(None)).when(F.col("event_id") % 5 == 2, F.expr(f"left({name}_json, length({name}_json) - 1)"))
                           .when(F.col("event_id") % 25 == 3, F.lit(" [1]")).otherwise(F.concat(F.lit(" \n"), f"{name}_json")).alias("payload"))
        stage, counts = payloads.payload_stage(texts, kind)
        want, got = flatten(texts), payloads.stage_rows(stage, kind)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        rejects = payloads.stage_rejects(stage).collect()
        reasons = {r["event_id"]: r["reason"] for r in rejects}
        assert all(reasons[i] == "missing" for i in reasons if i % 5 == 1) and all(reasons[i] == "no json" for i in reasons if i % 5 == 2)
        assert all(reasons[i] == "no object" for i in reasons if i % 25 == 3)
        assert counts["inputs"] == texts.count() == counts["accepted"] + counts["rejected"] and counts["rejected"] == len(rejects)
        assert {r["event_id"]: r["outcome"] for r in payloads.outcomes(stage, kind).collect()} == {
            r["event_id"]: reasons.get(r["event_id"], "rows") for r in texts.select("event_id").collect()}
