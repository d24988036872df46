"""Landed API payloads (JSON text) -> rows.

The source project calls HTTP APIs and turns each response into a pandas
frame. Here responses are assumed to be landed as text (one document per
row, any id columns alongside); each flattener is ``from_json`` with an
explicit schema plus ``posexplode`` - stateless and row-local, so the same
function runs on a batch table or on a stream.

Where rejects matter too, ``payload_stage`` parses every text once, into a
written stage with a VARIANT and the reason of a rejection; ``stage_rows`` and
``stage_rejects`` read that stage, and rows plus rejects are all inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions.exprs import whole_number
from ridelens.session import checkpoint_stage

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RESULT = _struct(CODE=S, MESSAGE=S)

# counts are read as text: numbers with a point and quoted numbers occur
RIDERSHIP_ROW = _struct(USE_DT=S, LINE_NUM=S, SUB_STA_NM=S, RIDE_PASGR_NUM=S, ALIGHT_PASGR_NUM=S, WORK_DT=S)
RIDERSHIP_SCHEMA = _struct(
    CardSubwayStatsNew=_struct(list_total_count=L, RESULT=RESULT, row=T.ArrayType(RIDERSHIP_ROW))
)

ARRIVAL_ITEM = _struct(subwayId=S, statnNm=S, updnLine=S, trainLineNm=S, arvlMsg2=S, arvlMsg3=S,
                       btrainSttus=S, arvlCd=S)
ARRIVAL_FIELDS = ["subwayId", "statnNm", "updnLine", "trainLineNm", "arvlMsg2", "arvlMsg3", "btrainSttus", "arvlCd"]
ARRIVALS_SCHEMA = _struct(
    errorMessage=_struct(status=L, code=S, message=S),
    realtimeArrivalList=T.ArrayType(ARRIVAL_ITEM),
)

FORECAST_ITEM = _struct(baseDate=S, baseTime=S, category=S, fcstDate=S, fcstTime=S, fcstValue=S, nx=L, ny=L)
FORECAST_SCHEMA = _struct(
    response=_struct(
        header=_struct(resultCode=S, resultMsg=S),
        body=_struct(dataType=S, items=_struct(item=T.ArrayType(FORECAST_ITEM)), totalCount=L),
    )
)

HOURLY_ROW = T.StructType(
    [T.StructField("USE_MM", S), T.StructField("SBWY_ROUT_LN_NM", S), T.StructField("STTN", S)]
    + [T.StructField(f"HR_{h}_GET_{side}_NOPE", D) for h in range(24) for side in ("ON", "OFF")]
)
HOURLY_SCHEMA = _struct(
    RESULT=RESULT,
    CardSubwayTime=_struct(list_total_count=L, RESULT=RESULT, row=T.ArrayType(HOURLY_ROW)),
)

# --- FIXED VALUES: API status codes ----------------------------------------------
OK_CODE = "INFO-000"          # success
ARRIVALS_OK_STATUS = 200
FORECAST_OK_CODE = "00"


def unparsable(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """The payloads that are no JSON object; every flattener leaves them out, so a caller can report them."""
    bad = F.col(payload_col).isNull() | F.try_parse_json(F.col(payload_col)).isNull() | ~F.trim(F.col(payload_col)).startswith("{")
    return df.filter(bad).select(*id_cols, payload_col)


def _code_ok(result: Column) -> Column:
    """The collector's rule: the success code, or no RESULT at all."""
    return result.isNull() | (result.getField("CODE") == OK_CODE)


@dataclass(frozen=True)
class Kind:
    """A kind of payload: its schema, the part that holds the answer, whether that part is one (its status), the list
    inside it, and how parsed rows (id columns, ``_p``: the part) become rows."""

    schema: T.StructType
    part: Callable[[Column], Column]
    accepted: Callable[[Column], Column]
    items: Callable[[Column], Column]
    rows: Callable[[DataFrame, list], DataFrame]

    def flatten(self, df: DataFrame, payload_col: str, id_cols) -> DataFrame:
        p = self.part(F.from_json(F.col(payload_col), self.schema))
        parsed = df.select(*id_cols, p.alias("_p")).filter(F.col("_p").isNotNull() & self.accepted(F.col("_p")))
        return self.rows(parsed, list(id_cols))


def _ridership_rows(parsed: DataFrame, id_cols: list) -> DataFrame:
    rows = parsed.select(*id_cols, F.posexplode(F.col("_p.row")).alias("row_no", "_r"))
    return rows.select(
        *id_cols, F.col("row_no").cast("int").alias("row_no"),
        F.col("_r.USE_DT").alias("use_dt"), F.col("_r.LINE_NUM").alias("line"),
        F.col("_r.SUB_STA_NM").alias("station"), whole_number(F.col("_r.RIDE_PASGR_NUM")).alias("ride"),
        whole_number(F.col("_r.ALIGHT_PASGR_NUM")).alias("alight"), F.col("_r.WORK_DT").alias("work_dt"),
    )


def _arrival_rows(parsed: DataFrame, id_cols: list) -> DataFrame:
    items = parsed.select(*id_cols, F.posexplode(F.col("_p.realtimeArrivalList")).alias("item_no", "_i"))
    names = {"subwayId": "line", "statnNm": "station"}
    return items.select(
        *id_cols, F.col("item_no").cast("int").alias("item_no"),
        *[F.coalesce(F.col(f"_i.{f}"), F.lit("")).alias(names.get(f, f)) for f in ARRIVAL_FIELDS],
    )


def _forecast_rows(parsed: DataFrame, id_cols: list) -> DataFrame:
    items = parsed.select(*id_cols, F.posexplode(F.col("_p.body.items.item")).alias("item_no", "_i"))
    return items.select(
        *id_cols, F.col("item_no").cast("int").alias("item_no"),
        *[F.col(f"_i.{f}").alias(f) for f in FORECAST_ITEM.fieldNames()],
    )


def _hourly_arrays(parsed: DataFrame, id_cols: list) -> DataFrame:
    first = F.try_element_at(F.col("_p.row"), F.lit(1))  # null for an empty list
    parsed = parsed.select(*id_cols, first.alias("_r")).filter(F.col("_r").isNotNull())
    hours = F.array(*[
        F.struct(
            F.lit(h).alias("hour"),
            F.coalesce(F.col(f"_r.HR_{h}_GET_ON_NOPE"), F.lit(0.0)).alias("ride_on"),
            F.coalesce(F.col(f"_r.HR_{h}_GET_OFF_NOPE"), F.lit(0.0)).alias("ride_off"),
        )
        for h in range(24)
    ])
    return parsed.select(
        *id_cols, F.col("_r.USE_MM").alias("use_month_text"), F.col("_r.SBWY_ROUT_LN_NM").alias("line"),
        F.col("_r.STTN").alias("station"), hours.alias("hours"),
    )


def _hourly_rows(parsed: DataFrame, id_cols: list) -> DataFrame:
    return _hourly_arrays(parsed, id_cols).select(*id_cols, "use_month_text", "line", "station", F.inline("hours"))


RIDERSHIP = Kind(RIDERSHIP_SCHEMA, lambda p: p.getField("CardSubwayStatsNew"), lambda p: _code_ok(p.getField("RESULT")),
                 lambda p: p.getField("row"), _ridership_rows)
ARRIVALS = Kind(ARRIVALS_SCHEMA, lambda p: p, lambda p: p.getField("errorMessage").getField("status") == ARRIVALS_OK_STATUS,
                lambda p: p.getField("realtimeArrivalList"), _arrival_rows)
FORECAST = Kind(FORECAST_SCHEMA, lambda p: p.getField("response"), lambda p: p.getField("header").getField("resultCode") == FORECAST_OK_CODE,
                lambda p: p.getField("body").getField("items").getField("item"), _forecast_rows)
HOURLY = Kind(HOURLY_SCHEMA, lambda p: p.getField("CardSubwayTime"), lambda p: _code_ok(p.getField("RESULT")),
              lambda p: p.getField("row"), _hourly_rows)


def flatten_ridership(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """Daily ridership payloads -> one row per ``row`` item. A payload is
    kept when its RESULT code is the success code or RESULT is absent (the
    collector's rule); a missing or empty ``row`` yields no rows."""
    return RIDERSHIP.flatten(df, payload_col, id_cols)


def flatten_arrivals(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """Live-arrival payloads with status 200 -> one row per arrival with the
    eight fields; a missing field becomes ''."""
    return ARRIVALS.flatten(df, payload_col, id_cols)


def flatten_forecast(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """Forecast payloads with result code '00' -> one row per item."""
    return FORECAST.flatten(df, payload_col, id_cols)


def hourly_arrays(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """Hourly ridership payloads -> one row each, from the FIRST ``row`` only, with ``hours``: 24 structs (hour,
    ride_on, ride_off), a missing hour key counting 0. A payload whose RESULT (top level or inside) carries a code
    other than success, or whose list is missing or empty, is dropped (the collector's rule)."""
    p = HOURLY.part(F.from_json(F.col(payload_col), HOURLY.schema))
    parsed = df.select(*id_cols, p.alias("_p")).filter(F.col("_p").isNotNull() & HOURLY.accepted(F.col("_p")))
    return _hourly_arrays(parsed, list(id_cols))


def flatten_hourly(df: DataFrame, payload_col: str = "payload", id_cols=("event_id",)) -> DataFrame:
    """Hourly ridership payloads -> 24 rows (hour, ride_on, ride_off) each."""
    return HOURLY.flatten(df, payload_col, id_cols)


# --- rows and rejects from one parse ------------------------------------------------
MISSING, NO_JSON, NO_OBJECT, REFUSED = "missing", "no json", "no object", "refused"


def _typed(kind: Kind) -> Column:
    """The typed part of the stage's VARIANT; a field that does not fit its type is null."""
    return kind.part(F.try_variant_get("parsed", "$", kind.schema.simpleString()))


def payload_stage(df: DataFrame, kind: Kind, payload_col: str = "payload", id_cols=("event_id",)) -> tuple[DataFrame, dict]:
    """(stage, counts). The stage is written: the id columns, ``parsed`` (a VARIANT, null unless the text is a JSON
    object), ``reason`` (null where rows come of it, else missing, no json, no object, refused) and the rejected text.
    The counts (inputs, accepted, rejected) are observed while it is written: one pass over the texts."""
    text = F.col("_t")
    is_object = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    typed = kind.part(F.try_variant_get("_v", "$", kind.schema.simpleString()))
    reason = (F.when(text.isNull(), MISSING).when(F.col("_v").isNull(), NO_JSON).when(~is_object, NO_OBJECT)
              .when(F.coalesce(typed.isNotNull() & kind.accepted(typed), F.lit(False)), F.lit(None)).otherwise(REFUSED))
    parsed = df.select(*id_cols, F.col(payload_col).alias("_t"), F.try_parse_json(F.col(payload_col)).alias("_v")).withColumn("reason", reason)
    counts = Observation()
    parsed = parsed.observe(counts, F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("reason").isNull()).alias("accepted"),
                            F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    stage = checkpoint_stage(parsed.select(*id_cols, F.when(F.col("reason").isNull(), F.col("_v")).alias("parsed"), "reason",
                                           F.when(F.col("reason").isNotNull(), F.col("_t")).alias("rejected_text")), "payloads")
    return stage, counts.get


def stage_rows(stage: DataFrame, kind: Kind, id_cols=("event_id",)) -> DataFrame:
    """What the kind's flattener gives, from the stage."""
    return kind.rows(stage.filter("reason is null").select(*id_cols, _typed(kind).alias("_p")), list(id_cols))


def stage_rejects(stage: DataFrame, id_cols=("event_id",)) -> DataFrame:
    """(id columns, reason, rejected_text) of every input without rows."""
    return stage.filter("reason is not null").select(*id_cols, "reason", "rejected_text")


def outcomes(stage: DataFrame, kind: Kind, id_cols=("event_id",)) -> DataFrame:
    """(id columns, outcome, n_items): ``rows`` and the length of the list, or the reason and 0, for every input."""
    n = F.when(F.col("reason").isNull(), F.coalesce(F.size(kind.items(_typed(kind))), F.lit(0))).otherwise(F.lit(0))
    return stage.select(*id_cols, F.coalesce("reason", F.lit("rows")).alias("outcome"), F.greatest(n, F.lit(0)).cast("int").alias("n_items"))
