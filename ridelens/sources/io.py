"""File sources and sinks.

* ``read_wide_csv``: the raw wide ridership CSV (Korean headers, cp949).
* ``read_stage`` / ``write_stage``: stage tables. Parquet is the default
  between stages (columnar, predicate and column pruning, partitioned by
  month); CSV with the source's Korean headers and a UTF-8 BOM-free layout
  is kept for the edges.

Spark 4 reads CSV in a short list of charsets, without cp949 and EUC-KR. Files in
such a charset are read as ISO-8859-1, which keeps every byte as one character:
large files are split at line ends and parsed by Spark as ever, since no two-byte
character has the byte of a comma, quote, backslash or line end (checked for the
charset). Only text columns are then decoded, one distinct value at a time.
Counts are digits in any charset. No session setting is touched.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens import schemas
from ridelens.functions.exprs import whole_number

_STANDARD_CHARSETS = {"utf-8", "utf8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


# Spark's CSV writer trims values by default; the source's files keep blanks
# (names are trimmed later, on purpose, by normalize_names)
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


_BYTES = "iso-8859-1"
_SYNTAX = b',"\\\r\n'


@lru_cache
def _check_charset(encoding: str) -> None:
    """Raises unless CSV syntax can be read byte by byte: ASCII is itself, and no character of two bytes has a syntax byte."""
    ascii_ = bytes(range(128))
    safe = ascii_.decode(encoding) == ascii_.decode("ascii")
    for lead in range(128, 256):
        for byte in _SYNTAX:
            try:
                safe &= len(bytes([lead, byte]).decode(encoding)) == 2
            except UnicodeDecodeError:
                pass  # no character at all
    if not safe:
        raise ValueError(f"{encoding}: a character may contain a byte of the CSV syntax; convert the files to UTF-8 first")


def _recoder(change):
    """An Arrow step that changes texts, each distinct value once."""

    @F.pandas_udf("string")
    def recode(values: pd.Series) -> pd.Series:
        return values.map({v: change(v) for v in values.dropna().unique()})

    return recode


def _decoder(encoding: str):
    return lambda v: v.encode(_BYTES).decode(encoding)


def _encoder(encoding: str):
    return lambda v: v.encode(encoding).decode(_BYTES)


def to_library_names(df: DataFrame) -> DataFrame:
    """Rename source (Korean) headers to library column names."""
    return df.withColumnsRenamed({c: schemas.SOURCE_NAMES[c] for c in df.columns if c in schemas.SOURCE_NAMES})


def to_source_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: schemas.LIBRARY_NAMES[c] for c in df.columns if c in schemas.LIBRARY_NAMES})


def read_wide_csv(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """Raw wide CSV -> (use_month int, line, station, 48 hour-slot counts).

    Everything is read as text; counts may be written ``123``, ``123.0`` or
    ``1,234``. A malformed count becomes null (and is then counted by the null
    profile) instead of failing the job under ANSI mode."""
    plain = encoding.lower() in _STANDARD_CHARSETS
    if not plain:
        _check_charset(encoding)
    raw = spark.read.option("header", True).option("encoding", encoding if plain else _BYTES).option("inferSchema", False).csv(path)
    decode = None if plain else _recoder(_decoder(encoding))
    cols = []
    for c in raw.columns:
        header = c if plain else _decoder(encoding)(c)
        value, name = F.col(f"`{c}`"), schemas.SOURCE_NAMES.get(header, header)
        if name == "use_month":
            cols.append(whole_number(value).try_cast(T.IntegerType()).alias(name))
        elif schemas.BOARDING_MARK in header or schemas.ALIGHTING_MARK in header:
            cols.append(whole_number(value).alias(header))
        else:
            cols.append((value if plain else decode(value)).alias(name))
    return raw.select(*cols)


def write_wide_csv(df: DataFrame, path: str, encoding: str = "cp949", mode: str = "overwrite") -> None:
    """Write a wide table in the source layout (Korean id headers). A character that the charset lacks fails the job;
    the count columns are digits."""
    out = to_source_names(df)
    plain = encoding.lower() in _STANDARD_CHARSETS
    if not plain:
        _check_charset(encoding)
        encode = _recoder(_encoder(encoding))
        texts = [c for c, t in out.dtypes if t == "string" and not (schemas.BOARDING_MARK in c or schemas.ALIGHTING_MARK in c)]
        out = out.withColumns({c: encode(F.col(f"`{c}`")) for c in texts}).toDF(*[_encoder(encoding)(c) for c in out.columns])
    (out.write.mode(mode).option("header", True).option("encoding", encoding if plain else _BYTES)
     .options(**_KEEP_SPACES).csv(path))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite",
                source_names: bool = False) -> None:
    """Write a stage table; CSV gets a header row (optionally the source's
    Korean names), parquet keeps library names and types."""
    out = to_source_names(df) if source_names else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*[schemas.LIBRARY_NAMES.get(c, c) if source_names else c for c in partition_by])
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").options(**_KEEP_SPACES).csv(path)
    else:
        w.parquet(path)


def _typed(field: T.StructField, have: str):
    """Text counts may be written with a point or thousands marks: read the number first."""
    c = F.col(f"`{field.name}`")
    if have == "string" and isinstance(field.dataType, (T.IntegerType, T.LongType)):
        c = whole_number(c)
    return c.try_cast(field.dataType)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read a stage table back with library names; CSV text columns are typed
    by ``schema`` when given, and ``use_date`` is parsed to DATE."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        df = spark.read.parquet(path)
    df = to_library_names(df)
    if schema is not None:
        df = df.select(*[
            _typed(f, dict(df.dtypes)[f.name]).alias(f.name) if f.name in df.columns else
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ])
    if "use_date" in df.columns and dict(df.dtypes)["use_date"] != "date":
        df = df.withColumn("use_date", F.to_date("use_date"))
    return df
