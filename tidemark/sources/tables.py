"""Sources and sinks: all-text CSV folders, inventories, projected scans, Parquet and JSON sinks, fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract import MISSING_TOKENS
from tidemark.functions.scalars import norm_id, serial_day
from tidemark.operators.checks import ContractError
from tidemark.session import ensure_checkpoint_dir


# windows-1252 differs from ISO-8859-1 in the bytes 0x80-0x9f only (five of them undefined); the CSV
# reader offers just the latter, so those characters are mapped afterwards
_C1 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_C1_LATIN = "".join(chr(b) for b in _C1)
_C1_WINDOWS = bytes(_C1).decode("cp1252")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_text_table(
    spark: SparkSession, path: str, columns: Sequence[str], *, entity: str | None = None, dates: Sequence[str] = (),
    encoding: str | None = "UTF-8", strict: bool = True,
) -> DataFrame:
    """CSV with every column as text and no token read as missing.

    Adds ``entity`` (normalised id) and ``<date>__serial`` per date column. ``strict`` stops on a
    malformed line. The header must name the columns in order. Without an ``encoding`` each file is UTF-8 where all of it
    decodes, else windows-1252; column names are ASCII then.
    """
    if encoding not in (None, "UTF-8", "windows-1252"):
        raise ValueError("encoding must be UTF-8 or windows-1252")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", "UTF-8" if encoding == "UTF-8" else "iso-8859-1")
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .option("escape", '"')
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .csv(path)
    )
    windows = lambda c: F.translate(F.col(c), _C1_LATIN, _C1_WINDOWS)
    if encoding == "UTF-8":
        text = F.col
    elif encoding:
        text = windows
    else:  # a character of ISO-8859-1 is a byte, and separators and quotes are ASCII in both encodings
        raw = raw.select(*columns, F.col("_metadata.file_path").alias("__file"))
        raw = raw.join(windows_files(spark, path).select(F.col("file").alias("__file"), F.lit(True).alias("__windows")), "__file", "left")
        text = lambda c: F.when(F.col("__windows"), windows(c)).otherwise(F.encode(c, "ISO-8859-1").cast("string"))
    out = raw.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in columns])
    extra = [serial_day(c).alias(f"{c}__serial") for c in dates]
    if entity:
        extra.append(norm_id(entity).alias("entity"))
    return out.select("*", *extra)


def write_text_table(df: DataFrame, path: str, *, encoding: str = "UTF-8") -> None:
    """CSV files with a header, added to ``path``; all columns must be text. windows-1252 has no other characters than its own."""
    windows = encoding == "windows-1252"
    out = df.select(*[F.translate(F.col(c), _C1_WINDOWS, _C1_LATIN).alias(c) if windows else F.col(c) for c in df.columns])
    out.write.mode("append").option("header", True).option("emptyValue", "").option("escape", '"').option("encoding", "iso-8859-1" if windows else "UTF-8").csv(path)


def windows_files(spark: SparkSession, path: str) -> DataFrame:
    """(file): the files of a table folder with bytes that are not UTF-8. The bytes are tested in the executors."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(~F.is_valid_utf8("value")).select("file").distinct()


def read_text_folder(spark: SparkSession, tables: Mapping[str, Mapping], folder: str) -> dict[str, DataFrame]:
    """All tables of a folder: name -> {columns, entity, dates}; each file is decoded by its own encoding."""
    return {name: read_text_table(spark, f"{folder}/{name}", encoding=None, **spec) for name, spec in tables.items()}


def inventory(df: DataFrame, *, entity: str, dates: Mapping[str, Column], record_key: str | None = None) -> DataFrame:
    """(measure, n): rows, entities, blank ids, per date missing / parsed / failed, excess rows per record key
    and excess exact duplicates. ``dates`` maps text column -> parsed expression."""
    blank = F.coalesce(F.trim(F.col(entity).cast("string")), F.lit("")) == ""
    aggs = {
        "rows": F.count("*"),
        "entities": F.countDistinct(F.when(~blank, F.col(entity))),
        "blank_entity_rows": F.count_if(blank),
    }
    for c, parsed in dates.items():
        missing = F.coalesce(F.trim(F.col(c)), F.lit("")).isin(list(MISSING_TOKENS))
        aggs[f"{c}_missing"] = F.count_if(missing)
        aggs[f"{c}_parsed"] = F.count_if(~missing & parsed.isNotNull())
        aggs[f"{c}_parse_failure"] = F.count_if(~missing & parsed.isNull())
    one = df.agg(*[e.alias(n) for n, e in aggs.items()])
    names = list(aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in names])
    out = one.select(F.explode(rows).alias("r")).select("r.*")

    def excess(cols: Sequence[str], measure: str, where: Column) -> DataFrame:
        g = df.where(where).groupBy(*cols).agg(F.count("*").alias("c"))
        return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit(measure).alias("measure"), "n")

    out = out.unionByName(excess(df.columns, "exact_duplicate_excess_rows", F.lit(True)))
    if record_key:
        ok = F.coalesce(F.trim(F.col(record_key).cast("string")), F.lit("")) != ""
        out = out.unionByName(excess([record_key], "record_key_excess_rows", ok))
    return out


def scan(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None,
         keys: DataFrame | None = None) -> DataFrame:
    """Projected Parquet scan; the predicate reaches the reader, a key table becomes a left-semi join."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    df = df.select(*columns)
    return df if keys is None else df.join(keys, keys.columns, "left_semi")


def write_table(df: DataFrame, path: str, *, like: DataFrame | None = None) -> None:
    """zstd Parquet; batches appended to one path must share a schema. Visible only after the job commits."""
    if like is not None and like.schema != df.schema:
        raise ContractError("batch schema differs from the table schema")
    df.write.mode("append" if like is not None else "errorifexists").option("compression", "zstd").parquet(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every double column."""
    inf = F.lit(float("inf"))
    return df.select(*[
        F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != inf), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_metrics(df: DataFrame, path: str) -> None:
    """Strict JSON lines: undefined values are explicit nulls."""
    finite_or_null(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: count, XOR and modular sum of row hashes, schema text."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(h.alias("h")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(F.pmod(F.col("h"), F.lit(1_000_000_007))), F.lit(0)).alias("sum"),
    ).withColumn("schema", F.lit(schema))


def same_version(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 when the named columns of two panel versions hold the same rows."""
    fa, fb = fingerprint(a.select(*columns)), fingerprint(b.select(*columns))
    return fa.join(fb, ["rows", "xor", "sum", "schema"], "left_semi").agg(F.count("*").alias("same"))


PREDICTION_COLUMNS = ("repeat", "row_key", "arm", "probability")


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction interchange table; an invalid probability stops the write."""
    p = F.col("probability")
    ok = p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    checked = F.when(ok, p).otherwise(F.raise_error(F.lit("probability outside [0, 1]")).cast("double"))
    write_table(df.select(*PREDICTION_COLUMNS[:-1], checked.alias("probability")), path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*PREDICTION_COLUMNS)
