"""Saved result tables: one fixed schema, guarded CSV, and a checked reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import is_blank
from ..operators.runs import guard_columns

_TEXT = (
    "url", "final_url", "title", "markdown", "error", "file", "crawled_at", "source_type", "summary",
    "summary_mode", "summary_warning", "summary_file", "sources_file", "language",
)
RESULT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [
        T.StructField("success", T.BooleanType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("facts", T.ArrayType(T.StringType())),
    ]
)
CSV_COLUMNS = (
    "url", "final_url", "title", "success", "status_code", "file", "error", "attempts", "elapsed_seconds",
    "crawled_at", "source_type", "summary_mode", "summary", "summary_warning",
)
_BROKEN = "_broken"


def as_results(df: DataFrame) -> DataFrame:
    """Any subset of the result columns, completed with the defaults of a new result."""
    have = set(df.columns)
    default = {"success": F.lit(False), "attempts": F.lit(0), "elapsed_seconds": F.lit(0.0),
               "source_type": F.lit("web"), "facts": F.array()}
    cols = []
    for field in RESULT_SCHEMA.fields:
        missing = default.get(field.name, F.lit("") if field.name in _TEXT else F.lit(None))
        value = F.col(field.name) if field.name in have else missing
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def csv_frame(results: DataFrame) -> DataFrame:
    """The 14 named columns of the CSV export, formula-like text guarded."""
    return guard_columns(results.select(*CSV_COLUMNS)).toDF(*P.CSV_HEADER)


def write_results(results: DataFrame, folder: str) -> None:
    """JSON lines of every column and a CSV of the named ones.

    The file commit protocol makes either appear whole. Spark writes no byte order mark.
    """
    full = as_results(results)
    full.write.json(f"{folder}/results.json", ignoreNullFields=False)
    csv_frame(full).write.csv(f"{folder}/results.csv", header=True, quote='"', escape='"')


def _bad_file(name: Column) -> Column:
    return (name != "") & (~name.endswith(".md") | name.rlike(r"[/\\:]"))


def results_load(spark: SparkSession, path: str, *, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): rows that keep every rule, and the others with a reason.

    ``array`` reads files that hold one JSON array; otherwise one object per line.
    Unknown keys are dropped by the fixed schema. A number where text belongs is a wrong
    type, though the JSON reader would turn it into text.
    """
    schema = T.StructType(RESULT_SCHEMA.fields + [T.StructField(_BROKEN, T.StringType())])
    lines = spark.read.text(path, wholetext=array).filter(~is_blank(F.col("value")))
    records = lines.withColumn("_v", F.try_parse_json("value"))
    if array:
        items = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
        records = records.select("value", F.explode(items).alias("_v")).withColumn(
            "value", F.coalesce(F.to_json("_v"), F.col("value"))
        )
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    kind = lambda v, at="$": F.schema_of_variant(F.try_variant_get(v, at, "variant"))

    def checks(v: Column) -> Column:
        converted = F.lit(False)
        for name in _TEXT:
            converted = converted | ~F.coalesce(kind(v, f"$.{name}"), F.lit("VOID")).isin("STRING", "VOID")
        facts = F.coalesce(F.try_variant_get(v, "$.facts", "array<variant>"), F.array())
        odd = F.exists(facts, lambda x: ~F.coalesce(kind(x), F.lit("VOID")).isin("STRING"))
        return F.struct(converted.alias("_converted"), odd.alias("_odd"))

    def judged(row: Column, found: Column) -> Column:
        files = F.lit(False)
        for name in ("file", "summary_file", "sources_file"):
            files = files | _bad_file(F.coalesce(row[name], F.lit("")))
        reason = (
            F.when(row[_BROKEN].isNotNull() | found["_converted"], "bad field type")
            .when(row["url"].isNull() | row["success"].isNull(), "missing url or success")
            .when(files, "bad file name")
            .when(found["_odd"], "bad facts")
        )
        return F.struct(row.alias("row"), reason.alias("reason"))

    rows = records.select(let(parsed, lambda r: let(let(F.col("_v"), checks), lambda k: judged(r, k))).alias("_r"))
    rows_with_reason = rows.select("_r.row.*", "_r.reason")
    valid = as_results(rows_with_reason.filter(F.col("reason").isNull()).drop(_BROKEN, "reason"))
    texts = {c: F.coalesce(c, F.lit("")) for c in _TEXT}
    return valid.withColumns(texts), rows_with_reason.filter(F.col("reason").isNotNull())
