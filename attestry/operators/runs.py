"""Fetch outcomes, run bookkeeping, result tables and their safety rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import is_blank


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Last attempt per URL with success, error text and whether a retry may help."""
    others = [c for c in log.columns if c not in ("run_id", "url", "attempt")]
    last = F.max_by(F.struct("attempt", *others), "attempt").alias("_r")
    rows = log.groupBy("run_id", "url").agg(last, F.count(F.lit(1)).alias("attempts")).select(
        "run_id", "url", "attempts", "_r.*"
    )
    no_status = F.col("status").isNull() | (F.col("status") == 0)
    text = F.coalesce(
        F.when(F.col("error_text") != "", F.col("error_text")),
        F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("None"))),
    )
    success = F.col("ok") & (no_status | (F.col("status") < 400))
    return rows.select(
        "run_id", "url", "attempts", "status",
        success.alias("success"),
        F.when(success, "").otherwise(text).alias("error"),
        (
            ~success
            & (
                F.coalesce(F.col("status").isin(*P.TRANSIENT_STATUS), F.lit(False))
                | (no_status & text.rlike(P.TRANSIENT_ERROR))
            )
        ).alias("transient"),
    )


def status_reason(df: DataFrame, status: str = "status") -> DataFrame:
    """Human reason of a status; five fixed entries, so the lookup is always broadcast."""
    lookup = df.sparkSession.createDataFrame(
        [(code, reason) for code, reason in P.STATUS_REASONS.items()], "status_ int, _reason string"
    )
    return (
        df.join(F.broadcast(lookup), F.col(status) == F.col("status_"), "left")
        .withColumn(
            "reason", F.coalesce("_reason", F.format_string(P.STATUS_REASON_OTHER, F.col(status)))
        )
        .drop("status_", "_reason")
    )


def guard_cell(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(value.rlike(r"(?U)\A[\s\x1c-\x1f]*[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def guard_columns(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: guard_cell(F.col(c)) for c in text}) if text else df


def run_progress(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: how many inputs are done, pending, or lack a summary, and its state."""
    counts = (
        inputs.select("run_id", "url").distinct()
        .join(results.select("run_id", "url", "success", "summary").withColumn("done", F.lit(True)),
              ["run_id", "url"], "left")
        .groupBy("run_id")
        .agg(
            F.count_if("done").alias("completed"),
            F.count_if(F.col("done").isNull()).alias("pending"),
            F.count_if(F.col("success") & (F.coalesce("summary", F.lit("")) == "")).alias("summary_pending"),
        )
    )
    return counts.withColumn("state", F.when(F.col("pending") > 0, "running").otherwise("completed"))


def run_manifest(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Manifest of each run as rows, never one list per run: a ``state`` row, then one row
    per pending URL and per URL without a summary."""
    entry = lambda df, kind: df.select("run_id", F.lit(kind).alias("kind"), F.col("url").alias("value"))
    pending = inputs.select("run_id", "url").distinct().join(results, ["run_id", "url"], "left_anti")
    unsummarised = results.filter(F.col("success") & (F.coalesce("summary", F.lit("")) == ""))
    state = run_progress(inputs, results).select(
        "run_id", F.lit("state").alias("kind"),
        F.concat_ws(" ", "state", F.col("completed").cast("string")).alias("value"),
    )
    return state.unionByName(entry(pending, "pending")).unionByName(entry(unsummarised, "summary_pending"))


def result_search(pages: DataFrame, *, show: str = "all", query: str = "") -> DataFrame:
    """Rows whose url, title, text, summary or error hold the query, with a state label."""
    rows = pages
    if show == "success":
        rows = rows.filter("success")
    elif show == "failed":
        rows = rows.filter(~F.col("success"))
    needle = query.casefold().strip()
    if needle:
        whole = F.concat_ws(" ", *[
            F.coalesce(c, F.lit("")) for c in ("url", "title", "markdown", "summary", "error")
        ])
        rows = rows.filter(F.replace(F.lower(whole), F.lit("ß"), F.lit("ss")).contains(needle))
    label = (
        F.when(~F.col("success"), P.LABEL_FAILED)
        .when(F.col("summary_mode") == P.MODE_PENDING, P.LABEL_RUNNING)
        .when(F.col("summary_mode") == P.MODE_EXTRACT, P.MODE_EXTRACT)
        .otherwise(P.LABEL_DONE)
    )
    return rows.withColumn("label", label)


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("run_id").agg(
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count(F.lit(1)).alias("processed"),
    )


def retry_urls(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(~F.col("success")).select("run_id", "url")


def page_name(title: Column, n: Column) -> Column:
    """``007_title`` file stem of a page."""
    slug = F.substring(F.regexp_replace(title, r"(?U)[^\w-]", "_"), 1, 36)
    return F.format_string("%03d_%s", n, F.when(slug == "", P.PAGE_DEFAULT).otherwise(slug))


def report_name(title: Column) -> Column:
    """Report file stem: runs of other characters become one dash."""
    slug = F.trim(F.regexp_replace(title, r"(?U)[^\w-]+", "-"), F.lit("-_"))
    short = F.substring(slug, 1, 48)
    return F.when(short == "", P.SLUG_DEFAULT).otherwise(short)


def processed_pages(pages: DataFrame) -> DataFrame:
    """A page whose text is blank is a failed page with a reason."""
    blank = is_blank(F.col("markdown"))
    return pages.withColumn("error", F.when(F.col("success") & blank, "no text").otherwise(F.col("error"))).withColumn(
        "success", F.col("success") & ~blank
    )
