"""URL rules: canonical form with reject reasons, first-seen rows, source routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import strip

# scheme, authority, path, query; the fragment is not kept.
_SPLIT = r"(?is)\A([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?\z"


def _part(value: Column, group: int) -> Column:
    return F.regexp_extract(value, _SPLIT, group)


def url_canonicalize(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``canonical`` and ``reject_reason``; blank input lines are skipped."""
    rows = df.withColumn("_v", strip(F.coalesce(F.col(url), F.lit("")))).filter(F.col("_v") != "")
    rows = rows.withColumns({
        "_scheme": F.lower(_part(F.col("_v"), 1)),
        "_netloc": F.lower(_part(F.col("_v"), 2)),
    })
    netloc = F.col("_netloc")
    host_port = F.regexp_replace(netloc, r"(?s)\A.*@", "")
    host = F.regexp_extract(host_port, r"\A(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(host_port, r"(?s)\A(?:\[[^\]]*\]|[^:]*):(.*)\z", 1)
    bad_port = (port != "") & (
        ~port.rlike(r"\A[0-9]+\z") | (F.coalesce(port.try_cast("long"), F.lit(65536)) > 65535)
    )
    reason = (
        F.when(F.col("_v").rlike(r"(?U)[\s\x1c-\x1f]"), "inner whitespace")
        .when(~F.col("_scheme").isin("http", "https"), "not http or https")
        .when(F.regexp_replace(host, r"[\[\]]", "") == "", "no host")
        .when(netloc.contains("@") & ~netloc.rlike(r"(?s)\A:?@[^@]*\z"), "user or password")
        .when(bad_port, "bad port")
    )
    path = _part(F.col("_v"), 3)
    query = _part(F.col("_v"), 4)
    canonical = F.concat(
        F.col("_scheme"), F.lit("://"), netloc,
        F.when(path == "", "/").otherwise(path),
        F.when(query == "?", "").otherwise(query),
    )
    return (
        rows.withColumn("reject_reason", reason)
        .withColumn("canonical", F.when(F.col("reject_reason").isNull(), canonical))
        .drop("_v", "_scheme", "_netloc")
    )


def url_dedupe(df: DataFrame, *, key: str = "canonical", pos: str = "pos") -> DataFrame:
    """First row per key by ``pos``: a minimum, so copies are folded before the shuffle."""
    kept = [c for c in df.columns if c not in (key, pos)]
    first = F.min_by(F.struct(F.col(pos), *[F.col(c) for c in kept]), F.col(pos)).alias("_r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "_r.*")


def source_route(df: DataFrame, url: str = "url") -> DataFrame:
    """Add source_type (web, youtube, rejected), video_id and route_error."""
    parsed = df.withColumns({
        "_host": F.lower(F.regexp_replace(F.regexp_replace(_part(F.col(url), 2), r"\A.*@", ""), r":.*\z", "")),
        "_path": F.split(F.trim(_part(F.col(url), 3), F.lit("/")), "/"),
        "_q": F.regexp_extract(_part(F.col(url), 4), r"[?&]v=([^&]+)", 1),
    }).withColumn("_q", F.coalesce(F.try_url_decode("_q"), F.col("_q")))
    first = F.col("_path")[0]
    short = F.col("_host").isin(*P.SHORT_HOSTS)
    video = F.col("_host").isin(*P.VIDEO_HOSTS)
    wanted = (
        F.when(short, first)
        .when(first == "watch", F.col("_q"))
        .when(first.isin("shorts", "embed", "live"), F.coalesce(F.get("_path", F.lit(1)), F.lit("")))
        .otherwise("")
    )
    known = short | video
    error = (
        F.when(~known, None)
        .when(video & (wanted == ""), "not a single video")
        .when(~wanted.rlike(P.VIDEO_ID), "bad video id")
    )
    return (
        parsed.withColumn("route_error", error)
        .withColumn(
            "source_type",
            F.when(~known, "web").when(F.col("route_error").isNull(), "youtube").otherwise("rejected"),
        )
        .withColumn("video_id", F.when(F.col("source_type") == "youtube", wanted))
        .drop("_host", "_path", "_q")
    )
