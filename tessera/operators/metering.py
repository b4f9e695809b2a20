"""Usage, allowance and storage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(ts: Column, start: str, end: str) -> Column:
    """F8: a half-open time range, which reaches the Parquet scan."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def month_bounds(ts: Column) -> tuple[Column, Column]:
    """M8: first instants of a time's month and of the next, in UTC."""
    start = F.date_trunc("MONTH", ts)
    return start, F.add_months(start, 1).cast("timestamp")


def all_or_null_sum(value: Column, where: Column) -> Column:
    """A2: the sum over matching rows, 0 without any, null unless every one of them has a value."""
    matching, known = F.count(F.when(where, 1)), F.count(F.when(where, value))
    return F.when(matching == known, F.coalesce(F.sum(F.when(where, value)), F.lit(0)))


def guarded_number(props: Column, path: str) -> Column:
    """A JSON field as a whole number where it is one."""
    text = F.get_json_object(props, path)
    return F.when(text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))


def usage_summary(events: DataFrame) -> DataFrame:
    """A1 to A5: one row of counts, sums and a map of features, also over no events.

    events(feature, kind, provider, quantity, tokens, pages). Features are counted first, so the map's
    aggregation sees a row a feature.
    """
    counts = events.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("kind") == "success", 1)).alias("succeeded"),
        F.count(F.when(F.col("kind") == "failure", 1)).alias("failed"),
        F.count("tokens").alias("with_tokens"),
        F.sum("tokens").alias("tokens"),
        F.count(F.when(F.col("kind") == "processed", 1)).alias("processed"),
        F.count(F.when(F.col("kind") == "processed", F.col("pages"))).alias("with_pages"),
        F.sum(F.when(F.col("kind") == "processed", F.col("pages"))).alias("pages"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(
        total("n").alias("events"),
        total("succeeded").alias("succeeded"),
        total("failed").alias("failed"),
        F.when(total("n") == total("with_tokens"), total("tokens")).alias("tokens"),
        total("processed").alias("papers_processed"),
        F.when(total("processed") == total("with_pages"), total("pages")).alias("pages"),
        F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "n"))))), F.lit("{}")).alias("features"),
    )


def feature_breakdown(events: DataFrame) -> DataFrame:
    """Events by feature, most first, then by name."""
    return events.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature")


def percent(used: Column, limit: Column) -> Column:
    """Whole percent up to 100, null without a limit."""
    return F.least(F.lit(100), F.floor(used.cast("double") * 100.0 / F.nullif(limit.cast("double"), F.lit(0.0)))).cast("int")


def allowance(events: DataFrame, request_limit: int = 100, token_limit: int = 250_000) -> DataFrame:
    """A user's requests and tokens in a month against limits, and why more is refused."""
    used = events.groupBy("user_id", F.date_format(month_bounds(F.col("ts"))[0], "yyyy-MM").alias("month")).agg(F.count(F.when(F.col("kind") == "success", 1)).alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    out = used.withColumn("request_percent", percent(F.col("requests"), F.lit(request_limit))).withColumn("token_percent", percent(F.col("tokens"), F.lit(token_limit)))
    reason = F.when(F.col("requests") >= request_limit, "requests").when(F.col("tokens") >= token_limit, "tokens")
    return out.withColumn("percent", F.greatest("request_percent", "token_percent")).withColumn("allowed", reason.isNull()).withColumn("reason", reason)


def storage_summary(files: DataFrame, capacity: int = 209_715_200) -> DataFrame:
    """Files and bytes by owner against a capacity; files(owner, bytes)."""
    used = files.groupBy("owner").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("used"))
    return used.withColumn("free", F.greatest(F.lit(0), F.lit(capacity) - F.col("used")).cast("long")).withColumn("percent", percent(F.col("used"), F.lit(capacity))).withColumn("state", threshold_state(F.col("percent")))


def threshold_state(p: Column) -> Column:
    """M9: ok below 80 percent, warning below 100, then exhausted; unknown without a percentage."""
    return F.when(p.isNull(), "unknown").when(p >= 100, "exhausted").when(p >= 80, "warning").otherwise("ok")


def completion_status(fields: DataFrame, expected: int = 7) -> DataFrame:
    """Complete if all expected fields are there, by the latest claim, and none failed; fields(paper, field, state, claim, current)."""
    out = fields.groupBy("paper").agg(F.countDistinct("field").alias("fields"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), F.count(F.when(~F.col("claim").eqNullSafe(F.col("current")), 1)).alias("stale"))
    return out.withColumn("status", F.when((F.col("fields") == expected) & (F.col("failed") == 0) & (F.col("stale") == 0), "complete").otherwise("partial"))


def backoff(attempt: Column, base: int, cap: int) -> Column:
    """Base doubled with each attempt after the first, up to a cap."""
    return F.least(F.lit(cap).cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("long")
