"""The crawl's event log: a typed schema by event name, and the statistics that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of events, their level, and the fields each has beside url, domain and time.
EVENTS = {
    "crawl_started": ("info", ()),
    "crawl_completed": ("info", ("status_code", "response_time_ms", "content_length")),
    "crawl_failed": ("error", ("error_type", "error_message")),
    "lock_acquired": ("debug", ("url_hash",)),
    "lock_failed": ("debug", ("url_hash",)),
    "rate_limited": ("warning", ("wait_time",)),
}
FIELDS = {"status_code": "int", "response_time_ms": "double", "content_length": "long", "error_type": "string", "error_message": "string", "url_hash": "string", "wait_time": "double"}


def level(name: Column) -> Column:
    """The level of an event; of other names by their ending."""
    out = F.when(name.endswith("_error") | name.endswith("_failed"), "error").when(name.endswith("_warning"), "warning").otherwise("info")
    for event, (told, _) in EVENTS.items():
        out = F.when(name == event, told).otherwise(out)
    return out


def typed(rows: DataFrame, name: str = "event", more: str = "fields") -> DataFrame:
    """The log as columns: ``more`` is a map of strings, of which each event keeps its own fields, in their types."""
    kept = []
    for field, kind in FIELDS.items():
        owners = [e for e, (_, names) in EVENTS.items() if field in names]
        kept.append(F.when(F.col(name).isin(*owners), F.col(more)[field].try_cast(kind)).alias(field))
    others = [c for c in rows.columns if c not in (name, more)]
    return rows.select(*others, F.col(name).alias("event"), level(F.col(name)).alias("level"), *kept)


def worker_summary(log: DataFrame, worker: str) -> DataFrame:
    """Per worker: counts, success of crawls and of locks, domains, mean time of what ended, errors by type.

    One pass with partial sums; errors are counted by type first, so that the
    map holds a row per type.
    """
    e = F.col("event")
    crawled, failed = F.count_if(e == "crawl_completed"), F.count_if(e == "crawl_failed")
    held, missed = F.count_if(e == "lock_acquired"), F.count_if(e == "lock_failed")
    least = lambda n: F.greatest(F.lit(1), n)
    main = log.groupBy(worker).agg(
        crawled.alias("urls_successful"),
        failed.alias("urls_failed"),
        (crawled / least(crawled + failed)).alias("success_rate"),
        (held / least(held + missed)).alias("lock_success_rate"),
        F.countDistinct("domain").alias("domains"),
        (F.coalesce(F.sum(F.when(e == "crawl_completed", F.col("response_time_ms"))), F.lit(0.0)) / least(crawled + failed)).alias("mean_time"),
    )
    types = log.where(e == "crawl_failed").groupBy(worker, "error_type").agg(F.count(F.lit(1)).alias("n"))
    errors = types.groupBy(F.col(worker).alias("__w")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("errors_by_type"))
    empty = F.create_map().cast("map<string,bigint>")
    return main.join(errors, F.col(worker) == F.col("__w"), "left").drop("__w").withColumn("errors_by_type", F.coalesce("errors_by_type", empty))


def retry_stats(attempts: DataFrame, call: str, ok: str) -> DataFrame:
    """One row over attempts (call, ok): calls, their success by any attempt, and attempts a call; zeros without calls."""
    per = attempts.groupBy(call).agg(F.count(F.lit(1)).alias("n"), F.bool_or(ok).alias("ok"))
    calls, good = F.count(F.lit(1)), F.count_if("ok")
    return per.agg(calls.alias("total_calls"), good.alias("successful_calls"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_attempts"), F.coalesce(F.try_divide(good, calls), F.lit(0.0)).alias("success_rate"), F.coalesce(F.try_divide(F.sum("n"), calls), F.lit(0.0)).alias("average_attempts"))
