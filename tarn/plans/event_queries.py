"""Rates, statistics, sessions and state over ``events`` (a user stands for a domain, an event type for an outcome)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import decisions as D
from tarn.operators import crawl_log as L
from tarn.operators import rates
from tarn.plans.registry import query, table

SECOND = "cast(floor(epoch(ts)) as bigint)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("rate_window", f"with e as (select event_id, user_id, {SECOND} as sec from events) select event_id, count(*) over (partition by user_id order by sec range between 59 preceding and current row) as in_window from e")
def rate_window(spark, sf_dir):
    return rates.in_window(events(spark, sf_dir).select("event_id", "user_id", "sec"), "user_id", "sec").select("event_id", "in_window")


@query(
    "rate_stats",
    f"""with e as (select user_id, {SECOND} as sec from events), m as (select user_id, max(sec) as last from e group by 1), c as (select e.user_id, count(*) as total, any_value(last) as last from e join m using (user_id) where sec > last - 3600 group by 1)
    select user_id, total, last, round(100.0 * total / 60, 6) as utilisation, total >= 60 as limited from c""",
)
def rate_stats(spark, sf_dir):
    """Requests of each domain's last hour against a limit of 60."""
    e = events(spark, sf_dir).select("user_id", "sec")
    last = e.groupBy("user_id").agg(F.max("sec").alias("last"))
    c = e.join(last, "user_id").where("sec > last - 3600").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.first("last").alias("last"))
    return c.select("user_id", "total", "last", F.round(F.lit(100.0) * F.col("total") / 60, 6).alias("utilisation"), (F.col("total") >= 60).alias("limited"))


@query("next_allowed", f"with e as (select event_id, user_id, {SECOND} as sec from events), w as (select event_id, sec, count(*) over (partition by user_id order by sec range between 59 preceding and current row) as n from e) select event_id, case when n > 1 then sec + 1 else sec end as next_allowed from w")
def next_allowed(spark, sf_dir):
    return rates.next_allowed(events(spark, sf_dir).select("event_id", "user_id", "sec"), "user_id", "sec").select("event_id", "next_allowed")


@query("next_allowed_overrides", f"with e as (select event_id, user_id, {SECOND} as sec from events), w as (select event_id, user_id, sec, count(*) over (partition by user_id order by sec range between 3599 preceding and current row) as n from e) select event_id, case when n > case when user_id % 10 = 0 then 5 else 2 end then sec + 1 else sec end as next_allowed from w")
def next_allowed_overrides(spark, sf_dir):
    """An hour's window with a limit of its own for some domains."""
    e = events(spark, sf_dir).select("event_id", "user_id", "sec")
    limit = F.when(F.col("user_id") % 10 == 0, 5).otherwise(2)
    return rates.next_allowed(e, "user_id", "sec", limit, 3600).select("event_id", "next_allowed")


@query("request_gaps", "select event_id, coalesce(date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) >= 1000000, true) as far_enough from events")
def request_gaps(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    found = rates.previous(e, "user_id", "t", "event_id", F.col("t"), "before")
    return found.select("event_id", F.coalesce(F.col("t") - F.col("before") >= 1_000_000, F.lit(True)).alias("far_enough"))


@query("qps_overrides", "select user_id, cast(case when user_id % 10 = 0 then 5 else 1 end as int) as qps, count(*) as requests from events group by 1, 2")
def qps_overrides(spark, sf_dir):
    """Requests per domain first, then the left join with the overrides (one row per domain on both sides)."""
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))
    over = events(spark, sf_dir).where("user_id % 10 = 0").select("user_id").distinct().withColumn("qps", F.lit(5))
    return per.join(over, "user_id", "left").select("user_id", F.coalesce("qps", F.lit(1)).alias("qps"), "requests")


STATE = "case event_type when 'signup' then 'pending' when 'view' then 'in_progress' when 'click' then 'in_progress' when 'purchase' then 'done' else 'failed' end"


@query("state_counts", f"select user_id, " + ", ".join(f"least(1000, cast(sum(case when {STATE} = '{s}' then 1 else 0 end) as bigint)) as {s}" for s in D.TRANSITIONS) + " from events group by 1")
def state_counts(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.expr(STATE).alias("state"))
    return e.groupBy("user_id").agg(*[F.least(F.lit(1000).cast("long"), F.count_if(F.col("state") == s)).alias(s) for s in D.TRANSITIONS])


@query(
    "state_transitions",
    f"""with s as (select event_id, {STATE} as new, lag({STATE}) over (partition by user_id order by ts, event_id) as old from events)
    select old, new, count(*) as n, bool_or(case old when 'pending' then new = 'in_progress' when 'in_progress' then new in ('done', 'failed', 'pending') when 'failed' then new in ('pending', 'in_progress') when 'done' then new = 'pending' else false end) as valid from s where old is not null group by 1, 2""",
)
def state_transitions(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.expr(STATE).alias("new"))
    s = rates.previous(e, "user_id", "t", "event_id", F.col("new"), "old").where("old is not null")
    return s.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"), F.bool_or(D.valid_transition(F.col("old"), F.col("new"))).alias("valid"))


LAST = f"l as (select user_id, arg_max({STATE}, event_id) as state, arg_max({SECOND}, event_id) + 3600 as ttl, max({SECOND}) as last from events group by 1), n as (select max({SECOND}) - 600 as now from events)"


def last_states(spark, sf_dir):
    """Each URL's latest state with a lease of an hour, and the moment of asking."""
    e = events(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max_by(F.expr(STATE), "event_id").alias("state"), (F.max_by("sec", "event_id") + 3600).alias("ttl"))
    now = e.agg((F.max("sec") - 600).alias("now"))
    return last, now


@query("pending_urls", f"with {LAST} select user_id from l, n where state = 'pending' and (ttl is null or ttl <= now + 1800000) order by user_id limit 100")
def pending_urls(spark, sf_dir):
    last, now = last_states(spark, sf_dir)
    at = now.first().now or 0
    return last.where((F.col("state") == "pending") & (F.col("ttl").isNull() | (F.col("ttl") <= at + 1_800_000))).select("user_id").orderBy("user_id").limit(100)


@query("expired_leases", f"with {LAST} select user_id, 'pending' as state from l, n where l.state = 'in_progress' and ttl <= now")
def expired_leases(spark, sf_dir):
    last, now = last_states(spark, sf_dir)
    at = F.lit(now.first().now or 0)
    return last.where(D.is_expired(F.col("state"), F.col("ttl"), at)).select("user_id", F.lit("pending").alias("state"))


@query("lock_predicates", f"with {LAST} select user_id, state = 'in_progress' and ttl > now as locked, state = 'in_progress' and ttl <= now as expired, state in ('pending', 'failed') or (state = 'in_progress' and ttl <= now) as acquirable, greatest(0, ttl - now) as wait from l, n")
def lock_predicates(spark, sf_dir):
    last, now = last_states(spark, sf_dir)
    at, s, t = F.lit(now.first().now or 0), F.col("state"), F.col("ttl")
    return last.select("user_id", D.is_locked(s, F.col("user_id"), t, t, at).alias("locked"), D.is_expired(s, t, at).alias("expired"), D.can_acquire(s, t, at).alias("acquirable"), F.greatest(F.lit(0), t - at).alias("wait"))


@query("state_as_of", f"with o as (select user_id, event_id, ts, {STATE} as state from events) select user_id, arg_max(state, event_id) as state from o where ts <= timestamp '2024-01-10' group by 1")
def state_as_of(spark, sf_dir):
    return events(spark, sf_dir).where("ts <= timestamp_ntz'2024-01-10'").groupBy("user_id").agg(F.max_by(F.expr(STATE), "event_id").alias("state"))


@query("kv_point_get", "select event_id, event_type from events where event_id = 42")
def kv_point_get(spark, sf_dir):
    return events(spark, sf_dir).where("event_id = 42").select("event_id", "event_type")


@query("kv_index_query", "select event_id from events where user_id = 7 and event_type in ('view', 'click') order by event_id limit 50")
def kv_index_query(spark, sf_dir):
    return events(spark, sf_dir).where("user_id = 7 and event_type in ('view', 'click')").select("event_id").orderBy("event_id").limit(50)


@query("kv_batch_get", "select event_id, value from events where event_id in (select o_orderkey from orders)")
def kv_batch_get(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return events(spark, sf_dir).join(keys, "event_id", "left_semi").select("event_id", "value")


@query("kv_put_if_absent", "select user_id, 'new' as origin from events where user_id not in (select user_id from events where event_type = 'signup' and event_id % 2 = 0) group by 1 union all select user_id, 'old' from events where event_type = 'signup' and event_id % 2 = 0 group by 1")
def kv_put_if_absent(spark, sf_dir):
    """Append what is not there yet: anti join, then union."""
    e = events(spark, sf_dir)
    old = e.where("event_type = 'signup' and event_id % 2 = 0").select("user_id").distinct()
    new = e.select("user_id").distinct().join(old, "user_id", "left_anti")
    return new.withColumn("origin", F.lit("new")).unionAll(old.withColumn("origin", F.lit("old")))


@query("kv_upsert_last_wins", "select user_id, arg_max(value, event_id) as value from events group by 1")
def kv_upsert_last_wins(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("success_rate", "select round(100.0 * sum(case when event_type <> 'error' then 1 else 0 end) / count(*), 6) as success_rate, round(avg(value), 4) as mean_time, count(*) as processed from events")
def success_rate(spark, sf_dir):
    return events(spark, sf_dir).agg(F.round(F.lit(100.0) * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 6).alias("success_rate"), F.round(F.avg("value"), 4).alias("mean_time"), F.count(F.lit(1)).alias("processed"))


@query("worker_summary", "select user_id, count(*) as processed, count(distinct event_type) as kinds, round(avg(value), 4) as mean_time, round(sum(case when event_type <> 'error' then 1 else 0 end) / greatest(1, count(*)), 6) as success_rate from events group by 1")
def worker_summary(spark, sf_dir):
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("user_id").agg(n.alias("processed"), F.countDistinct("event_type").alias("kinds"), F.round(F.avg("value"), 4).alias("mean_time"), F.round(F.count_if(F.col("event_type") != "error") / F.greatest(F.lit(1), n), 6).alias("success_rate"))


@query("errors_by_type", "select event_type, count(*) as n, round(count(*) / (select count(*) from events), 6) as share from events group by 1")
def errors_by_type(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(
    "peak_concurrency",
    """with s as (select ts as t, 1 as d from events union all select ts + to_microseconds(cast(value * 1000000 as bigint)), -1 from events),
    m as (select t, sum(d) as d from s group by 1), r as (select date_trunc('day', t) as day, t, d, sum(d) over (order by t) as n from m)
    select cast(day as date) as day, cast(greatest(max(n), arg_min(n - d, t)) as bigint) as peak from r group by day""",
)
def peak_concurrency(spark, sf_dir):
    """Sweep line: +1 at a start, -1 at an end; a day begins with what is open at midnight."""
    e = events(spark, sf_dir)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = F.explode(F.array(F.struct(t.alias("t"), F.lit(1).alias("d")), F.struct((t + (F.col("value") * 1_000_000).cast("decimal(30,0)").cast("long")).alias("t"), F.lit(-1).alias("d"))))
    s = e.select(ends.alias("s")).select(F.expr("s.t div 86400000000").alias("n"), "s.t", "s.d").groupBy("n", "t").agg(F.sum("d").alias("d"))
    # one row per day, so that the running sum over all days is short; within a day the sweep is a task of its own
    days = s.groupBy("n").agg(F.sum("d").alias("net"))
    days = days.select(F.col("n").alias("day"), F.coalesce(F.sum("net").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("opening"))
    w = Window.partitionBy("n").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    most = s.select("n", F.sum("d").over(w).alias("open")).groupBy("n").agg(F.max("open").alias("most"))
    found = most.join(days, F.col("n") == F.col("day"))
    return found.select(F.expr("date_add(date'1970-01-01', cast(n as int))").alias("day"), (F.col("opening") + F.greatest(F.lit(0), F.col("most"))).alias("peak"))


@query("wait_means", "with w as (select user_id, value, row_number() over (partition by user_id order by event_id desc) as k from events) select user_id, round(avg(value), 6) as mean_wait, count(*) as waits from w where k <= 50 group by 1")
def wait_means(spark, sf_dir):
    """Mean wait of each worker's last 50 tasks: a bounded list of the latest, kept map-side."""
    latest = F.slice(F.sort_array(F.collect_list(F.struct("event_id", "value")), asc=False), 1, 50)
    # lists per worker and slice of its events first, so that no list is longer than a slice and 50
    part = events(spark, sf_dir).groupBy("user_id", F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("part")).agg(latest.alias("l"))
    whole = part.groupBy("user_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l")), asc=False), 1, 50).alias("l"))
    one = F.explode("l").alias("e")
    return whole.select("user_id", one).groupBy("user_id").agg(F.round(F.avg("e.value"), 6).alias("mean_wait"), F.count(F.lit(1)).alias("waits"))


@query("mean_response_time", "select round(avg(value), 6) as mean_time, count(*) as n from events where event_type <> 'error'")
def mean_response_time(spark, sf_dir):
    return events(spark, sf_dir).where("event_type <> 'error'").agg(F.round(F.avg("value"), 6).alias("mean_time"), F.count(F.lit(1)).alias("n"))


@query("failure_rates", "select event_type, round(count(*) / (select count(*) from events), 6) as rate, round(100.0 * count(*) / (select count(*) from events), 4) as percent from events where event_type in ('error', 'purchase') group by 1")
def failure_rates(spark, sf_dir):
    e = events(spark, sf_dir)
    total = F.sum("n").over(Window.partitionBy())
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("all", total).where("event_type in ('error', 'purchase')")
    return per.select("event_type", F.round(F.col("n") / F.col("all"), 6).alias("rate"), F.round(F.lit(100.0) * F.col("n") / F.col("all"), 4).alias("percent"))


@query("lock_projection", f"with e as (select user_id, {SECOND} as sec, event_type, event_id from events), l as (select user_id, max(event_id) as event_id from e group by 1) select cast(user_id as varchar) as url_hash, {STATE} as state, case when {STATE} = 'in_progress' then 'w' || user_id % 3 end as owner, sec as acquired_at, sec + 3600 as ttl, cast(user_id % 4 as bigint) as retries from e join l using (user_id, event_id)")
def lock_projection(spark, sf_dir):
    """The six columns of a lock: key, state, owner, times, retries; the latest event of each key decides."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct("sec", "event_type"), "event_id").alias("e"))
    state = F.expr(STATE.replace("event_type", "e.event_type"))
    return last.select(F.col("user_id").cast("string").alias("url_hash"), state.alias("state"), F.when(state == "in_progress", F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string"))).alias("owner"), F.col("e.sec").alias("acquired_at"), (F.col("e.sec") + 3600).alias("ttl"), (F.col("user_id") % 4).cast("long").alias("retries"))


@query("health_status", "with s as (select user_id, 100.0 * sum(case when event_type <> 'error' then 1 else 0 end) / count(*) as rate, count(*) as n from events group by 1) select user_id, case when user_id % 7 = 0 then 'starting' when rate < 80 and n > 10 then 'unhealthy' else 'healthy' end as status from s")
def health_status(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id").agg((F.lit(100.0) * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("rate"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", D.health(F.when(F.col("user_id") % 7 == 0, 10).otherwise(100), F.lit(5), F.col("rate"), F.col("n")).alias("status"))


@query("dlq_ready", f"with e as (select event_id % 4 as retry, {SECOND} as sec from events where event_type = 'error'), n as (select max(sec) - 86400 as now from e) select count(*) as pending, cast(sum(case when sec + least(300, cast(pow(2, retry) as bigint)) <= now then 1 else 0 end) as bigint) as ready from e, n")
def dlq_ready(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error'").select((F.col("event_id") % 4).alias("retry"), "sec")
    now = (e.agg(F.max("sec")).first()[0] or 0) - 86_400
    return e.agg(F.count(F.lit(1)).alias("pending"), F.count_if(F.col("sec") + D.dlq_delay(F.col("retry")) <= now).alias("ready"))


@query("retry_or_dead_letter", "select case when event_id % 6 < 3 then 'retry' else 'dead_letter' end as route, count(*) as n from events where event_type = 'error' group by 1")
def retry_or_dead_letter(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'error'").groupBy(F.when(F.col("event_id") % 6 < D.MAX_RETRIES, "retry").otherwise("dead_letter").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("truncated_rates", "select cast(trunc(sum(case when event_type = 'error' then 1 else 0 end) / count(*)) as int) as blocked_rate from events")
def truncated_rates(spark, sf_dir):
    return events(spark, sf_dir).agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).cast("int").alias("blocked_rate"))


@query("heartbeat_stats", "with h as (select user_id, sum(case when event_type = 'error' then 1 else 0 end) / count(*) as failure from events group by 1) select user_id, round(failure, 6) as failure, failure > 0.1 as degraded from h")
def heartbeat_stats(spark, sf_dir):
    f = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(f, 6).alias("failure"), (f > 0.1).alias("degraded"))


@query("queue_depth", "select event_type as queue, cast(sum(case when event_id % 5 > 0 then 1 else 0 end) as bigint) as visible, cast(sum(case when event_id % 5 = 0 then 1 else 0 end) as bigint) as in_flight, count(*) as total from events group by 1")
def queue_depth(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("queue")).agg(F.count_if(F.col("event_id") % 5 > 0).alias("visible"), F.count_if(F.col("event_id") % 5 == 0).alias("in_flight"), F.count(F.lit(1)).alias("total"))


@query("upload_stats", "select lang, cast(sum(octet_length(encode(text))) as bigint) as bytes, count(*) as uploads, round(avg(octet_length(encode(text))), 6) as mean_bytes, cast(sum(case when octet_length(encode(text)) > 1024 then 1 else 0 end) as bigint) as compressed from documents group by 1")
def upload_stats(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).cast("long").alias("bytes"), F.count(F.lit(1)).alias("uploads"), F.round(F.avg(n), 6).alias("mean_bytes"), F.count_if(n > 1024).alias("compressed"))


@query("hourly_windows", "select cast(epoch(date_trunc('hour', ts)) as bigint) as hour, count(*) as n from events group by 1")
def hourly_windows(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("hour"), "n")


@query("message_decode", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def message_decode(spark, sf_dir):
    """Malformed messages would keep null fields and go to the reject sink."""
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("message_rejects", "select count(*) as rejects from events where try_cast(props as json) is null")
def message_rejects(spark, sf_dir):
    parsed = F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return events(spark, sf_dir).select(parsed.alias("m")).agg(F.count_if(F.col("m._bad").isNotNull()).alias("rejects"))


#: The log that the events stand for: a user is a worker, a minute a domain, and every type an event with its fields.
NAMES = {"signup": "crawl_started", "view": "crawl_completed", "error": "crawl_failed", "click": "lock_acquired", "purchase": "lock_failed"}
NAME = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in NAMES.items()) + " else 'rate_limited' end"
LOG = f"g as (select event_id, user_id, 'd' || (event_id % 50) as domain, {NAME} as event, value, 'e' || (event_id % 3) as error_type from events)"


def crawl_log(spark, sf_dir):
    fields = F.create_map(F.lit("status_code"), F.lit("200"), F.lit("response_time_ms"), F.col("value").cast("string"), F.lit("error_type"), F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")), F.lit("url_hash"), F.lit("h"))
    rows = events(spark, sf_dir).select("event_id", "user_id", F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")).alias("domain"), F.expr(NAME).alias("event"), fields.alias("fields"))
    return L.typed(rows)


@query(
    "crawl_log_events",
    f"with {LOG} select event_id, event, case event when 'crawl_failed' then 'error' when 'lock_acquired' then 'debug' when 'lock_failed' then 'debug' when 'rate_limited' then 'warning' else 'info' end as level, case when event = 'crawl_completed' then cast(200 as int) end as status_code, case when event = 'crawl_completed' then value end as response_time_ms, case when event = 'crawl_failed' then error_type end as error_type, case when event like 'lock%' then 'h' end as url_hash from g",
)
def crawl_log_events(spark, sf_dir):
    return crawl_log(spark, sf_dir).select("event_id", "event", "level", "status_code", "response_time_ms", "error_type", "url_hash")


@query(
    "crawl_worker_summary",
    f"""with {LOG}, t as (select user_id, error_type, count(*) as n from g where event = 'crawl_failed' group by 1, 2), j as (select user_id, string_agg(error_type || ':' || n, ',' order by error_type) as errors from t group by 1),
    m as (select user_id, count(*) filter (event = 'crawl_completed') as good, count(*) filter (event = 'crawl_failed') as bad, count(*) filter (event = 'lock_acquired') as held, count(*) filter (event = 'lock_failed') as missed, count(distinct domain) as domains, coalesce(sum(value) filter (event = 'crawl_completed'), 0) as time from g group by 1)
    select user_id, good as urls_successful, bad as urls_failed, round(good / greatest(1, good + bad), 6) as success_rate, round(held / greatest(1, held + missed), 6) as lock_success_rate, domains, round(time / greatest(1, good + bad) + 1e-9, 4) as mean_time, coalesce(errors, '') as errors from m left join j using (user_id)""",
)
def crawl_worker_summary(spark, sf_dir):
    """The summary of every worker, with locks, domains and errors by type."""
    s = L.worker_summary(crawl_log(spark, sf_dir), "user_id")
    told = F.array_join(F.transform(F.map_entries("errors_by_type"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    # a hair more, so that halves in sums of different orders go the same way
    rounded = [F.round(F.col(c) + more, d).alias(c) for c, d, more in (("success_rate", 6, 0.0), ("lock_success_rate", 6, 0.0), ("mean_time", 4, 1e-9))]
    return s.select("user_id", "urls_successful", "urls_failed", *rounded, "domains", told.alias("errors"))


@query(
    "retry_stats",
    "with p as (select user_id, count(*) as n, bool_or(event_type <> 'error') as ok from events group by user_id, event_id // 3) select count(*) as total_calls, count(*) filter (ok) as successful_calls, cast(sum(n) as bigint) as total_attempts, round(count(*) filter (ok) / count(*), 6) as success_rate, round(sum(n) / count(*), 6) as average_attempts from p",
)
def retry_stats(spark, sf_dir):
    """A call is what a user does in three events in a row; it succeeds if one of them is no error."""
    e = events(spark, sf_dir).select(F.struct("user_id", F.expr("event_id div 3")).alias("call"), (F.col("event_type") != "error").alias("ok"))
    s = L.retry_stats(e, "call", "ok")
    return s.select("total_calls", "successful_calls", "total_attempts", F.round("success_rate", 6).alias("success_rate"), F.round("average_attempts", 6).alias("average_attempts"))
