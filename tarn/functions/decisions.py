"""Gates, priorities, retry decisions, state transitions and health as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the decision tables.
DOMAIN_PRIORITY = {"example.com": 10}
TRANSITIONS = {"pending": ("in_progress",), "in_progress": ("done", "failed", "pending"), "failed": ("pending", "in_progress"), "done": ("pending",)}
#: error type: (retryable, permanent, delay multiplier, retries or None for the default)
ERRORS = {
    "connection_error": (True, False, 1.0, None),
    "timeout": (True, False, 1.5, None),
    "http_error": (True, False, 1.0, None),
    "rate_limited": (True, False, 2.0, 5),
    "robots_blocked": (False, True, 1.0, 0),
    "parse_error": (False, True, 1.0, 1),
    "unknown": (True, False, 2.0, 2),
}
#: preset: (attempts, base delay, longest delay, growth)
RETRY_PRESETS = {"network": (3, 2.0, 30.0, 2.0), "database": (5, 0.5, 10.0, 1.5), "quick": (2, 0.1, 1.0, 2.0), "aggressive": (10, 1.0, 120.0, 2.0)}
SERVICE_DELAYS = {"search": 5, "embedding": 10, "object": 3, "throttled": 30}
MAX_RETRIES, BASE_DELAY, MAX_DELAY = 3, 60, 3600


def should_index(status: Column, error: Column, has_body: Column, body: Column) -> Column:
    """Status 200, no error, and no parsed body or one of 100 characters after trimming."""
    return F.coalesce((status == 200) & (F.coalesce(error, F.lit("")) == "") & (~has_body | (F.length(F.trim(body)) >= 100)), F.lit(False))


def index_priority(domain: Column, age_days: Column, title: Column, description: Column, lang: Column) -> Column:
    bonus = F.lit(0)
    for host, points in DOMAIN_PRIORITY.items():
        bonus = F.when(domain == host, points).otherwise(bonus)
    fresh = F.when(age_days < 1, 5).when(age_days < 7, 3).when(age_days < 30, 1).otherwise(0)
    known = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return F.greatest(F.lit(0), bonus + fresh + 2 * known(F.length(title) > 10) + known(F.length(description) > 0) + known(lang.isin("ja", "en")))


def backoff(retry: Column, base: float = BASE_DELAY, most: float = MAX_DELAY, jitter: Column | None = None) -> Column:
    """base * 2^retry with jitter (a share, none by default), whole, at least 1, at most ``most``."""
    raw = F.lit(float(base)) * F.pow(F.lit(2.0), retry) * (1 + (jitter if jitter is not None else F.lit(0.0)))
    return F.least(F.lit(int(most)).cast("long"), F.greatest(F.lit(1).cast("long"), raw.cast("long")))


def preset_delay(attempt: Column, preset: str, jitter: Column | None = None) -> Column:
    """Delay of an attempt: capped first, jitter after."""
    _, base, most, growth = RETRY_PRESETS[preset]
    capped = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(growth), attempt))
    return capped * (1 + jitter) if jitter is not None else capped


def dlq_delay(retry: Column) -> Column:
    return F.least(F.lit(300).cast("long"), F.pow(F.lit(2.0), retry).cast("long"))


def classify(kind: Column, status: Column) -> Column:
    """(error_type, retryable, permanent, multiplier, retries) of a failure: by its kind, else by status."""

    def entry(name, **over):
        retryable, permanent, multiplier, retries = ERRORS[name]
        v = {"retryable": retryable, "permanent": permanent, "multiplier": multiplier} | over
        return F.struct(F.lit(name).alias("error_type"), F.lit(v["retryable"]).alias("retryable"), F.lit(v["permanent"]).alias("permanent"), F.lit(float(v["multiplier"])).alias("multiplier"), F.lit(retries if retries is not None else MAX_RETRIES).alias("retries"))

    gone = {"retryable": False, "permanent": True}
    return (
        F.when(kind == "robots", entry("robots_blocked"))
        .when(kind == "too_large", entry("http_error", **gone))
        .when(kind == "timeout", entry("timeout"))
        .when(kind == "connection", entry("connection_error"))
        .when(kind == "parse", entry("parse_error"))
        .when(status == 429, entry("rate_limited", multiplier=3.0))
        .when(status == 403, entry("http_error", multiplier=2.0))
        .when((status >= 400) & (status < 500), entry("http_error", **gone))
        .when(status >= 500, entry("http_error"))
        .otherwise(entry("unknown"))
    )


def should_retry(error: Column, retry_count: Column) -> Column:
    return error["retryable"] & ~error["permanent"] & (retry_count < error["retries"])


def valid_transition(old: Column, new: Column) -> Column:
    allowed = F.lit(False)
    for a, many in TRANSITIONS.items():
        allowed = F.when(old == a, new.isin(*many)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def is_locked(state: Column, owner: Column, acquired: Column, ttl: Column, now: Column) -> Column:
    return F.coalesce(owner.isNotNull() & acquired.isNotNull() & (state == "in_progress") & (ttl > now), F.lit(False))


def is_expired(state: Column, ttl: Column, now: Column) -> Column:
    return F.coalesce((state == "in_progress") & (ttl <= now), F.lit(False))


def can_acquire(state: Column, ttl: Column, now: Column) -> Column:
    return state.isin("pending", "failed") | is_expired(state, ttl, now)


def health(uptime: Column, since_success: Column, success_rate: Column, messages: Column) -> Column:
    return F.when(uptime < 60, "starting").when((since_success > 600) | ((success_rate < 80) & (messages > 10)), "unhealthy").otherwise("healthy")


def response_verdict(status: Column) -> Column:
    """Of a fetch: not found is tolerated, other client and server errors are errors."""
    return F.when(status == 404, "not_found").when(status >= 500, "server_error").when(status >= 400, "client_error").otherwise("ok")
