"""Crawl-state folds: leases with heartbeats, releases, retries and expiry; and rate-limited admission.

Both are folds over one key's events in order.  The lease fold of a batch cuts
a key's events into parts of bounded size, folds all parts at once inside the
JVM, and repeats those whose predecessor turned out to end differently than
assumed; since most parts end alike whatever they begin with, that is a few
rounds even for a key with most of all events.  In streams a stateful processor
does the same step, with event-time timers: a lease expires by itself, and the
state of finished keys goes after a while.  Admission first counts requests per
domain and second, so that a hot domain's fold is as long as its seconds, not
its requests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarn.operators.graph import cut_lineage

LEASE, RETRY_DELAY, MAX_RETRIES = 3600, 60, 3
#: Retry delays double up to this many times.
MOST_DOUBLINGS = 30
#: Seconds after which a stream forgets a key that is done.
RETENTION = 7 * 86_400
#: Events of a key in one part, about, and seconds whose events are never parted.
PART_EVENTS, SLICE = 1024, 60
STATE = "state string, owner string, ttl long, retries long"
FOLDED = "struct<state:string,owner:string,ttl:bigint,retries:bigint,applied:bigint>"
Fold = tuple[str, str | None, int | None, int]
START: Fold = ("pending", None, None, 0)


def step(s: Fold, at: int, kind: str, owner: str | None) -> tuple[Fold, bool]:
    """The next state after one event, and whether the event took effect."""
    state, holder, ttl, retries = s
    if state == "in_progress" and ttl is not None and ttl <= at:
        state, holder, ttl = "pending", None, None  # the sweep
    mine = state == "in_progress" and holder == owner
    if kind == "acquire" and state in ("pending", "failed"):
        return ("in_progress", owner, at + LEASE, retries), True
    if kind == "heartbeat" and mine:
        return ("in_progress", owner, at + LEASE, retries), True
    if kind == "done" and mine:
        return ("done", None, None, retries), True
    if kind == "failed" and mine:
        return ("failed", None, at + (RETRY_DELAY << min(retries, MOST_DOUBLINGS)), retries + 1), True
    if kind == "retry" and state in ("failed", "done") and retries < MAX_RETRIES:
        return ("pending", None, at + RETRY_DELAY, retries), True
    if kind == "release" and mine:
        return ("failed", None, None, retries), True
    return (state, holder, ttl, retries), False


def _folded(state: Any, owner: Any, ttl: Any, retries: Any, applied: Any) -> Column:
    named = zip(("state", "owner", "ttl", "retries", "applied"), (state, owner, ttl, retries, applied), strict=True)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in named]).cast(FOLDED)


def _swept(s: Column, at: Column) -> Column:
    """The state with a lease gone that ran out by ``at``."""
    over = (s["state"] == "in_progress") & F.coalesce(s["ttl"] <= at, F.lit(False))
    return F.when(over, _folded("pending", None, None, s["retries"], s["applied"])).otherwise(s)


def _next(s: Column, e: Column) -> Column:
    """``step`` as an expression, for a state that is swept."""
    at, kind, r, n = e["at"], e["kind"], s["retries"], s["applied"] + 1
    mine = (s["state"] == "in_progress") & s["owner"].eqNullSafe(e["owner"])
    delay = F.call_function("shiftleft", F.lit(RETRY_DELAY).cast("long"), F.least(r, F.lit(MOST_DOUBLINGS)).cast("int"))
    held = _folded("in_progress", e["owner"], at + LEASE, r, n)
    return (
        F.when((kind == "acquire") & s["state"].isin("pending", "failed"), held)
        .when((kind == "heartbeat") & mine, held)
        .when((kind == "done") & mine, _folded("done", None, None, r, n))
        .when((kind == "failed") & mine, _folded("failed", None, at + delay, r + 1, n))
        .when((kind == "retry") & s["state"].isin("failed", "done") & (r < MAX_RETRIES), _folded("pending", None, at + RETRY_DELAY, r, n))
        .when((kind == "release") & mine, _folded("failed", None, None, r, n))
        .otherwise(s)
    )


def _exit(entry: Column) -> Column:
    """The state after a part's events, by the state before them; ``applied`` counts within the part."""
    begin = _folded(entry["state"], entry["owner"], entry["ttl"], entry["retries"], 0)
    return F.aggregate("es", begin, lambda s, e: F.transform(F.array(_swept(s, e["at"])), lambda x: _next(x, e))[0])


def parts(events: DataFrame, size: int = PART_EVENTS, seconds: int = SLICE) -> DataFrame:
    """(key, part, es): each key's events in order, in parts that hold about ``size`` of them."""
    rows = events.select("key", "at", "seq", "kind", "owner", F.floor(F.col("at") / seconds).alias("slice"))
    counts = rows.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("key", "slice", F.floor(F.coalesce(before, F.lit(0)) / size).alias("part"))
    return rows.join(placed, ["key", "slice"]).groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "kind", "owner"))).alias("es"))


def fold(events: DataFrame, as_of: int | None = None, size: int = PART_EVENTS) -> DataFrame:
    """(key, state, owner, ttl, retries, applied) after all events (key, at, seq, kind, owner).

    With ``as_of`` leases that ran out by then are pending again.
    """
    every = cut_lineage(parts(events, size))
    start = _folded(*START, 0)
    runs = cut_lineage(every.select("key", "part", start.alias("entry"), _exit(start).alias("exit")))
    order = Window.partitionBy("key").orderBy("part")
    while True:
        came = F.lag("exit").over(order)
        true = F.when(came.isNull(), start).otherwise(_folded(came["state"], came["owner"], came["ttl"], came["retries"], 0))
        checked = cut_lineage(runs.withColumn("true", true).withColumn("same", F.col("true").eqNullSafe(F.col("entry"))))
        if not checked.where("not same").limit(1).count():
            break
        again = checked.where("not same").select("key", "part", F.col("true").alias("entry")).join(every, ["key", "part"])
        again = again.select("key", "part", "entry", _exit(F.col("entry")).alias("exit"))
        runs = cut_lineage(checked.where("same").select("key", "part", "entry", "exit").unionByName(again))
    last = runs.groupBy("key").agg(F.max_by("exit", "part").alias("s"), F.sum("exit.applied").alias("applied"))
    final = F.col("s") if as_of is None else _swept(F.col("s"), F.lit(as_of))
    return last.select("key", final.alias("s"), "applied").select("key", "s.state", "s.owner", "s.ttl", "s.retries", "applied")


class LeaseProcessor(StatefulProcessor):
    """A key's lease in a stream: events move it, timers end it.

    An event-time timer stands at the end of a lease and takes the key back to
    pending without another event; one more drops the state of a key that has
    been done for ``retention`` seconds.  A key has few events in a batch: plain
    rows cost less than a frame for each key, and so does asking the state store
    no more than is needed.
    """

    def __init__(self, retention: int = RETENTION):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", STATE)

    def _read(self) -> Fold | None:
        return self.lease.get() if self.lease.exists() else None

    def _write(self, before: Fold | None, s: Fold, at: int) -> None:
        """Keeps the state; its timer takes the place of the one before, which a lease's end tells without asking."""
        if s != before:
            self.lease.update(s)
        timer = s[2] * 1000 if s[0] == "in_progress" else (at + self.retention) * 1000 if s[0] == "done" else None
        held = [before[2] * 1000] if before and before[0] == "in_progress" else list(self.handle.listTimers()) if before and before[0] == "done" else []
        for t in held:
            if t != timer:
                self.handle.deleteTimer(t)
        if timer is not None and timer not in held:
            self.handle.registerTimer(timer)

    @staticmethod
    def _row(key: Any, s: Fold, cause: str) -> Row:
        return Row(key=key, state=s[0], owner=s[1], ttl=s[2], retries=s[3], cause=cause)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self._read()
        s, at = before or START, 0
        for at, _, _, kind, owner in sorted(((r.at, r.seq is None, r.seq, r.kind, r.owner) for r in rows), key=itemgetter(0, 1, 2)):
            s, _ = step(s, at, kind, owner)
        self._write(before, s, at)
        yield self._row(key[0], s, "event")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s, at = self._read() or START, expiredTimerInfo.getExpiryTimeInMs() // 1000
        if s[0] == "in_progress" and s[2] <= at:
            s = ("pending", None, None, s[3])
            self.lease.update(s)
            yield self._row(key[0], s, "expiry")
        elif s[0] == "done":
            self.lease.clear()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str = "0 seconds", retention: int = RETENTION) -> DataFrame:
    """The same fold over a stream of events: a row per key and micro-batch with its state, and one when a lease runs out.

    Events may be late by ``late``; later ones are left out, as the timers of
    their time may have gone off.  The state lives in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = events.schema["key"].dataType.simpleString()
    timed = events.select("key", "at", "seq", "kind", "owner", F.timestamp_seconds("at").alias("__at")).withWatermark("__at", late)
    return timed.groupBy("key").transformWithState(LeaseProcessor(retention), f"key {kind}, {STATE}, cause string", "Update", "EventTime")


def admissions(requests: DataFrame, qps: int = 1, window: int = 60) -> DataFrame:
    """(key, seq, admitted): a request passes while fewer than qps * window passed in the last ``window`` seconds.

    ``requests`` has key, sec, seq; of one second the first in order pass.
    """
    per = requests.groupBy("key", "sec").agg(F.count(F.lit(1)).alias("asked"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sec")
        held: deque[tuple[int, int]] = deque()
        total, out = 0, []
        for sec, asked in g[["sec", "asked"]].itertuples(index=False):
            while held and held[0][0] <= sec - window:
                total -= held.popleft()[1]
            n = max(0, min(int(asked), qps * window - total))
            held.append((int(sec), n))
            total += n
            out.append(n)
        return pd.DataFrame({"key": g["key"], "sec": g["sec"], "room": out})

    kind = requests.schema["key"].dataType.simpleString()
    room = per.groupBy("key").applyInPandas(run, f"key {kind}, sec long, room long")
    order = F.row_number().over(Window.partitionBy("key", "sec").orderBy("seq"))
    return requests.withColumn("place", order).join(room, ["key", "sec"]).select("key", "seq", (F.col("place") <= F.col("room")).alias("admitted"))
