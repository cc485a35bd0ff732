"""The event log of jobs as keyed state: counters, the last few events, and snapshots that are written now and then.

A job's snapshot comes out after every 25th update, or at the first update a second or more after the one before, or at once
where its status changes. What is left over after that comes out when nothing has happened for a while, if timers are on.
`jobs.newest` of the snapshots is the state of each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTED = ("done", "accepted", "failed")
_EVENT = "struct<seq: long, at: timestamp, kind: string, message: string>"
_FIELDS = ["id", "updated_at", "status", "updates", *COUNTED, "logs"]


class _Log(StatefulProcessor):
    def __init__(self, every: int, pause_ms: int, keep: int, idle_ms: int | None, ttl_ms: int | None):
        self.every, self.pause, self.keep, self.idle, self.ttl = every, pause_ms, keep, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = f"seq long, at timestamp, status string, updates long, done long, accepted long, failed long, dirty long, shown timestamp, logs array<{_EVENT}>"
        self.state = handle.getValueState("job", schema, self.ttl) if self.ttl else handle.getValueState("job", schema)

    def _row(self, key: tuple, now: list) -> tuple:
        return (key[0], now[1], now[2], now[3], now[4], now[5], now[6], list(now[9]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        now = list(self.state.get()) if self.state.exists() else [-1, None, "queued", 0, 0, 0, 0, 0, None, []]
        now[9], out = [tuple(x) for x in now[9]], []
        for seq, at, kind, message in zip(batch["seq"], batch["at"], batch["kind"], batch["message"], strict=True):
            if int(seq) <= now[0]:
                continue  # it came before
            at = at.to_pydatetime()
            now[0], now[1], now[3], now[7] = int(seq), at, now[3] + 1, now[7] + 1
            if kind in COUNTED:
                now[4 + COUNTED.index(kind)] += 1
            if kind == "status":
                now[2] = message
            now[9] = [*now[9], (int(seq), at, kind, message)][-self.keep :]
            if kind == "status" or now[7] >= self.every or now[8] is None or (at - now[8]).total_seconds() * 1000 >= self.pause:
                now[7], now[8] = 0, at
                out.append(self._row(key, now))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if now[7]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self.state.update(tuple(now))
        yield pd.DataFrame(out, columns=_FIELDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, ARG002, N802, N803
        now, out = list(self.state.get()), []
        if now[7]:
            now[7], now[8], now[9] = 0, now[1], [tuple(x) for x in now[9]]
            out.append(self._row(key, now))
            self.state.update(tuple(now))
        yield pd.DataFrame(out, columns=_FIELDS)

    def close(self) -> None:
        pass


def snapshots(events: DataFrame, *, every: int = 25, pause_ms: int = 1000, keep: int = 120, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Snapshots (id, updated_at, status, updates, done, accepted, failed, logs) from a stream of events (id, seq, at, kind, message).

    Kinds done, accepted and failed are counted, status sets the status to its message, any other is only logged; the first event of a job
    shows at once. Events go by seq, which grows within a job: one that is not after the last one seen is left out, so a
    batch that comes again adds nothing. logs are the last `keep` events. idle_ms turns timers on. ttl_ms ends the state of a job
    that no event has touched for so long. Needs the RocksDB state store. Events without id, seq or time are left out.
    """
    own = events.where("id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").select("id", F.col("seq").cast("long").alias("seq"), "at", F.col("kind").cast("string").alias("kind"), F.col("message").cast("string").alias("message"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, updated_at timestamp, status string, updates long, done long, accepted long, failed long, logs array<{_EVENT}>"
    mode = "ProcessingTime" if idle_ms is not None or ttl_ms else "None"
    return own.groupBy("id").transformWithStateInPandas(_Log(every, pause_ms, keep, idle_ms, ttl_ms), schema, "Append", mode)
