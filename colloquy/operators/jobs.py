"""Job snapshots: rows of (id, updated_at, status, total, done, accepted, failed), of which the newest of each id is the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def newest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each job; equal times go by the counts. Combined before the shuffle, so a busy job is no bottleneck."""
    names = [c for c in snapshots.columns if c != "id"]
    last = F.max(F.struct("updated_at", "done", *[c for c in names if c not in ("updated_at", "done")]))
    return snapshots.groupBy("id").agg(last.alias("s")).select("id", *[F.col(f"s.{c}").alias(c) for c in names])


def listing(snapshots: DataFrame, n: int = 50) -> DataFrame:
    """The n jobs updated last, with their progress in percent."""
    percent = F.round(F.lit(100.0) * F.col("done") / F.greatest(F.col("total"), F.lit(1)), 1)
    return newest(snapshots).withColumn("progress", percent).orderBy(F.desc("updated_at"), "id").limit(n)


def counters(snapshots: DataFrame) -> DataFrame:
    """(status, jobs, done, accepted, failed) over the newest snapshots."""
    return newest(snapshots).groupBy("status").agg(F.count("*").alias("jobs"), *[F.sum(c).alias(c) for c in ("done", "accepted", "failed")])


def interrupted(snapshots: DataFrame) -> DataFrame:
    """Jobs that a restart finds queued or running: they have failed."""
    out = newest(snapshots)
    return out.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "failed").otherwise(F.col("status")))
