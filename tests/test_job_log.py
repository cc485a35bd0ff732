"""The event log of jobs in a stream against a plain fold over the events."""

import random
import time
from datetime import datetime, timedelta

import pytest

from colloquy.streaming import jobs

EVENT = "id long, seq long, at timestamp, kind string, message string"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def some_events():
    rng, at, out = random.Random(9), datetime(2024, 1, 1), []
    for seq in range(400):
        at += timedelta(milliseconds=rng.choice([1, 5, 20, 400]))
        kind = rng.choices(["log", "done", "accepted", "failed", "status", None], [8, 4, 3, 1, 0.3, 0.3])[0]
        out.append((rng.randint(1, 4), seq, at, kind, rng.choice(["running", "done"]) if kind == "status" else f"m{seq}"))
    return out


def plain(events, every, pause, keep):
    state, out = {}, []
    for i, seq, at, kind, message in events:
        s = state.setdefault(i, {"status": "queued", "n": 0, "done": 0, "accepted": 0, "failed": 0, "dirty": 0, "shown": None, "logs": []})
        s["n"], s["dirty"] = s["n"] + 1, s["dirty"] + 1
        if kind in ("done", "accepted", "failed"):
            s[kind] += 1
        if kind == "status":
            s["status"] = message
        s["logs"] = [*s["logs"], seq][-keep:]
        if kind == "status" or s["dirty"] >= every or s["shown"] is None or (at - s["shown"]).total_seconds() * 1000 >= pause:
            s["dirty"], s["shown"] = 0, at
            out.append((i, at, s["status"], s["n"], s["done"], s["accepted"], s["failed"], tuple(s["logs"])))
    return sorted(out), state


def run(spark, tmp_path, batches, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.snapshots(stream, **options)
    writer = out.writeStream.option("checkpointLocation", f"{tmp_path}/at").format("parquet")
    if "idle_ms" in options:  # with timers a stream of available data has always another batch to run
        query = writer.trigger(processingTime="500 milliseconds").start(f"{tmp_path}/out")
        deadline = time.time() + 90
        while time.time() < deadline and sum(p["numInputRows"] == 0 for p in query.recentProgress[len(batches) :]) < 3:
            time.sleep(0.5)
        query.stop()
    else:
        writer.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(300)
    rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    return sorted((r["id"], r["updated_at"], r["status"], r["updates"], r["done"], r["accepted"], r["failed"], tuple(x["seq"] for x in r["logs"])) for r in rows)


@pytest.mark.parametrize("every,pause,keep", [(25, 1000, 12), (3, 10**6, 5)])
def test_snapshots_and_retention(rocks, tmp_path, every, pause, keep):
    events = some_events()
    batches = [events[:150], events[100:300], events[300:]]  # some come again
    want, _ = plain(events, every, pause, keep)
    got = run(rocks, tmp_path, [*batches, [(None, 1, datetime(2024, 1, 1), "log", "x")]], every=every, pause_ms=pause, keep=keep)
    assert got == want and max(len(r[-1]) for r in got) == keep and len(want) < 400


def test_what_is_left_comes_out_by_timer(rocks, tmp_path):
    events = some_events()[:120]
    _, state = plain(events, 10**6, 10**9, 8)
    later = [(99, 0, datetime(2025, 1, 1), "log", "other job")]
    got = run(rocks, tmp_path, [events, later], every=10**6, pause_ms=10**9, keep=8, idle_ms=1)
    last = {r[0]: r for r in sorted(got, key=lambda r: r[3])}
    assert {i: last[i][3] for i in state} == {i: s["n"] for i, s in state.items()} and all(last[i][-1] == tuple(s["logs"]) for i, s in state.items())
