"""Replies unlike what was said, against a plain version."""

import hashlib
import random

from pyspark.sql import functions as F

from colloquy.functions import similarity
from colloquy.operators import replies
from colloquy.operators.messages import MESSAGES

LINES = ["what happened then?", "What happened, then", "go on", "and you?", "hm", "that is what happened then", "我还没缓过来", "我还没缓过来啊", "...", " ", None]


def plain(key, candidates, said, like, fallback):
    compact = lambda t: similarity._COMPACT.sub("", (t or "").lower())
    own = list(dict.fromkeys(c.strip() for c in candidates or [] if c and c.strip()))
    own.sort(key=lambda c: (hashlib.sha256(f"{key}:{c}".encode()).hexdigest(), c))
    fresh = [c for c in own if all(similarity.ratio(compact(c), compact(s)) < like for s in said or [])]
    return (fresh or (own if fallback else []) or [None])[0]


def test_unlike(spark):
    rng = random.Random(6)
    rows = [(i, rng.choices(LINES, k=rng.randint(0, 5)) if i % 9 else None, rng.choices(LINES, k=rng.randint(0, 5)) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, c array<string>, s array<string>").repartition(3)
    for like, fallback in ((replies.LIKE, False), (replies.LIKE, True), (1.0, False)):
        got = {r["id"]: r["x"] for r in replies.unlike(df, "x", F.col("c"), F.col("s"), F.col("id"), like=like, fallback=fallback).collect()}
        assert got == {i: plain(i, c, s, like, fallback) for i, c, s in rows}
    assert sum(v is None for v in got.values()) > 5 and len(set(got.values())) > 5


def test_local_replies(spark):
    talk = lambda *m: [("user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(m)]
    rows = [(1, [], 0), (2, talk("hey", "how was work", "fine"), 9), (3, talk("hey", "As an AI, if you need help"), 3), (4, talk("tell me of the sea today", "tell me of the sea today!"), 3), (5, talk("go on", "blue"), 3), (6, talk("go on", "x", "and you", "y"), 3)]
    df = spark.createDataFrame(rows, f"id long, messages {MESSAGES}, turn int")
    pools = [("opening", "en", "hi there"), ("ending", "en", "later then"), ("plain", "en", "say it simply"), ("continuation", "en", "go on"), ("continuation", "en", "and you?"), ("continuation", "zh", "然后呢"), ("continuation", "en", None)]
    out = replies.local_replies(df, spark.createDataFrame(pools, "pool string, language string, text string"), turn=F.col("turn"), most=F.lit(10), english=F.lit(True))
    got = {r["id"]: r["reply"] for r in out.collect()}
    assert [got[i] for i in range(1, 6)] == ["hi there", "later then", "say it simply", "say it simply", "and you?"] and got[6] in ("go on", "and you?")
    assert out.columns == ["id", "messages", "turn", "reply"]
    none = replies.local_replies(df, spark.createDataFrame(pools, "pool string, language string, text string"), turn=F.col("turn"), most=F.lit(10), english=F.lit(False))
    assert {r["id"]: r["reply"] for r in none.collect()} == {1: None, 2: None, 3: None, 4: None, 5: "然后呢", 6: "然后呢"}
