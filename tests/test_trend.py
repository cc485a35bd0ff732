"""The running trend against the trend of each prefix, in a batch and in a stream."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import similarity
from colloquy.functions import text as tx
from colloquy.functions.lexicons import DEFAULT
from colloquy.operators import scoring, trend

LX = DEFAULT.with_domains({"food": ["火锅", "吃饭"], "games": ["游戏"]})
PARTS = ["make some memories", "awesome 😊😊😍", "I am scared", "啧 哼", "the boss called", "dinner was cold", "今晚火锅吧", "my cat and a song", "subway rain", "go go go go go go go go go go go go", "plain words", "打游戏 吗", "yes", "sleep well, goodbye"]


def talk(rng, n):
    return [("user" if k % 2 == 0 else "assistant", " ".join(rng.choices(PARTS, k=rng.randint(0, 4)))) for k in range(n)]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    out = {i: talk(rng, n) for i, n in enumerate([1, 2, 3, 9, 14, 30])}
    out[6] = [(r, "the same opening each time, with " + t) for r, t in talk(rng, 12)]
    out[7] = [("assistant", "one"), ("system", "s"), ("assistant", "two"), ("user", ""), ("assistant", None), ("tool", "x")]
    out[8] = talk(rng, 240)
    return out


def turns_of(spark, talks):
    rows = [(i, k, r, t, "u") for i, said in talks.items() for k, (r, t) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")


def plain(talks, lx, with_similarity=True):
    """By the definition: for each answer the measures of all that was said up to it."""
    count = lambda t, terms: sum(t.lower().count(x.lower()) for x in terms)
    emoji = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), tx.lx.EMOJI))
    compact = lambda t: similarity._COMPACT.sub("", t.lower())

    def domains(t):
        out = {}
        for d, terms in lx.domains.items():
            n = sum(t.lower().count(x.lower()) if re.search("[一-鿿]", x) else len(re.findall(rf"(?<!\w){re.escape(x.lower())}(?!\w)", t.lower())) for x in terms)
            if n:
                out[d] = n
        return out

    def looped(t):
        c = compact(t)
        g = [c[i : i + 4] for i in range(len(c) - 3)]
        return len(c) >= 16 and 1 - len(set(g)) / len(g) > 0.46

    allowed = {"social", "emotion_attachment", "ai_relationship", "work"}
    rows = []
    for i, said in talks.items():
        said = [(k, r, t or "") for k, (r, t) in enumerate(said) if r in ("user", "assistant")]
        for end in range(1, len(said) + 1):
            if said[end - 1][1] != "assistant":
                continue
            own = said[:end]
            answers = [t for _, r, t in own if r == "assistant"]
            n = len(answers)
            formula = sum(len(re.findall(p, t, re.I | re.S)) for t in answers for p in lx.formulas)
            hype, vulnerable, tense, faces = sum(count(t, lx.trend_hype) for *_, t in own), sum(count(t, lx.vulnerability) for t in answers), sum(count(t, lx.tension) for t in answers), sum(len(emoji.findall(t)) for t in answers)
            heads = [compact(t[:90]) for t in answers[-4:]]
            alike = sum(similarity.ratio(a, b) > 0.58 for a, b in zip(heads, heads[1:], strict=False)) if with_similarity else 0
            value = (2.5 + min(3.0, formula * 0.6) if formula >= 2 else 0) + (2.0 if len(heads) >= 3 and alike >= 2 else 0)
            value += 2.0 if n >= 4 and faces / n >= 1.8 and hype >= 8 and not vulnerable else 0
            value += (1.4 if n >= 5 and not tense and not vulnerable else 0) + (1.4 if any(map(looped, answers[-3:])) else 0)
            seen, recent = domains("\n".join(t for *_, t in own)), domains("\n".join(t for *_, t in own[-4:]))
            total = sum(seen.values())
            entropy = round(sum(-(k / total) * math.log2(k / total + 1e-9) for k in seen.values()), 3)
            far = len(set(recent) - allowed)
            drift = (2.2 + 0.35 * far if far >= 2 else 0.8 if far == 1 and len(own) >= 8 else 0) + (1.4 if len(seen) >= 5 and entropy >= 1.75 else 0) + (1.2 if len(set(seen) - allowed) >= 3 else 0)
            rows.append((i, own[-1][0], n, round(value + round(drift, 2), 2), round(drift, 2), formula, faces, hype, vulnerable, tense, tuple(sorted(seen.items()))))
    return sorted(rows)


def found(df):
    cols = ("formula_hits", "emoji_hits", "hype_hits", "vulnerability_hits", "tension_hits")
    return sorted((r["id"], r["turn"], r["nth"], r["severity"], r["drift_severity"], *(r[c] for c in cols), tuple(sorted(r["drift_counts"].items()))) for r in df.collect())


@pytest.fixture(scope="module")
def want(talks):
    rows = plain(talks, LX)
    assert len({r[3] for r in rows}) > 8 and max(r[3] for r in rows) > 6
    return rows


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_batch(spark, talks, want, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        turns = turns_of(spark, talks)
        again = turns.unionByName(turns.where("turn % 3 = 0")).unionByName(turns.limit(1).withColumn("turn", F.lit(None).cast("long")))
        assert found(trend.by_turn(again, lx=LX)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batch_without_similarity_and_of_nothing(spark, talks):
    few = {k: talks[k] for k in (4, 6)}
    assert found(trend.by_turn(turns_of(spark, few), lx=LX, with_similarity=False)) == plain(few, LX, False)
    assert trend.by_turn(turns_of(spark, talks).where("false")).collect() == []


def test_plans_allow_domains(spark, talks):
    turns = turns_of(spark, {4: talks[4]})
    free = trend.by_turn(turns, lx=LX, spec=F.lit("dinner, the boss, a cat, a song, the subway, sleep and a game"), tier=F.lit("high"))
    assert max(r["drift_severity"] for r in free.collect()) < max(r["drift_severity"] for r in trend.by_turn(turns, lx=LX).collect())


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_stream(spark, talks, want, tmp_path, step):
    few = {k: v[:24] for k, v in talks.items()}
    turns = turns_of(spark, few)
    cuts = sorted({k // step for v in few.values() for k in range(len(v))})
    for c in cuts[:6]:
        turns.where(F.floor(F.col("turn") / step) == c).coalesce(1).write.parquet(f"{tmp_path}/in/{c:04d}")
    turns.where(F.floor(F.col("turn") / step) > cuts[:6][-1]).coalesce(1).write.parquet(f"{tmp_path}/in/9998")
    turns.where("turn < 3").coalesce(1).write.parquet(f"{tmp_path}/in/9999")  # said before: adds nothing
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        running = trend.stream_by_turn(stream, lx=LX)
        running.writeStream.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination(400)
    finally:
        spark.conf.unset(provider)
    assert found(spark.read.parquet(f"{tmp_path}/out")) == plain(few, LX)


def test_ratio_bound_never_hides_a_pair(spark):
    rng = random.Random(1)
    words = lambda alphabet: "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
    rows = [(words("abcd"), words("abcd")) for _ in range(80)] + [(words("ab😀"), words("火锅游戏")) for _ in range(40)] + [("same text", "same text!"), ("", ""), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    for limit in (0.55, 0.86):
        got = similarity.with_ratios(df.withColumn("may", similarity.ratio_bound(F.col("a"), F.col("b"), limit)), "r", F.array("a"), F.array("b"), limit).withColumn("r", F.col("r")[0]).collect()
        for r in got:
            exact = similarity.ratio(r["a"], r["b"])
            assert (exact <= limit or (r["may"] and r["r"] == exact)) and (r["r"] in (0.0, exact))
        assert any(not r["may"] for r in got)
