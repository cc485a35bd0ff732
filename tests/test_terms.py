"""Terms by table against the lists' expressions and a plain count."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import terms
from colloquy.functions.lexicons import DEFAULT
from colloquy.operators import scoring
from colloquy.operators.messages import MESSAGES

LX = DEFAULT.with_domains({"food": ["火锅", "好吃", "哈哈"], "games": ["游戏", "打游戏"], "new": ["ai模型", "星"]})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    bits = ["今晚火锅", "哈哈哈哈哈", "打游戏吗", "AI模型", "星星", "washing machine", "washing  machine", "brushed off", "Cats", "cat", "ai", "AIs", "dinner,", "the_boss", "boss.", "boss", "\n", "😀", "old song", "chat logs chat logs", "é", "flower shopping", "flower shop"]
    out = ["".join(b + rng.choice(["", " ", " ", "，"]) for b in rng.choices(bits, k=rng.randint(0, 12))) for _ in range(60)]
    return [(i, t) for i, t in enumerate([*out, None, "", "😀" * 5000 + "火锅" + "y" * 4094 + " boss", "old song" * 2000])]


def plain(text, lexicon):
    low, out = (text or "").lower(), {}
    for category, term, kind in lexicon:
        n = low.count(term) if kind == "part" else len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", low))
        if n:
            out[category] = out.get(category, 0) + n
    return out


def test_counts(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    lexicon = terms.from_domains(spark, LX)
    rows = [tuple(r) for r in lexicon.collect()]
    assert len(rows) == len(set(rows)) and ("food", "火锅", "part") in rows and ("social", "chat logs", "word") in rows
    got = {r["id"]: r["counts"] for r in terms.category_maps(df, lexicon).collect()}
    assert got == {i: c for i, t in texts if (c := plain(t, rows))} and len(got) > 40


def test_kinds_files_and_blanks(spark, tmp_path):
    rows = [("a", "Hype", "part"), ("a", "hype", "part"), ("b", "no way!", "word"), ("b", " ", "word"), (None, "x", "word"), ("c", None, "part"), ("d", "!!", "part"), ("e", "way", None)]
    spark.createDataFrame(rows, terms.LEXICON).coalesce(1).write.option("header", "true").csv(f"{tmp_path}/lexicon.csv")
    lexicon = terms.read_lexicon(spark, f"{tmp_path}/lexicon.csv")
    assert sorted(r["term"] for r in lexicon.collect()) == ["!!", "hype", "no way!", "way"]
    df = spark.createDataFrame([(1, "HYPEhype no way! No way!! !!!!"), (2, "nothing"), (None, "hype")], "id long, text string")
    assert {(r["id"], r["category"]): r["hits"] for r in terms.category_counts(df, lexicon).collect()} == {(1, "a"): 2, (1, "b"): 2, (1, "d"): 3, (1, "e"): 2}
    assert terms.category_counts(df, lexicon.where("false")).collect() == [] and terms.category_counts(df.where("false"), lexicon).collect() == []


def test_large_lexicons_are_joined_without_broadcast(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "id long, text string")
    lexicon = terms.from_domains(spark, LX)
    want = sorted(map(tuple, terms.category_counts(df, lexicon).collect()))
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, terms.category_counts(df, lexicon).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_drift_of_chinese_talks_is_that_of_the_lists(spark, texts):
    rng = random.Random(3)
    talks = [(i, [(r, rng.choice(texts)[1] or "") for r in ("user", "assistant") * rng.randint(0, 6)], rng.choice(["火锅", "the boss", None]), rng.choice(["low", "high", None])) for i in range(25)]
    df = spark.createDataFrame(talks, f"id long, messages {MESSAGES}, spec string, tier string")
    spec = {"spec_text": F.col("spec"), "tier": F.col("tier")}
    cols = ["id", "drift_counts", "drift_entropy", "drift_unexpected", "drift_recent_unexpected", "drift_severity"]
    listed = scoring.drift_columns(df, lx=LX, **spec).select(cols)
    tabled = scoring.drift_by_terms(df, terms.from_domains(spark, LX), id_col="id", lx=LX, **spec).select(cols)
    key = lambda r: (r["id"], sorted(r["drift_counts"].items()), *r[2:])
    got = sorted(map(key, tabled.collect()))
    assert got == sorted(map(key, listed.collect())) and len({r[5] for r in got}) > 3


def test_more_terms_do_not_grow_the_plan(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string")
    more = spark.range(10_000).select(F.lit("more").alias("category"), F.concat(F.lit("词"), F.col("id").cast("string")).alias("term"))
    nodes = lambda lexicon: len(re.findall(r"^[ :]*[+:]- ", terms.category_counts(df, lexicon)._jdf.queryExecution().optimizedPlan().toString(), re.M))
    few = spark.range(10).select(F.lit("more").alias("category"), F.concat(F.lit("词"), F.col("id").cast("string")).alias("term"))
    assert nodes(more) == nodes(few)
