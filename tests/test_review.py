"""Review and planning operators that no query's SQL covers: likeness to a transcript, focus, clauses, quotas."""

from pyspark.sql import functions as F

from colloquy.functions import similarity
from colloquy.functions.lexicons import DEFAULT
from colloquy.operators import planning, review, scoring

M = "array<struct<role:string,content:string>>"


def said(*turns):
    return [{"role": r, "content": t} for r, t in turns]


def test_messages_against_their_transcript(spark):
    talk = said(("user", "shall we get hotpot tonight"), ("assistant", "oh the spicy one near the river sounds nice"), ("user", "yes that one"), ("assistant", "bring a jacket, it is windy there"))
    rows = [(1, "shall we get hotpot tonight", "fine"), (2, "bring a jacket it is windy there", "fine"), (3, "maybe later then", "maybe later then!"), (4, "what else", "bring a jacket, it's windy there")]
    df = spark.createDataFrame([(i, u, a, talk) for i, u, a in rows], f"i int, u string, a string, m {M}")
    got = {r.i: (r.p, r.q) for r in df.select("i", review.user_message_problem(F.col("u"), F.col("m")).alias("p"), review.assistant_message_problems(F.col("a"), F.col("u"), F.col("m")).alias("q")).collect()}
    assert got == {1: ("like before", []), 2: ("parrot", []), 3: (None, ["parrot"]), 4: (None, ["like before"])}


def test_topic_focus(spark):
    talk = said(("user", "dinner was late"), ("assistant", "my boss called about the deadline"))
    rows = [(1, "the cockroach is back"), (2, "yeah, exactly"), (3, "the game made me sad"), (4, "boss again? the deadline"), (5, " ")]
    df = spark.createDataFrame([(i, t, talk) for i, t in rows], f"i int, t string, m {M}")
    got = {r.i: r.p for r in df.select("i", review.topic_focus_problem(F.col("t"), F.col("m"), F.lit("dinner"), F.lit("low")).alias("p")).collect()}
    assert got == {1: "pets_animals", 2: None, 3: None, 4: None, 5: "empty"}


def test_domains_of_another_language(spark):
    lx = DEFAULT.with_domains({"food": ["火锅"], "new": ["星星"]})
    row = spark.range(1).select(scoring.tx.domain_counts(F.lit("今晚火锅，火锅！星星 dinner"), lx.domains).alias("d")).first()
    assert row.d == {"food": 3, "new": 1}


def test_reasons_and_tags(spark):
    good = said(*[(r, f"{r} talks about the weather and dinner number {k}, and how was yours?") for k in range(8) for r in ("user", "assistant")])
    bad = said(("user", "I understand."), ("assistant", "As an AI, how can I assist you today? thoughts"))
    df = spark.createDataFrame([(1, good, ["calm", "calm", "dry"], "kitchen", "{}"), (2, bad, [], None, '{"tag": "x"}')], f"id int, messages {M}, style_tags array<string>, scene string, metadata_json string")
    got = {r.id: r for r in scoring.heuristic_review(df).collect()}
    assert got[1].tags == ["calm", "dry", "kitchen"] and got[2].tags == []
    assert {"leakage", "length", "template"} <= set(got[2].reasons) and got[2].status == "rejected"


def test_clauses():
    assert similarity.keep_new_clauses("good night, good night! see you tomorrow.") == "good night, see you tomorrow."
    assert similarity.keep_new_clauses("你好，你好，再见。") == "你好，再见。"
    assert similarity.keep_new_clauses("a, b, c", most=2) == "a, b," and similarity.keep_new_clauses("，，") == "，，" and similarity.keep_new_clauses(None) == ""


def test_quotas(spark):
    def quotas(n, **w):
        return {r.tier: r.n for r in planning.tier_quotas(spark, n, w or None).collect()}

    assert quotas(1) == {"low": 0, "mid": 1, "high": 0} and quotas(3) == {"low": 1, "mid": 1, "high": 1}
    assert quotas(100) == {"low": 40, "mid": 40, "high": 20} and quotas(7, low=1.0, mid=0.0, high=0.0) == {"low": 5, "mid": 1, "high": 1}
    assert planning.tier_weights("40,40,20") == {"low": 0.4, "mid": 0.4, "high": 0.2} == planning.tier_weights("a") == planning.tier_weights(None)


def test_openings(spark):
    themes = spark.createDataFrame([(1, "Late at the Subway"), (2, "quiet"), (3, None)], "i int, t string")
    assert {r.i: r.o for r in themes.select("i", review.opening(F.col("t"), [("subway", "my shoes are soaked")], lower=True).alias("o")).collect()} == {1: "my shoes are soaked", 2: None, 3: None}
