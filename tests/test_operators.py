import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dedup, planning, report, review, scoring, store
from colloquy.operators import messages as ms
from colloquy.sources import backend, files

M = "array<struct<role:string,content:string>>"


def talk(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def frame(spark, *messages):
    return spark.createDataFrame([(i, m) for i, m in enumerate(messages)], f"id long, messages {M}")


def values(df, column):
    return [r.v for r in df.select("id", column.alias("v")).orderBy("id").collect()]


U, A, S = "user", "assistant", "system"


def test_turns_to_messages(spark):
    turns = spark.createDataFrame([(1, 2, A, "b"), (1, 1, U, "a"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in ms.from_turns(turns).collect()}
    assert got == {1: [(U, "a"), (A, "b")], 2: [("", "")]}


def test_dialects(spark):
    raw = ['{"conversations":[{"from":"human","value":" hi "},{"from":"gpt","value":"yo"},{"from":"x","value":"z"},{"from":"bot","value":""}]}', '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}', "{}"]
    df = spark.createDataFrame(list(enumerate(raw)), "id long, t string")
    got = values(df, ms.normalize(F.col("t"), "sys"))
    assert [[tuple(m) for m in g] if g else g for g in got] == [[(S, "sys"), (U, "hi"), (A, "yo")], [(S, "s"), (U, "u")], None]


def test_trim_ends_with_an_answer(spark):
    m = talk((S, "s"), (A, "early"), (U, "1"), (A, "a1"), (U, "2"), (U, "2b"), (A, "a2"), (U, "4"))
    df = frame(spark, m, talk((U, "x")), [])
    assert [[x.content for x in v] for v in values(df, ms.trim_at_user_turn(F.col("messages"), 1))] == [["s", "1", "a1"], [], []]
    assert [x.content for x in values(df, ms.trim_at_user_turn(F.col("messages"), 3))[0]] == ["s", "1", "a1", "2", "2b", "a2"]
    assert [x.content for x in values(df, ms.trim_at_user_turn(F.col("messages"), 9))[0]][-1] == "a2"


def test_role_scores(spark):
    df = frame(spark, [], talk((U, "a"), (A, "b")), talk((S, "s"), (U, "a"), (A, "b"), (U, "c"), (A, "d")), talk((A, "a"), (U, "b"), (A, "c"), (U, "d")))
    assert values(df, scoring.role_sequence(F.col("messages"))) == [0.0, 3.0, 10.0, 0.0]


def test_length_buckets(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([349, 350, 599, 600, 9000, 9001, 12000, 12001])], "id long, n int")
    assert values(df, scoring.length_bucket(F.col("n"))) == [4.0, 7.0, 7.0, 10.0, 10.0, 7.0, 7.0, 4.0]


def test_parrots_count_at_even_places_only(spark):
    said = "tell me about the weather in the mountains today"
    even = talk((U, said), (A, said), (U, "other words entirely"), (A, "something new"))
    odd = talk((U, "first"), (U, said), (A, said), (U, "last one"))
    got = {r.id: r for r in scoring.heuristic_review(frame(spark, even, odd)).collect()}
    assert got[0].parrot and got[0].status == "rejected" and not got[1].parrot


def test_non_sequitur(spark):
    pairs = [(f"the {w} question", "completely unrelated statement here") for w in ("apple", "river", "stone", "cloud")]
    bad = talk(*[x for u, a in pairs for x in ((U, u), (A, a))])
    fine = talk(*[x for u, _ in pairs for x in ((U, u), (A, "hmm " + u))])
    assert values(frame(spark, bad, fine), scoring.non_sequitur(F.col("messages"))) == [8.0, 0.0]


def test_leaks_are_rejected(spark):
    m = talk(*[x for i in range(8) for x in ((U, f"hi number {i}?"), (A, f"request_heartbeat {i}"))])
    got = scoring.heuristic_review(frame(spark, m), with_similarity=False).first()
    assert got.status == "rejected" and got.prompt_leakage > 0
    walled = review.review(frame(spark, m, [], talk((U, "a"), (A, "b")))).orderBy("id").collect()
    assert [r.reviewer for r in walled] == ["hardwall", "hardwall", "no_judge"]


def test_verdict_trim_and_upgrade(spark):
    m = talk(*[x for i in range(6) for x in ((U, f"u{i}"), (A, f"a{i}"))])
    df = frame(spark, m).withColumn("answer", F.lit('x {"scores":{"a":7.0,"b":8.0},"status":"needs_review","overall":7.2,"trim_after_user_turn":4} y'))
    got = review.review(df, review.parse_verdict(F.col("answer"))).first()
    assert (got.status, got.removed_user_turns, len(got.messages)) == ("accepted", 2, 8)
    kept = review.review(df, review.parse_verdict(F.col("answer")), trim=False).first()
    assert (kept.status, len(kept.messages)) == ("needs_review", 12)


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew potions at midnight " * 3
    texts = [base, "entirely different words about ships and harbours in the northern sea", base.upper(), base + "zq", "ab" * 30, "ab" * 400, "", " ", base[:-9]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.duplicate_of for r in dedup.near_duplicates(df, "id", "t").collect()}
    assert got == {2: 0, 3: 0, 7: 6, 8: 0}
    full = {r.id: (r.duplicate_of, r.similarity) for r in dedup.near_duplicates(df, "id", "t", with_sequence=True).collect()}
    assert set(full) == {2, 3, 7, 8} and all(s >= 0.88 for _, s in full.values())
    one = dedup.find_duplicate(base + "!", df, "id", "t").first()
    assert one.duplicate and one.duplicate_of == 0


def test_upsert_keeps_created_at(spark):
    cols = "id long, created_at string, updated_at string, score double"
    old = spark.createDataFrame([(1, "a", "a", 1.0), (2, "b", "b", 2.0)], cols)
    new = spark.createDataFrame([(1, "z", "z", 9.0), (3, "y", "y", 3.0), (2, "a", "a", 0.0)], cols)
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [(1, "a", "z", 9.0), (2, "a", "b", 2.0), (3, "y", "y", 3.0)]


def test_validate_raises_on_unknown_status(spark):
    df = frame(spark, talk((U, " a "), (A, " "))).withColumns({"status": F.lit("accepted"), "score": F.lit(12.0)})
    row = store.validate(df).first()
    assert row.score == 10.0 and [tuple(m) for m in row.messages] == [(U, "a")]
    with pytest.raises(Exception, match="unknown status"):
        store.validate(df.withColumn("status", F.lit("odd"))).collect()


def test_quotas(spark):
    for n in (1, 2, 3, 7, 100):
        got = {r.tier: r.n for r in planning.tier_quotas(spark, n).collect()}
        assert sum(got.values()) == n and (n < 3 or min(got.values()) >= 1)
    topics = spark.createDataFrame([(t, f"{t}_{i}") for t in ("low", "mid", "high") for i in range(3)], "tier string, topic_id string")
    plan = planning.plan(spark, topics, 20).collect()
    assert len(plan) == 20 and {r.position for r in plan} == set(range(1, 21)) and all(8 <= r.turns <= 18 for r in plan)
    first = [r.topic_id for r in planning.topic_rounds(topics, planning.tier_quotas(spark, 20), spark.createDataFrame([("low_0", 5)], "topic_id string, seen int")).where("tier = 'low' AND nth <= 2").collect()]
    assert "low_0" not in first


def test_mirrors_and_exports(spark, tmp_path):
    df = frame(spark, talk((U, "a"), (A, "é")), talk((U, "b"), (A, "c")), talk((U, "x"))).select(F.col("id").cast("string").alias("id"), F.lit("t0").alias("created_at"), F.concat(F.lit("t"), "id").alias("updated_at"), F.when(F.col("id") == 2, "rejected").otherwise("accepted").alias("status"), F.lit(8.0).alias("score"), "messages", F.lit("teacher").alias("source"), F.lit(None).cast("string").alias("duplicate_of"))
    files.write_mirrors(df, f"{tmp_path}/m")
    (tmp_path / "m/folder=raw").mkdir(exist_ok=True)
    (tmp_path / "m/folder=raw/bad.json").write_text("{broken\n")
    (tmp_path / "m/folder=reviewed/more.json").write_text('{"id":"9"}\n')
    back = {r.id: r for r in files.read_mirrors(spark, f"{tmp_path}/m").collect()}
    assert set(back) == {"0", "1", "2", "9"} and back["9"].status == "accepted" and back["2"].status == "rejected"
    assert {r["status"]: r["count"] for r in files.rebuild(spark, f"{tmp_path}/m", f"{tmp_path}/table").collect()} == {"accepted": 3, "rejected": 1}
    files.write_training_sets(df, f"{tmp_path}/out")
    lines = [json.loads(x) for p in (tmp_path / "out/sharegpt").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert [r["id"] for r in lines] == ["1", "0"] and lines[1]["conversations"][1] == {"from": "gpt", "value": "é"}
    with pytest.raises(ValueError):
        files.write_training_sets(df.where("false"), f"{tmp_path}/none")
    book = json.loads(files.write_notebook(tmp_path / "n.ipynb", model="m").read_text())
    assert book["nbformat"] == 4 and len(book["cells"]) == 5
    with pytest.raises(ValueError):
        files.write_notebook(tmp_path / "n.ipynb", model="m", mode="odd")


def test_backend_failures_are_null(spark):
    def odd(messages):
        if not messages:
            raise RuntimeError("no messages")
        return messages[-1]["content"]

    df = backend.complete(frame(spark, talk((U, "a")), []), "messages", odd)
    assert [r.answer for r in df.orderBy("id").collect()] == ["a", None]
    specs = spark.createDataFrame([("s", 3)], "spec string, turns int")
    assert len(backend.generate(specs).first().messages) == 6
    assert backend.endpoint("http://h/v1/") == "http://h/v1/chat/completions" == backend.endpoint("http://h")


def test_confusion_and_histograms(spark):
    a = spark.createDataFrame([(1, "accepted", 8.0), (2, "rejected", 2.0)], "id long, status string, score double")
    b = spark.createDataFrame([(1, "accepted", 8.1), (2, "accepted", 8.0)], "id long, status string, score double")
    assert sorted(map(tuple, report.confusion(a, b).collect())) == [("accepted", "accepted", 1, 1), ("rejected", "accepted", 1, 1)]
    assert sorted(map(tuple, report.histograms(a, ("status",)).collect())) == [("status", "accepted", 1), ("status", "rejected", 1)]


def test_stream_dedup(spark, tmp_path):
    from colloquy.streaming.dedup import dedup_stream

    for n, rows in enumerate([[(1, "Hello."), (2, "hello"), (3, "x")], [(4, "HELLO!"), (5, "y")]]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
        query = dedup_stream(stream, f"{tmp_path}/seen", f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [[1, 3], [1, 3, 5]][n]


def test_records_that_cannot_be_read_are_set_aside(spark, tmp_path):
    (tmp_path / "m" / "folder=raw").mkdir(parents=True)
    (tmp_path / "m" / "folder=raw" / "a.json").write_text('{"id": "x", "score": 2.0}\n{"id": "y", "sco\n{"score": 1.0}\n')
    assert {r["status"]: r["count"] for r in files.rebuild(spark, f"{tmp_path}/m", f"{tmp_path}/t").collect()} == {"needs_review": 1}
    aside = spark.read.parquet(f"{tmp_path}/t_corrupt").collect()
    assert sorted(str(r["_corrupt"]) for r in aside) == ["None", '{"id": "y", "sco'] and all(r.scan.endswith("a.json") for r in aside)


def test_notebook_targets(tmp_path):
    known = {"small": "org/small-8b"}
    assert "org/small-8b" in files.write_notebook(tmp_path / "n.ipynb", model="small", targets=known).read_text()
    with pytest.raises(ValueError, match="small"):
        files.write_notebook(tmp_path / "n.ipynb", model="other", targets=known)


def test_failed_requests_say_why(spark):
    def odd(messages):
        if not messages:
            raise RuntimeError("nothing said")
        return ""

    got = {r.id: (r.answer, r.why) for r in backend.complete(frame(spark, talk((U, "a")), []), "messages", odd, error="why").collect()}
    assert got == {0: ("", None), 1: (None, "RuntimeError: nothing said")}


def test_refused_connections_are_tried_again(monkeypatch):
    tried = []

    def refuse(*_, **__):
        tried.append(1)
        raise backend.urllib.error.URLError("refused")

    monkeypatch.setattr(backend.urllib.request, "urlopen", refuse)
    with pytest.raises(backend.urllib.error.URLError):
        backend.HttpBackend("http://localhost:1/v1", "m", retries=2, backoff=0.0)([])
    assert len(tried) == 3


def test_stop_lists(spark):
    rows = [(1, ["a", "", "b", "a"]), (2, ["c", "b", "a", "d"]), (3, None)]
    df = spark.createDataFrame(rows, "i int, s array<string>")
    assert {r.i: r.v for r in df.select("i", backend.stop_list(F.col("s"), ("a", "z"), 2).alias("v")).collect()} == {1: ["a", "b"], 2: ["a", "c"], 3: []}
    assert {r.i: r.v for r in df.select("i", backend.stop_list(F.col("s"), limit=0).alias("v")).collect()} == {1: [], 2: [], 3: []}
