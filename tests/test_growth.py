"""What keeps the cost of a query in proportion to its input: texts cleaned, parsed and read once, little shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx
from colloquy.functions import similarity
from colloquy.functions import text as tx
from colloquy.llm import linededup


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_turn_computes_each_step_once(spark):
    df = spark.createDataFrame([('```json\n{"content": " hi there", "text": 3}\n```',), ('{"content": 3, "text": "“yes”\\nUser: no"}',), ("[1]",), (None,)], "t string")
    out = df.select(tx.clean_turn(F.col("t"), "user").alias("u"))
    assert [r.u for r in out.collect()] == ["hi there", "yes", "[1]", ""]
    plan = plan_of(out)
    assert len(re.findall("parse_?json", plan, re.I)) <= 2 and len(re.findall("from_json|jsontostructs", plan, re.I)) <= 1


def test_cleaning_steps_read_a_text_once(spark):
    spaces = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
    rows = [f"{c}a{c}b{c}" for c in spaces] + [spaces, f"{spaces}x{spaces}", "​ y​", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.s for r in df.select("i", tx.strip(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [(t or "").strip() for t in rows]
    for step in (tx.strip, tx.strip_fences, tx.cut_leaks, tx.trim_user):
        assert len(re.findall(r"\bt#", plan_of(df.select(step(F.col("t")).alias("x"))).split("\n")[0])) == 1, step


@pytest.mark.parametrize("name", ["CANONICAL", "COMPACT"])
def test_plain_forms_drop_what_their_class_says(spark, name):
    own = {"CANONICAL": tx.canonical, "COMPACT": tx.compact}[name]
    df = spark.range(0, 0x11000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    plain = F.regexp_replace(F.lower("c"), getattr(lx, f"{name}_CLASS"), "")
    assert df.where(own(F.col("c")) != plain).count() == 0
    # a class alone costs each letter a try of every member
    assert "&&" in plan_of(df.select(own(F.col("c"))))


def test_leaks_are_cut_in_one_pass(spark):
    rows = ["a\nUser: b", "`x```json y", "x <|im_end|> y </s>", "\n\nHuman:", "</s>", "x😀\n用户：y```", "<< ` \"thought\"", "a]b-c^d", "line\nline\n\nuser x\n", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for markers in (lx.LEAK_CUTS, ["]", "^d", "-c"], ["😀", "user"], ["x", ""]):
        out = df.select("i", tx.cut_leaks(F.col("t"), markers).alias("s"))
        cut = [(t or "")[: min((at for m in markers if (at := (t or "").find(m)) >= 0), default=None)].strip() for t in rows]
        assert [r.s for r in out.orderBy("i").collect()] == cut
        assert not re.findall(r"\b(instr|stringinstr|locate)\(", plan_of(out), re.I)


def test_runs_and_terms_pass_a_text_once(spark):
    df = spark.createDataFrame([("abcdefg😀",), ("a\nb\nc",), ("abcd",), ("ab",), ("",)], "t string")
    out = df.select(tx.grams(F.col("t"), 4).alias("g"))
    assert [r.g for r in out.collect()] == [["abcd", "bcde", "cdef", "defg", "efg😀"], ["a\nb\n", "\nb\nc"], ["abcd"], ["ab"], []]
    assert "array_join" not in plan_of(out)
    # words go to the table of terms only where it has them
    assert "INSET" in plan_of(df.select(tx.domain_counts(F.col("t"), lx.DOMAINS))).upper()


def test_characters_in_common_are_not_counted_in_plans(spark):
    df = spark.createDataFrame([(["abcd", "abcd", None], ["abcx", "dxyz", "a"])], "a array<string>, b array<string>")
    out = similarity.with_ratios(df, "r", F.col("a"), F.col("b"), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)))
    assert out.first()["r"] == [0.75, 0.0, 0.0]
    assert "array_distinct" not in plan_of(out)


def test_sources_of_runs_come_from_one_join_at_every_length(spark, monkeypatch):
    plans, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, label: plans.append((label, plan_of(df))) or stored(df, label))
    joins = []
    for n in (3, 40):
        run = [f"line {i}" for i in range(n)]
        table = spark.createDataFrame([(i, "\n".join([*run, f"end {i}"])) for i in range(3)], "doc_id long, text string")
        assert {r.doc_id: r.text for r in linededup.dedup_lines(table).collect()} == {0: "\n".join([*run, "end 0"]), 1: "end 1", 2: "end 2"}
        joins.append(next(plan for label, plan in plans if label == "line-runs").count("Join Inner"))
        plans.clear()
    assert joins == [1, 1]
