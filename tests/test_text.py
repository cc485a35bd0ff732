import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import similarity
from colloquy.functions import text as tx
from colloquy.functions.lexicons import DEFAULT
from colloquy.operators.dedup import gram_hashes


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_canonical_text(spark):
    texts = ["Ab　c，。!", "É-ß_x", "", None, "a\x1cb c", "“q”【z】"]
    assert values(spark, texts, tx.canonical(F.col("t"))) == ["abc", "éßx", "", "", "abc", "q【z】"]
    assert values(spark, ["A b", "a.B"], tx.fingerprint(F.col("t"))) == [hashlib.sha256(b"ab").hexdigest()] * 2


def test_grams_and_repetition(spark):
    assert values(spark, ["abcdef", "abcde", "ab", "", "😀aaaa😀"], tx.char_ngrams(F.col("t"))) == [["abcde", "bcdef"], ["abcde"], ["ab"], [], ["😀aaaa", "aaaa😀"]]
    plain = lambda t: 0.0 if len(t) < 16 else 1 - len({t[i : i + 4] for i in range(len(t) - 3)}) / (len(t) - 3)
    texts = ["abcabcabcabcabcabc", "abcdefghijklmnopqrstuvwxyz", "aaaaaaaaaaaaaaaa", "short"]
    assert [round(v, 9) for v in values(spark, texts, tx.ngram_repetition(F.col("t")))] == [round(plain(t), 9) for t in texts]


def test_word_boundaries(spark):
    texts = ["cat écat cat我 我cat cat_ cat.cat CAT", "a cat\r\ncat", None]
    assert values(spark, texts, tx.word_count(F.lower("t"), "cat")) == [4, 2, None]


def test_counts(spark):
    assert values(spark, ["😊 www :) xD", None], tx.emoji_count(F.col("t"))) == [4, 0]
    assert values(spark, ["Enjoy it, AMAZING enjoy it", ""], tx.marker_count(F.col("t"), DEFAULT.hype)) == [3, 0]
    assert values(spark, ["go to it\nfeel it and enjoy it", "go"], tx.pattern_count(F.col("t"), DEFAULT.formulas)) == [1, 0]
    assert values(spark, ["my interactions", 'x "params" : 1'], tx.matched(F.col("t"), ["actions"], DEFAULT.leak_patterns, 12)) == [["actions"], [r'"params"\s*:']]


def test_cleaning(spark):
    assert values(spark, ["```json\n{\"a\":1}\n```", " x ", "```\ny```"], tx.strip_fences(F.col("t"))) == ['{"a":1}', "x", "y"]
    assert values(spark, ['so {"a":{"b":1}} ok', "[1]", "none"], tx.json_object(F.col("t"))) == ['{"a":{"b":1}}', '{"messages":[1]}', None]
    assert values(spark, ["hello\nUser: more", "plain", "x</s>y```"], tx.cut_leaks(F.col("t"))) == ["hello", "plain", "x"]
    assert values(spark, [" ".join("w" * 30), "字" * 25], tx.trim_user(F.col("t"))) == [" ".join("w" * 20), "字" * 20]
    assert values(spark, ["[END]", "[END] and then much more", "ok [END]"], tx.ended(F.col("t"))) == [True, False, True]
    assert values(spark, ["Yes", "0", "maybe"], tx.boolish(F.col("t"))) == [True, False, None]


def test_content_tokens(spark):
    assert values(spark, ["我爱 你 Hello to hello", ""], tx.content_tokens(F.col("t"))) == [["我爱", "爱你", "hello"], []]


def test_domains(spark):
    got = values(spark, ["The cat and a Dog; category, old song"], tx.domain_counts(F.col("t"), DEFAULT.domains))
    assert got == [{"pets_animals": 2, "media": 2}]


def test_clauses():
    assert similarity.keep_new_clauses("Hi there! hi there! Bye.") == "Hi there! Bye."
    assert similarity.keep_new_clauses("你好。你好！再见。") == "你好。再见。"
    assert similarity.keep_new_clauses(None) == ""


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_gram_hashes_tell_runs_apart(t):
    runs = {t[i : i + 5] for i in range(max(1, len(t) - 4))}
    assert len(gram_hashes(t)) == len(runs)


def test_escaped_literals():
    assert re.fullmatch(tx.literal("a.b(c)"), "a.b(c)")
