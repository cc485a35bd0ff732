"""Phrases, the rule cascade and fill-in-middle against plain versions, and on nulls, empty tables, repeated rows, clashing columns and long texts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import fim, phrases, rules

DOCS = "doc_id long, text string, lang string, rank int, n_words string, _measures int, h1 string, form string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "New", "York", "né", "##"]
    out = []
    for _ in range(60):
        words = rng.choice(vocabulary, rng.integers(1, 90))
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", " "]) for w in words))
    out += ["the New York " * 30, "the New York, " * 9, out[3], out[3], "", "   ", None, "\n\n..", "É ß <P> 'ré", "one\ntwo\none\n \n \nthree\none", "a b c d e f a b c d e f", "x" * 1200, "HELLO " * 12]
    return [(i, t, "de" if i is not None and i % 3 == 0 else (None if i == 7 else "en")) for i, t in [*enumerate(out), (3, out[3]), (None, out[9])]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, 1, "n", 2, "h", "f") for i, t, lang in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_phrases(texts, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = lambda p, a, found=found: any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in found.items())
        rows = []
        for p, a in found.items():
            if not held(p, a):
                score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collected(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("least,share,top", [(2, 50, 2000), (10, 50, 7), (3, 101, None)])
def test_phrases(docs, texts, least, share, top):
    got = collected(phrases.collocations(docs, least=least, share=share, top=top), *PHRASE)
    assert got == sorted(plain_phrases(texts, least, share, top), key=repr) and len(got) > 5


def test_phrases_do_not_depend_on_batches_or_ranges(spark, docs, texts):
    want = sorted(plain_phrases(texts, 2, 50, None), key=repr)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for n, batch in (("1", "7"), ("40", "1000")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert collected(phrases.collocations(docs.repartition(3), least=2, top=None), *PHRASE) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_counted_phrases_travel_packed(spark, docs, texts):
    """A block sends each bucket one row, whatever the number of its places; buckets add up to the phrases counted plainly."""
    blocks = phrases.stored(phrases._blocks(docs.repartition(3), F.col("lang"), F.col("text")), "test-blocks")
    said = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words.lang", "w.words.word", F.col("w.counts").alias("n"))
    words = phrases.stored(phrases._numbered(said.groupBy("lang", "word").agg(F.sum("n").alias("f"))), "test-words")
    chunks = phrases._chunks(blocks, words, 4)
    n = blocks.count()
    assert n > 1 and 0 < chunks.count() <= 4 * n and chunks.select("bucket").distinct().count() > 1
    names = {r["id"]: (r["lang"], bytes(r["word"]).decode()) for r in words.collect()}
    got = {(names[r["a"]][0], " ".join(names[k][1] for k in (r["a"], r["b"], r["c"]) if k)): r["f"] for r in chunks.groupBy("bucket").applyInArrow(phrases._add_up(1), "a long, b long, c long, f long").collect()}
    want = Counter()
    for _, text, lang in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            own = [w for w in re.split(r"[ \t]+", piece) if w]
            want.update((lang or "und", " ".join(own[i : i + k])) for k in (2, 3) for i in range(len(own) - k + 1))
    assert got == want


def test_phrases_of_nothing_and_of_one_long_text(spark, empty):
    assert phrases.collocations(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "one", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(nothing, least=1).collect() == []
    long = spark.createDataFrame([(1, "good day to you " * 100_000 + "good", "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"]) for r in phrases.collocations(long).collect()}
    assert got["good day to"] == (100000, 100001, 100000, 400001) and "good day" not in got


def test_scores_are_exact(spark):
    rows = [(3 * 10**13, 3 * 10**13 + 1, 4 * 10**13), (7, 7, 7), (10, 3 * 10**18, 9), (999_999_999_999, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._score("a", "l", "r").alias("s")).collect()
    assert all(r["s"] == 1000000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


@given(st.lists(st.tuples(*[st.integers(0, 2**40 - 1)] * 3), max_size=40))
def test_radix_order_and_keys(rows):
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    order = phrases.radix_order(columns)
    assert [rows[i] for i in order] == sorted(rows)
    keys = phrases.keys_of(columns)
    assert [tuple(x) for x in zip(*(c.tolist() for c in phrases.ids_of(keys)), strict=True)] == rows
    assert sorted(range(len(rows)), key=lambda i: keys[i].tobytes()) == order.tolist()


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_runs_over_batches(rows, cuts):
    rows = sorted(rows)
    runs, got = phrases._Runs(phrases.WIDTH), Counter()
    at = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    for s, e in zip(at, at[1:], strict=False):
        keys, sums = runs.feed(phrases.keys_of([np.array([k for k, _ in rows[s:e]], np.int64)]), np.array([n for _, n in rows[s:e]], np.int64))
        assert not {k for k in phrases.ids_of(keys)[0].tolist()} & set(got)
        got.update(dict(zip(phrases.ids_of(keys)[0].tolist(), sums.tolist(), strict=True)))
    got.update(dict(zip(phrases.ids_of(runs.keys)[0].tolist(), runs.sums.tolist(), strict=True)))
    want = Counter()
    for k, n in rows:
        want[k] += n
    assert got == want


def plain_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


RULED = ("doc_id", *rules.MEASURES, "base_failed", "kept")


def test_measures_and_verdicts(docs, empty, texts):
    steps = rules.plan(docs)
    assert sorted(s.rule.name for s in steps) == sorted(r.name for r in rules.RULES) and all(s.seconds > 0 for s in steps)
    got = collected(rules.cascade(docs, steps), *RULED)
    assert [r[:6] for r in got] == sorted(((i, *plain_measures(t)) for i, t, _ in texts), key=repr)
    assert all(r[6] == (r[1] < 10 or 100 * r[5] > 20 * r[1]) and not (r[6] and r[7]) for r in got)
    assert collected(rules.cascade(docs, steps[::-1]), *RULED) == got
    assert any(r[7] for r in got) and any(not r[7] and not r[6] for r in got)
    assert rules.cascade(empty, rules.plan(empty)).collect() == []


@pytest.mark.parametrize(
    "rule,bad",
    [
        ("word_length", " ".join(c * 20 for c in "abcdefghijkl")), ("symbols", "some words # with a sign in each of their many & lines"), ("duplicate_lines", "a line\nb line\na line\nc d\na line\ne f g h i"),
        ("capitals", "ONE TWO THREE FOUR FIVE six seven eight nine ten eleven"), ("wordless", "a 1 b 2 c 3 d 4 e 5 f 6 g 7"), ("digits", "abc1234 bcd2345 cde34 def45 efg567 fgh678 ghi78 hij89 ijk9 jkl0"),
        ("ellipses", "one two three...\nfour five six… \nseven eight nine\nten eleven twelve"), ("bullets", "- one two\n* three four\n• five six\n- seven eight\n- nine ten"), ("long_word", "a b c d e f g h i " + "x" * 1000), ("broken_characters", "one two three four five six seven eight nine ��"),
    ],
)
def test_each_rule(spark, rule, bad):
    good = "This is a line of plain words without any fault.\nAnd here is another one, a little longer than the first."
    df = spark.createDataFrame([(1, good), (2, bad), (3, None)], "doc_id long, text string")
    only = [rules.Step(r, 1.0, 0.0) for r in rules.RULES if r.name == rule]
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.cascade(df, only).collect()} == {1: (False, True), 2: (False, False), 3: (True, False)}


def test_later_rules_are_not_run_on_rejected_rows(spark):
    df = spark.createDataFrame([(1, "bad " + "w x y z " * 3), (2, " ".join("abcdefghijklm"))], "doc_id long, text string")
    first = rules.Step(rules.Rule("bad", lambda t, m: t.startswith("bad")), 1.0, 0.5)
    trap = rules.Step(rules.Rule("trap", lambda t, m: F.when(t.startswith("bad"), F.raise_error(F.lit("run")).cast("boolean")).otherwise(False)), 1.0, 0.0)
    assert [tuple(r) for r in rules.cascade(df, [first, trap]).select("doc_id", "kept").orderBy("doc_id").collect()] == [(1, False), (2, True)]


def test_order_is_by_rejection_per_cost_of_what_is_left():
    masks = [(0b011, 40), (0b010, 10), (0b100, 20), (0, 30)]
    # the first rule rejects 40 at 1, the second 50 at 2: after the first the second has 10 of 60, the third 20 of 60
    assert [k for k, _ in rules.greedy(masks, [1.0, 2.0, 1.0])] == [0, 2, 1]
    assert rules.greedy(masks, [1.0, 2.0, 1.0])[1][1] == pytest.approx(20 / 60)
    assert [k for k, _ in rules.greedy([], [3.0, 1.0])] == [1, 0]


@given(st.lists(st.sampled_from("abcdefg"), max_size=60))
def test_repeated_words(words):
    assert rules.repeated_words([w.encode() for w in words]) == plain_measures(" ".join(words))[4]


def plain_example(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_examples(spark, docs, empty, texts):
    cols = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    made = fim.transform(docs)
    got = collected(made, *cols)
    assert got == sorted((plain_example(i, t) for i, t, _ in texts), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert collected(fim.restore(made), "doc_id", "restored") == sorted(((i, t or "") for i, t, _ in texts), key=repr)
    digests = fim.digests(made).where("doc_id = 60").first()
    assert digests["restored_sha256"] == hashlib.sha256(texts[60][1].encode()).hexdigest()
    assert fim.digests(fim.transform(empty)).collect() == []
    long = spark.createDataFrame([(k, ("word é\U0001f600 " * 200_000) + "z" * 500_000) for k in range(4)], "doc_id long, text string")
    assert fim.restore(fim.transform(long)).join(long, "doc_id").where("restored = text").count() == 4


@settings(deadline=None)
@given(st.text(st.sampled_from("aZ1 é\n<>😀PSM"), max_size=80), st.integers(0, 80), st.integers(0, 80), st.sampled_from(["psm", "spm"]))
def test_ropes(text, i, j, form):
    old, fim.LEAF_UNITS = fim.LEAF_UNITS, 3
    try:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        tree = fim.rope(text)
        assert (tree.units, tree.chars, fim.flat(tree)) == (len(units), len(text), text)
        left, right = fim.split(tree, i)
        assert fim.flat(left) == "".join(units[:i]) and fim.flat(right) == "".join(units[i:])
        assert (left.units, right.units) == (len(units[:i]), len(units[i:])) and (left.chars, right.chars) == (len(fim.flat(left)), len(fim.flat(right)))
        if not re.search("<[PSM]>", text):
            a, b = sorted((i % (len(units) + 1), j % (len(units) + 1)))
            out, prefix, middle = fim.rearranged(tree, form, a, b)
            assert (prefix, middle) == (len("".join(units[:a])), len("".join(units[a:b])))
            assert fim.rebuilt(fim.flat(out), form) == text
            assert out.chars == len(text) + 9
    finally:
        fim.LEAF_UNITS = old
