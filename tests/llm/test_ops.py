"""Each operator against a plain version of it, and on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import bpe, chat, classlm, decontam, langid, linededup, neardup, quality, simhash, substring, topk, wordblocks

DOCS = "doc_id long, text string, lang string, rank int, block string, n_lines string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(40)]
    out = [t.replace(" w7", "\nw7").replace(" w3", "\nw3") for t in out]
    out += [out[3], out[3], out[5] + " tail", out[5][:-4], "", "   ", None, None, "a", "\n\n", "É ß <|endoftext|> 123 'ré", " ".join(out[0:6]) + "\n" + out[8], "x " * 3000]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, out[9])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "b", "n") for i, t in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def plain_line_dedup(texts, m):
    """Texts and numbers of removed lines by the definition: sources, common prefixes, copies from left to right."""
    distinct = sorted({(i is not None, i or 0, xxh(t), t) for i, t in texts if t is not None}, key=lambda r: r[:3])
    all_ = [t.split("\n") for *_, t in distinct]
    first, sizes = {}, [m << k for k in range(12)]
    for d, lines in enumerate(all_):
        for at in range(len(lines)):
            for s in sizes:
                first.setdefault((s, tuple(lines[at : at + s])), (d, at))
    gone = {}
    for d, lines in enumerate(all_):
        drop, end = set(), 0
        for at in range(len(lines)):
            source = None
            for s in sizes:
                agreed = min(s, len(lines) - at)
                e, b = first[s, tuple(lines[at : at + s])]
                if agreed >= m and (e < d or e == d and b + agreed <= at):
                    source = e, b
            if source is None or at < end:
                continue
            e, b = source
            size = 0
            while at + size < len(lines) and b + size < len(all_[e]) and lines[at + size] == all_[e][b + size] and (e < d or b + size < at):
                size += 1
            drop |= set(range(at, at + size))
            end = at + size
        has, i, _, t = distinct[d]
        gone[(i if has else None, t)] = drop
    out = []
    for i, t in texts:
        lost = gone.get((i, t), set())
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost), len(t.split("\n")) if t is not None else 0, len(lost)))
    return sorted(out, key=repr)


def test_line_dedup(docs, empty, texts):
    for m in (1, 2, 3):
        assert rows(linededup.dedup_lines(docs, min_lines=m), "doc_id", "text", "n_lines", "n_removed") == plain_line_dedup(texts, m)
    assert linededup.dedup_lines(docs).columns == ["doc_id", "text", "lang", "rank", "block", "n_lines", "n_removed"]
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_first_runs_whole(spark):
    texts = ["A B", "B C", "A B C", "a a a a", "p q r s t u v", "x p q r s t u v y", "x p q r s t u v y", "q r"]
    table = spark.createDataFrame([(f"d{i}", t.replace(" ", "\n")) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = {r.doc_id: r.text.replace("\n", " ") for r in linededup.dedup_lines(table).collect()}
    # of two overlapping copies the first goes; a run that overlaps itself stays once, whole
    assert got == {"d0": "A B", "d1": "B C", "d2": "C", "d3": "a a", "d4": texts[4], "d5": "x y", "d6": "", "d7": ""}
    rng = np.random.default_rng(8)
    short = [(int(i), "\n".join(rng.choice(list("ab"), rng.integers(1, 14)))) for i in range(60)]
    table = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    assert rows(linededup.dedup_lines(table), "doc_id", "text", "n_lines", "n_removed") == plain_line_dedup(short, 2)


CLASHES = ["doc", "copy", "at", "rest", "line", "len", "source", "gone", "runs", "_lines", "_doc", "_copy", "_gone", "_key", "_hash", "rank", "new", "key", "_text", "leaks", "_leaks", "score", "_score", "_id", "_null", "_nth", "_lang", "fp", "root", "block", "bucket"]


def test_extra_columns_keep_their_values(spark):
    made = [(i, f"some words of text {i % 3}\nand a line {i % 2}\nthird", "en") for i in range(8)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    bench = spark.createDataFrame([(1, "and a line 1")], "item_id long, text string")
    model = quality.fit(table, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    outs = [linededup.dedup_lines(table, min_words=3), decontam.with_leaks(table, bench, name="found"), quality.score(table, model, name="value"), simhash.one_of_each(table), neardup.one_of_each(table)]
    for out in outs:
        assert out.columns[: len(table.columns)] == table.columns
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES)
    replaced = [quality.score(table, model), decontam.with_leaks(table, bench)]
    for out, name in zip(replaced, ("score", "leaks"), strict=True):
        assert sorted(out.columns) == sorted(table.columns) and all(r[name] != f"own {name}" for r in out.collect())
    assert langid.predict(table, langid.fit(table, F.lit(True))).count() == 8 and simhash.near_duplicates(table).count() == 8
    assert substring.remove_repeats(table).count() == 8 and classlm.score(table, F.lit(True), n_words=5).count() == 8
    with pytest.raises(TypeError, match="integer"):
        substring.remove_repeats(table.withColumn("doc_id", F.lit("a")))


def xxh(t):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]


def test_class_lm(docs, empty, texts, spark):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    got = classlm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, n_words=50, n_classes=8, n_groups=3).collect()
    assert len(got) == len(texts)
    known = defaultdict(list)
    for i, t in texts:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        known[i].append((held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) in known[r.doc_id]
        assert math.isfinite(r.score) and r.score < 0
    assert classlm.score(empty, F.lit(True)).count() == 0
    nothing = classlm.score(docs, F.lit(False), n_words=10).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_class_lm_exchanges_words_without_frequent_neighbours(spark):
    rng = np.random.default_rng(5)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [" ".join(str(rng.choice(b if n % 2 else a)) for n in range(40)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "h1 h2 " * 300) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = classlm.score(table, F.col("doc_id") % 10 != 1, n_words=2, n_classes=2, n_groups=4).where("held_out AND doc_id < 1000")
    # 80 words, of which either half follows the other: a model that knows it needs about 40, one that does not 80
    assert all(r.perplexity < 50 for r in got.collect())


def test_class_lm_is_the_plain_model_and_sums_to_one(spark):
    rng = np.random.default_rng(6)
    train = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], rng.integers(0, 9))) for _ in range(30)]
    words = ["a", "b", "c", "d", "e", "f", "never"]
    asked = [f"{w}" for w in words] + ["", "a b never", "c c d"] + [f"{w} {v}" for w in words for v in words]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(train + asked)], "doc_id long, text string")
    got = {r.doc_id - len(train): r for r in classlm.score(table, F.col("doc_id") < len(train), n_words=4, n_classes=2, n_groups=1, keep_classes=True).collect()}
    cls = {w: c for r in got.values() for w, c in zip(r.words, r.classes, strict=True)}
    unknown, end = cls["never"], -1
    tokens = [[*t.split(), None] for t in train]
    count = Counter(w for t in tokens for w in t)
    of = lambda w: end if w is None else cls.get(w, unknown)
    moves = defaultdict(float)
    for t in tokens:
        before = [None, *t[:-1]]
        for p, w in zip(before, t, strict=True):
            once = count[w] == 1 and w is not None
            for via in {of(p)} | ({unknown} if p is not None and count[p] == 1 else set()):
                moves[via, of(w)] += 0.5 if once else 1
                if once:
                    moves[via, unknown] += 0.5
    # a word seen once lends half its transitions, as a predecessor its whole row, to the unknown word
    types, sizes = Counter(), Counter()
    for w, c in count.items():
        types[of(w)] += 1
        sizes[of(w)] += c
    types[unknown] += 1
    classes = set(types)
    lent = sum(moves[c, unknown] for c in classes if c not in (unknown, end))
    weight = {c: (lent if c == unknown else sizes[c]) + 0.5 * types[c] for c in classes}
    total = sum(weight.values())
    share = {c: weight[c] / total for c in classes}
    half = {c: {d: moves[c, d] for d in classes} for c in classes}

    def follow(p, c):
        row = half[p]
        k = max(sum(v > 0 for v in row.values()), 1)
        return (row[c] + k * share[c]) / (sum(row.values()) + k)

    def emit(w):
        c = of(w)
        if c == end:
            return 1.0
        return (count[w] + 0.5) / (sizes[c] + 0.5 * types[c])

    for n, t in enumerate(asked):
        seq = [*t.split(), None]
        want = sum(math.log10(follow(of(p), of(w)) * emit(w)) for p, w in zip([None, *seq[:-1]], seq, strict=True))
        assert got[n].score == pytest.approx(want, abs=1e-6), t
    for p in [None, *words]:
        assert sum(follow(of(p), of(w)) * emit(w) for w in [*words, None]) == pytest.approx(1)


def test_exchange_finds_alternating_classes():
    counts = np.zeros((6, 6), int)
    counts[:3, 3:] = [[40, 30, 5], [20, 10, 3], [9, 6, 2]]
    counts[3:, :3] = [[35, 21, 8], [31, 12, 6], [4, 3, 2]]
    own = classlm.exchange(counts, 2, 10)
    assert len(set(own[:3])) == len(set(own[3:])) == 1 and own[0] != own[3]


def test_quality(spark, docs, empty):
    good = [(i, "The cat sat on the mat and looked at the other cat. " * (i % 5 + 1)) for i in range(100)]
    bad = [(100 + i, "BUY!! NOW!! " * (i % 7 + 3)) for i in range(100)]
    table = spark.createDataFrame([(i, t, "en", 1, "b", "n") for i, t in good + bad], DOCS)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(table, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all((got[i] >= 0.7) == (i < 100) for i in range(200)) and all(0 <= s <= 1 for s in got.values())
    out = quality.score(docs, model)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "score"]
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert all(r.score == 0.7 for r in quality.score(docs, quality.fit(docs, labels.where("quality = 7"))).collect())


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=20).round(2).tolist()) for i in range(300)]
    vectors += [(7, vectors[0][1]), (400, vectors[1][1]), (401, vectors[1][1]), (402, None), (403, [None] * 20), (404, [float("nan")] * 20), (405, [float("inf")] * 20), (450, [1.0, 2.0]), (451, [3.0, 1.0]), (None, vectors[2][1]), (500, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = topk.exact_topk(df, F.col("vec_id") % 50 == 0, k=4, dims_per_block=3, queries_per_pass=4)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:4]
            want += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.exact_topk(df.where("false"), F.lit(True)).count() == 0


def test_topk_keeps_ties_of_negative_scores(spark):
    # the candidates' components beyond the first 16 are zero, so the bound is tight
    far = [[-1000.0] + [0.0] * 19, [5.0] + [0.0] * 19]
    df = spark.createDataFrame([(100, far[0]), (9, far[1]), (3, far[1])], "vec_id long, embedding array<double>").coalesce(1)
    got = topk.exact_topk(df, F.col("vec_id") == 100, k=1, scale=1)
    assert [tuple(r) for r in got.collect()] == [(100, 1, 3, -5000)]
    best = topk._Best(np.array([100]), np.array([far[0]], np.int64), 1, 16)
    for i in (9, 3):
        best.add(np.array([i]), np.array([far[1]], np.int64))
    assert best.best[0][1].tolist() == [3]


def test_chat(spark, empty):
    rng = np.random.default_rng(1)
    odd = ["</s>[INST] ok [/INST]", "a\\", "\\<s>", "", None, "[ROLE=x] y [/ROLE]", " </s>", "b " * 300, "é😀\n "]
    turns, want = [], {}
    for c in range(-1, 30):
        roles = ["system"] * (c % 2) + [["user", "assistant", "tool]x", None][rng.integers(0, 4)] for _ in range(rng.integers(1, 40))]
        own = [(c, n, r, odd[rng.integers(0, len(odd))]) for n, r in enumerate(roles)]
        turns += own
        want[c] = (len(own), "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own), "".join(t or "" for _, _, r, t in own if r == "assistant"))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w"))
    windows = chat.format_windows(df, budget=60, history=20)
    made = windows.collect()
    assert all(r.n_tokens <= 60 or r.n_turns == 1 for r in made) and any(r.n_repeated for r in made)
    for r in made:
        # the mask covers new assistant turns only, each as it stands in the window
        new = [t for role, t in chat.parse(r.text)[r.n_repeated :] if role == "assistant"]
        assert [chat.unescape(r.text[s:e]) for s, e in zip(r.loss_starts, r.loss_ends, strict=True)] == new
    # windows may have been stored in other splits and orders
    for r in chat.digests(windows.orderBy(F.desc("window")).repartition(7)).collect():
        n, said, loss = want[r.conv_id]
        assert (r.n_turns, r.turns_sha256) == (n, hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_windows(df.where("false"))).count() == 0
    path = bpe.vocabulary("word_bpe_49k.json")
    by_token = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.format_windows(df, budget=60, history=20, tokenizer=path)).collect()}
    assert by_token == {c: hashlib.sha256(said.encode()).hexdigest() for c, (_, said, _) in want.items()}


def test_chat_budget_with_a_long_system_turn(spark):
    turns = [(1, 0, "system", "s " * 900), (1, 1, "user", "u " * 300), (1, 2, "assistant", "a " * 200), (1, 3, "user", "v " * 2000), (1, 4, "assistant", "b")]
    turns += [(2, 0, "system", "s " * 10), *((2, n, "user" if n % 2 else "assistant", "w " * 300) for n in range(1, 9))]
    windows = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=1024, history=400).orderBy("conv_id", "window").collect()
    assert all(r.n_tokens <= 1024 or r.n_turns == 1 for r in windows)
    later = [r for r in windows if r.conv_id == 2 and r.window]
    # the system turn and one turn of history open each later window
    assert later and all([role for role, _ in chat.parse(r.text)][0] == "system" and r.n_repeated == 2 for r in later)


def test_chat_escapes(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\", "\\<s>", "", None, "[ROLE=x] y [/ROLE]", " </s>", "é😀\n "]
    assert all(chat.unescape(chat.escape(t or "")) == (t or "") for t in odd)


def plain_fingerprint(t, k=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, empty, texts):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((prints[n][0] for n in range(len(group)) if group[n] == g and prints[n][0] is not None), default=None) for g in group}
    want = sorted(((i, f"{p:016x}", least[g]) for (i, p), g in zip(prints, group, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted(set(least.values()), key=repr)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for n in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[n] ^= np.uint64(1 << int(bit))
    keys = [defaultdict(set), defaultdict(set)]
    for own, prints in zip(keys, (a, b), strict=True):
        for k, p in zip(*simhash.pair_keys(prints), strict=True):
            own[int(p)].add(int(k))
    assert all(keys[0][int(x)] & keys[1][int(y)] for x, y in zip(a, b, strict=True))


def test_large_runs_keep_their_components():
    prints = np.arange(500, dtype=np.uint64)
    a, b = simhash._links(np.zeros(500, np.int32), prints)
    assert len(a) == 499 and len(np.unique(np.r_[a, b])) == 500


def test_substring(docs, empty, texts):
    for width in (6, 13):
        starts = defaultdict(set)
        for i, t in texts:
            w = words(t)
            for at in range(len(w) - width + 1):
                starts[tuple(w[at : at + width])].add(i)
        want = []
        for i, t in texts:
            w = words(t)
            gone = set()
            for at in range(len(w) - width + 1):
                if i is not None and any(j is not None and j < i for j in starts[tuple(w[at : at + width])]):
                    gone |= set(range(at, at + width))
            kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
            want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        got = rows(substring.remove_repeats(docs, width=width), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(want, key=repr)
    assert substring.remove_repeats(empty).count() == 0


def test_substring_takes_any_id_and_one_huge_text(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    huge = " ".join(f"h{i}" for i in range(400000)) + " " + passage
    top = 2**63 - 1
    table = spark.createDataFrame([(top, passage), (-(2**63), huge), (5, passage + " tail")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(table).collect()}
    assert got == {top: (30, 30), -(2**63): (400030, 0), 5: (31, 30)}


def test_automata_alone_locate_repeats(spark, monkeypatch):
    row = {"keys": [1, 2], "sizes": [20, 20], "words": [wordblocks.pack_words([b"w%d" % i for i in range(20)])], "ranks": wordblocks.pack(np.arange(20, dtype=np.uint32)), "tokens": wordblocks.pack(np.tile(np.arange(20, dtype=np.uint32), 2))}
    view = substring._View(row, 13)
    phrases = np.array([[3, 4, 5, 6, 7, 8], [5, 4, 3, 2, 1, 0]])
    assert substring._stream(view, phrases).tolist() == [3, 23]
    # equal hashes do not do: the words are compared
    known = substring._Known(view, {"said": [], "at": [], "ids": []})
    known.windows, known.ids = np.array([[*range(12), 19]]), np.array([1])
    known.one = view.hashes(np.array([20]))[0]
    assert known.later(view, np.array([20])).tolist() == [False]
    known.windows = np.array([list(range(13))])
    assert known.later(view, np.array([20, 0])).tolist() == [True, False]


def test_language(spark, docs, empty):
    rng = np.random.default_rng(2)
    tongue = {"xx": ["sha", "tok", "rel"], "yy": ["öln", "bäu", "mir"], "zz": ["que", "ión", "las"]}
    made = [(n, " ".join("".join(rng.choice(tongue[lang], 3)) for _ in range(30)), lang, 1, "b", "n") for n, lang in enumerate(["xx", "yy", "zz"] * 60)]
    table = spark.createDataFrame([*made, (900, None, "xx", 1, "b", "n"), (901, "123 --", "xx", 1, "b", "n"), (902, "shatok", None, 1, "b", "n")], DOCS)
    model = langid.fit(table, F.col("doc_id") % 5 != 0, per_language=20, n_landmarks=12)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert all(got[n][0] == lang for n, _, lang, *_ in made)
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "xx" and all(0 <= s <= 1 for _, s in got.values())
    assert not any(map(langid.has_letter, ["²", "½", "①", "Ⅷ", "12_-", "", None])) and all(map(langid.has_letter, ["1a", "ß", "語", "ª"]))
    none = langid.predict(docs, langid.fit(empty, F.lit(True)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and none.count() == docs.count()


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(4)
    pool = [f"t{i}" for i in range(300)]
    items = [(n, " ".join(rng.choice(pool, rng.integers(3, 60)))) for n in range(40)] + [(90, None), (91, "!!"), (None, "t1 t2"), (0, "t9 t8 t7 t6 t5 t4")]
    texts = []
    for n in range(60):
        own = list(rng.choice(pool, rng.integers(0, 400)))
        item = items[n % 40][1].upper().split()
        if n % 3 == 0:
            item = item[: max(1, int(len(item) * rng.uniform(0.6, 1)))]
        at = rng.integers(0, len(own) + 1)
        texts.append((n, " ".join(own[:at] + item + own[at:]) if n % 4 else " ".join(own)))
    texts += [(100, None), (101, ""), (3, texts[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, "en", 1, "b", "n") for i, t in texts], DOCS)
    def share(part, w, span):
        own = decontam.shingles(part)
        k = min(5, len(part))
        starts = range(max(1, len(w) - span + 1))
        return max(len(own & {b" ".join(w[p : p + span][j : j + k]) for j in range(len(w[p : p + span]) - k + 1)}) / len(own) for p in starts)

    n = [len(decontam.terms(b)) for i, b in items if i is not None and decontam.terms(b)]
    df = Counter(t for i, b in items if i is not None for t in set(decontam.terms(b)))
    want = []
    for i, t in texts:
        w = decontam.terms(t)
        for item, b in items:
            own = decontam.terms(b)
            if item is None or not own or not w:
                continue
            q, a = (decontam.terms(p) for p in decontam.question_and_answer(b))
            span = max(2 * len(own), 32)
            shares = [round(share(p, w, span), 9) if p else 1.0 for p in (own, q, a)]
            if shares[0] >= 0.8 or len(q) >= 10 and shares[1] >= 0.8:
                want.append((i, item, *shares, shares[0] >= 0.8))
    assert any(not r[-1] for r in want) and any(r[-1] and r[2] < 1 for r in want)
    seen = None
    for per_pass in (20000, 7):
        found = decontam.leaks(table, bench, items_per_pass=per_pass).collect()
        got = sorted(((r.doc_id, r.item_id, round(r.overlap, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.whole) for r in found), key=repr)
        assert got == sorted(want, key=repr)
        scores = sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in found)
        assert seen is None or scores == seen
        seen = scores
    # a whole item in one window scores the sum of its terms' impacts
    mean, by_item = sum(n) / len(n), {i: decontam.terms(b) for i, b in items if i not in (None, 0)}
    for r in found:
        if r.overlap == 1 and r.item_id in by_item:
            own = by_item[r.item_id]
            full = sum(math.log(1 + (len(n) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t, f in Counter(own).items())
            assert r.score == pytest.approx(full)
    assert decontam.leaks(table, bench.where("false")).count() == 0
    assert decontam.with_leaks(docs, bench).count() == docs.count() and decontam.leaks(empty, bench).count() == 0


def test_bpe(docs, empty, texts):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), said))
    got = rows(bpe.encode_decode(docs, path, texts=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")
    assert got == sorted(want, key=repr)
    assert bpe.encode_decode(empty, path).count() == 0
    ids = bpe.encode_decode(docs, path, texts=True).select("doc_id", "ids", F.col("decoded").alias("want"), F.lit("x").alias("piece"))
    back = bpe.decode(ids, path).collect()
    assert len(back) == len(texts) and all(r.decoded == r.want and r.piece == "x" for r in back)
