"""The stages on a small corpus, against plain versions of what each has to do."""


import corpus_pipeline as cp
import numpy as np
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    pool = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(pool, n))
    clean = [(i, f"{text(60)}.\n{text(40)}.") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in rng.choice(pool, 50))) for i in range(40)]
    item = text(30)
    extra = [(200, clean[0][1]), (201, clean[1][1].replace("word", "WORD")), (202, f"{text(50)} {item} {text(50)}"), (203, None), (204, "")]
    d = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, "en", "s", len(t or "")) for i, t in clean + bad + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in clean + bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if n < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS, name
        rows = out.collect()
        seen.append({r.doc_id: r for r in rows})
        docs = spark.createDataFrame(rows, out.schema)
    quality, lines, near, clean, tokens = seen
    assert not any(100 <= i < 200 for i in quality) and all(i in quality for i in range(60))
    assert set(lines) == set(quality) and lines[200].text == "" and lines[0].text == quality[0].text
    assert lines[200].n_chars == 0
    assert all(i in near for i in range(60)) and (200 in near) == (200 in lines) and not {201, 203, 204} & set(near)
    assert 202 not in clean and all(i in clean for i in range(60))
    assert set(tokens) == set(clean)


def test_later_copies_of_single_long_lines_go(spark):
    long = "one line of seven words that repeats"
    texts = [f"a\n{long}\nb", f"c\n{long}\nd\n{long}", long, "short line", "e\nshort line\nf", None]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in cp.dedup_lines(spark, table, "").collect()}
    assert got == {0: texts[0], 1: "c\nd", 2: "", 3: texts[3], 4: texts[4], 5: None}


def test_near_copies_go_as_brute_force_says(spark):
    rng = np.random.default_rng(17)
    pool = [f"v{i}" for i in range(3000)]
    texts = []
    for n in range(60):
        base = list(rng.choice(pool, 200))
        texts.append(base)
        for edits in (n % 9, 3):
            copy = list(base)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = "edited"
            texts.append(copy)
    # more near copies than are compared pair by pair
    base = list(rng.choice(pool, 300))
    texts += [[*base[:i], f"x{i}", *base[i:]] for i in range(100)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    table = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert sorted(r.doc_id for r in cp.dedup_documents(spark, table, "").collect()) == sorted(set(root))


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(cp.run(spark, folder).collect()) == sorted(docs.collect())


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = list(rng.choice([f"w{i}" for i in range(3000)], 400))
    # one changed word at the end: a few fingerprint bits; the fifth text has every third word changed
    texts = [*[" ".join([*base[:-1], f"end{i}"]) for i in range(4)], " ".join(w if i % 3 else "other" for i, w in enumerate(base)), None]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    asked = []
    links = cp.neardup.simhash.links
    monkeypatch.setattr(cp.neardup.simhash, "links", lambda prints: asked.append(1) or links(prints))
    # without the keys of min-hash bands SimHash is all there is
    monkeypatch.setattr(cp.neardup, "_by_bands", lambda keys: spark.createDataFrame([], "a long, b long, big boolean"))
    assert sorted(r.doc_id for r in cp.dedup_documents(spark, table, "").collect()) == [0, 4, 5] and asked
