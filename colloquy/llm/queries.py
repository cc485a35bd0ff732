"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, chat, classlm, decontam, fim, langid, linededup, phrases, quality, rules, simhash, substring, topk
from colloquy.llm._shared import remainder, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder(F.col("doc_id"), 5) != 1)


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder(F.col("doc_id"), 4)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    scored = quality.score(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_windows(turns.unionByName(own), tokenizer=bpe.vocabulary("word_bpe_49k.json")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=13)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return langid.predict(docs, langid.fit(docs, ~held_out), keep={"held_out": held_out})


def op9_bm25_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary("word_bpe_49k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=10, share=50, top=2000)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.cascade(docs, rules.plan(docs))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_class_lm": op2_class_lm,
    "op3_quality_rank": op3_quality_rank,
    "op4_exact_topk": op4_exact_topk,
    "op5_chat_format": op5_chat_format,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_bm25_decontam": op9_bm25_decontam,
    "op10_bpe_words": op10_bpe_words,
    "op11_phrases": op11_phrases,
    "op12_quality_rules": op12_quality_rules,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
        ), h AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p
        ), r AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM h
        ), gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM r WHERE least < doc_id GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op1_line_dedup": """
        WITH d AS (
            SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL
        ), sizes AS (
            SELECT CAST(2 ** i AS BIGINT) AS size FROM range(1, 31) t(i) WHERE 2 ** (i - 1) < (SELECT max(n) FROM d)
        ), p AS (
            SELECT doc_id, unnest(range(1, n + 1)) AS place, lines, n FROM d
        ), r AS (
            -- every run of 2, 4, 8 ... lines, or to the document's end, and the first place where it occurs
            SELECT doc_id, place, size, least(size, n - place + 1) AS agreed,
                   min(doc_id * 1000000 + place) OVER (PARTITION BY size, lines[place:place + size - 1]) AS first
            FROM p, sizes WHERE size < 2 * (n - place + 1) OR size = 2
        ), s AS (
            SELECT doc_id, place, arg_max(first, size) AS first FROM r
            WHERE agreed >= 2 AND (first // 1000000 < doc_id OR first // 1000000 = doc_id AND first % 1000000 + agreed <= place)
            GROUP BY doc_id, place
        ), c AS (
            -- how far the run and its source agree, without overlap
            SELECT s.doc_id, s.place, s.first % 1000000 AS from_place, s.first // 1000000 AS from_doc,
                   coalesce(list_position(list_transform(range(0, a.n - s.place + 1), lambda i: a.lines[s.place + i] IS NOT DISTINCT FROM b.lines[s.first % 1000000 + i]), false) - 1, a.n - s.place + 1) AS shared
            FROM s JOIN d a ON a.doc_id = s.doc_id JOIN d b ON b.doc_id = s.first // 1000000
        ), m AS (
            SELECT doc_id, place, CASE WHEN from_doc = doc_id THEN least(shared, place - from_place) ELSE shared END AS size FROM c
        ), k AS (
            -- from left to right, each run that does not overlap the one before
            SELECT doc_id, list_reduce(list_prepend([{'place': 0::BIGINT, 'size': 0::BIGINT}], list([{'place': place::BIGINT, 'size': size::BIGINT}] ORDER BY place)),
                   lambda kept, x: CASE WHEN x[1].place >= kept[-1].place + kept[-1].size THEN list_concat(kept, x) ELSE kept END) AS runs
            FROM m GROUP BY doc_id
        ), g AS (
            SELECT doc_id, flatten(list_transform(runs, lambda x: range(x.place, x.place + x.size))) AS gone FROM k
        )
        SELECT o.doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
               CASE WHEN o.text IS NOT NULL THEN sha256(CASE WHEN g.gone IS NULL THEN o.text
                   ELSE array_to_string(list_filter(d.lines, lambda x, i: NOT list_contains(g.gone, i)), chr(10)) END) END AS kept_sha256
        FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op11_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (
            SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p
        ), g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
        ), cuts AS (
            SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM c, (VALUES (1), (2)) s(cut) WHERE cut < k
        ), scored AS (
            SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cut, x.f AS l, y.f AS r,
                   CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 AND x.k = cut JOIN f y ON y.lang = cuts.lang AND y.phrase = p2 AND y.k = cuts.k - cut
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, cut) = 1
        ), held AS (
            SELECT lang, part, max(a) AS most FROM (
                SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3
            ) GROUP BY ALL
        ), kept AS (
            SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.part AND b.k = 2 WHERE h.most IS NULL OR 100 * h.most < 50 * b.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op12_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents
        ), s AS (
            SELECT d, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0B\f\r]')) AS lines FROM d
        ), v AS (
            SELECT d, unnest(range(1, len(w) - 3)) AS i, w FROM s WHERE len(w) >= 5
        ), r AS (
            SELECT d, i, count(*) OVER (PARTITION BY d, hash(w[i:i + 4]), array_to_string(w[i:i + 4], ' ')) AS times FROM v
        ), often AS (
            SELECT d, len(list_distinct(flatten(list(range(i, i + 5))))) AS n FROM r WHERE times > 1 GROUP BY d
        ), m AS (
            SELECT s.d, doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM s LEFT JOIN often USING (d)
        ), b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
            OR 100 * word_chars > 1500 * n_words OR word_chars < 2 * n_words
            OR 100 * n_symbols > 10 * n_words
            OR n_dup_lines > 0 AND 100 * n_dup_lines > 30 * len(lines)
            OR 100 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 30 * length(regexp_replace(t, '[^\p{L}]', '', 'g'))
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 75 * n_words
            OR 100 * length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) > 25 * word_chars
            OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\x0B\f\r]*$'))) > 30 * len(lines)
            OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 90 * len(lines)
            OR len(list_filter(w, lambda x: length(x) >= 1000)) > 0
            OR 100 * length(regexp_replace(t, '[^\x{FFFD}]', '', 'g')) > word_chars) AS kept
        FROM b
    """,
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
        ), h AS (
            SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), p AS (
            SELECT *, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
