"""Quality rules as a short-circuit cascade.

Base measures of every text come from one Arrow function. The rules are column expressions over the text and these measures. A
bounded sample tells what each rule costs and which of its rows it rejects; rules are then put in order by rejection per
cost, each judged on the rows that those before it leave. The cascade is one CASE WHEN, whose later branches are not worked
out where an earlier one holds, so the order decides what it costs and never what it says.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm._shared import spare, stored

#: Rows that costs and rejections are estimated on, at most.
SAMPLE_ROWS = 2000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that begin no code point, and white space: what is left is one byte for each code point of a word.
_NO_WORD_CHARS = _WHITE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


class Rule(NamedTuple):
    """A name, and whether a text fails, by the text and a function from a measure's name to its column."""

    name: str
    fails: Callable[[Column, Callable[[str], Column]], Column]


class Step(NamedTuple):
    """A rule's place in the cascade: seconds a row, and the share it rejects of the sample's rows that come to it."""

    rule: Rule
    seconds: float
    rejects: float


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))


def _over(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


#: No rule reads a language's own words, so all languages are judged alike.
RULES = [
    Rule("word_length", lambda t, m: _over(m("word_chars"), m("n_words"), 1500) | (m("word_chars") < 2 * m("n_words"))),
    Rule("symbols", lambda t, m: _over(m("n_symbols"), m("n_words"), 10)),
    Rule("duplicate_lines", lambda t, m: (m("n_dup_lines") > 0) & _over(m("n_dup_lines"), F.size(_lines(t)), 30)),
    Rule("capitals", lambda t, m: _over(F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}")), 30)),
    Rule("wordless", lambda t, m: F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]*\p{L}[^ \t\n\x0B\f\r]*")) * 100 < m("n_words") * 75),
    Rule("digits", lambda t, m: _over(F.regexp_count(t, F.lit(r"\p{Nd}")), m("word_chars"), 25)),
    Rule("ellipses", lambda t, m: _over(F.size(F.filter(_lines(t), lambda x: x.rlike("(\\.\\.\\.|\u2026)[ \\t\\x0B\\f\\r]*$"))), F.size(_lines(t)), 30)),
    Rule("bullets", lambda t, m: _over(F.size(F.filter(_lines(t), lambda x: x.rlike("^[ \\t]*[-*\u2022]"))), F.size(_lines(t)), 90)),
    Rule("long_word", lambda t, m: t.rlike(r"[^ \t\n\x0B\f\r]{1000}")),
    Rule("broken_characters", lambda t, m: _over(F.regexp_count(t, F.lit("\ufffd")), m("word_chars"), 1)),
]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    put = known.setdefault
    own = np.fromiter((put(w, len(known)) for w in words), np.int64, len(words))
    windows, reach = own, 1
    while reach < width:  # windows as ranks: two of length `reach` that overlap as little as they can make a longer one
        step = min(reach, width - reach)
        pairs = windows[:-step] * (int(windows.max()) + 1) + windows[step:]
        _, windows, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        reach += step
    often = np.flatnonzero(counts[windows] > 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, often, 1)
    np.add.at(ends, often + width, -1)
    return int((np.cumsum(ends) > 0).sum())


def measured(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(raw.translate(None, _NO_WORD_CHARS)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    """The base measures of UTF-8 texts."""
    rows = [measured(x.as_py()) for x in texts]
    columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def with_measures(docs: DataFrame, *, text_col: str = "text", name: str = "_measures") -> DataFrame:
    """docs with a struct of the base measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A null text counts as empty."""
    return docs.withColumn(name, measures(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def base_fails(m: Callable[[str], Column]) -> Column:
    """Fewer than 10 words, or over 20 in 100 of them in repeated windows."""
    return (m("n_words") < 10) | _over(m("n_repeat_words"), m("n_words"), 20)


def _tried(text: Column, m: Callable[[str], Column], rule: Rule) -> Column:
    return F.coalesce(rule.fails(text, m), F.lit(False))


def greedy(masks: list[tuple[int, int]], seconds: list[float]) -> list[tuple[int, float]]:
    """The order of rules and what each rejects of the rows that come to it: by rejection per cost among the rows that are left.

    masks: which rules reject (a bit each), and how many rows are like this. Rules that reject nothing come last, the cheap
    ones first.
    """
    left, order, todo = list(masks), [], list(range(len(seconds)))
    while todo:
        rows = sum(n for _, n in left)
        share = {k: sum(n for mask, n in left if mask >> k & 1) / max(rows, 1) for k in todo}
        best = max(todo, key=lambda k: (share[k] / seconds[k], -seconds[k], -k))
        order.append((best, share[best]))
        todo.remove(best)
        left = [(mask, n) for mask, n in left if not mask >> best & 1]
    return order


def plan(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Step]:
    """The cascade's order, from at most sample_rows rows (by a hash of id and text) that pass the base rule.

    Each rule is run on the stored sample twice, the quicker run less that of a plain read is its cost. Timings differ from
    run to run and may change the order. On an empty table the rules keep theirs.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    share = min(1.0, 1.1 * sample_rows / max(docs.count(), 1))
    few = rows.where(F.xxhash64("id", "t").cast("double") / 2.0**64 + 0.5 <= share).select("t").limit(sample_rows)
    m = lambda name: F.col("_measures")[name]
    sample = stored(with_measures(few, text_col="t").where(~base_fails(m)), "rules-sample")

    def took(tried: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.sum(tried.cast("int")), F.sum(F.length("t")), F.sum(m("n_words"))).collect()
        return time.perf_counter() - began

    columns = [_tried(F.col("t"), m, r) for r in rules]
    mask = reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(columns)], F.lit(0).cast("long"))
    masks = [(r["mask"], r["count"]) for r in sample.select(mask.alias("mask")).groupBy("mask").count().collect()]
    n = max(sum(count for _, count in masks), 1)
    plain = min(took(F.lit(False)) for _ in range(3))
    seconds = [max(min(took(c) for _ in range(2)) - plain, 1e-5) / n for c in columns]
    return [Step(rules[k], seconds[k], rejects) for k, rejects in greedy(masks, seconds)]


def cascade(docs: DataFrame, steps: list[Step], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row.

    kept is true where neither the base rule nor any rule of the steps rejects: it does not depend on their order. Null and
    empty texts have no words and fail the base rule. Ids may repeat or be null, a row for each comes back. Other columns are
    not read; an empty table gives no rows. Nothing is shuffled.
    """
    text, own = spare(["doc_id"], "text", "measures")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    m = lambda name: F.col(own)[name]
    kept = F.when(base_fails(m), False)
    for step in steps:
        kept = kept.when(_tried(F.col(text), m, step.rule), False)
    return with_measures(rows, text_col=text, name=own).select("doc_id", *[m(name).alias(name) for name in MEASURES], base_fails(m).alias("base_failed"), kept.otherwise(True).alias("kept"))
