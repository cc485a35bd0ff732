"""Fill-in-middle examples through ropes.

A text becomes a rope: a balanced tree whose leaves hold some hundred units each (a run of ASCII letters, or any other single
code point) and whose nodes carry the counts of units and code points below them. Two splits at unit ranks give prefix,
middle and suffix as subtrees, which are joined in a new order with sentinels between; splitting the rope of an output at the
sentinels' places and joining the parts gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units in a leaf, and bytes of text in a batch that goes back to Spark.
LEAF_UNITS, BATCH_BYTES = 512, 8_000_000

_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


class Rope(NamedTuple):
    """A leaf, with its text, or two subtrees; counts of what is below."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


NOTHING = Rope(0, 0)


def joined(a: Rope, b: Rope) -> Rope:
    """Both in a row. No run of letters may go on from one into the other."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    return Rope(a.units + b.units, a.chars + b.chars, "", a, b)


def rope(text: str) -> Rope:
    """A balanced rope of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    starts = np.flatnonzero(~letter | ~np.r_[False, letter[:-1]])
    cuts = [*starts[::LEAF_UNITS].tolist(), len(text)]
    level = [Rope(min(LEAF_UNITS, len(starts) - n * LEAF_UNITS), e - s, text[s:e]) for n, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    while len(level) > 1:
        level = [joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else NOTHING


def split(tree: Rope, rank: int, *, chars: bool = False) -> tuple[Rope, Rope]:
    """The first `rank` units (or code points, where a unit ends there) and the rest."""
    size = tree.chars if chars else tree.units
    if rank <= 0 or rank >= size:
        return (NOTHING, tree) if rank <= 0 else (tree, NOTHING)
    if tree.left is None:
        at = rank if chars else next(islice(_UNIT.finditer(tree.text), rank, None)).start()
        units = len(_UNIT.findall(tree.text, 0, at)) if chars else rank
        return Rope(units, at, tree.text[:at]), Rope(tree.units - units, tree.chars - at, tree.text[at:])
    within = tree.left.chars if chars else tree.left.units
    if rank <= within:
        a, b = split(tree.left, rank, chars=chars)
        return a, joined(b, tree.right)
    a, b = split(tree.right, rank - within, chars=chars)
    return joined(tree.left, a), b


def flat(tree: Rope) -> str:
    """The text of a rope: its leaves from left to right."""
    parts, left = [], [tree]
    while left:
        now = left.pop()
        if now.left is None:
            parts.append(now.text)
        else:
            left += [now.right, now.left]
    return "".join(parts)


def rearranged(tree: Rope, form: str, first: int, second: int) -> tuple[Rope, int, int]:
    """The rope of the example, and code points of prefix and middle; first and second are unit ranks, first the smaller."""
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, second - first)
    p, s, m = (Rope(3, 3, x) for x in (PREFIX, SUFFIX, MIDDLE))
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = NOTHING
    for part in order:
        out = joined(out, part)
    return out, prefix.chars, middle.chars


def rebuilt(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    one, two = output.index(inner, 3), output.index(MIDDLE)
    front, last = split(rope(output), two, chars=True)
    front, second = split(front, one, chars=True)
    (_, first), (_, second), (_, middle) = (split(x, 3, chars=True) for x in (front, second, last))
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return "".join(map(flat, (prefix, middle, suffix)))


def _example(text: str, h: tuple[int, int, int, int], keep: int, spm: int) -> tuple[int, str, str, int | None, int | None]:
    tree = rope(text)
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= keep:
        return tree.units, "plain", text, None, None
    form = "spm" if h[3] % 100 < spm else "psm"
    ranks = sorted((h[0] % (tree.units + 1), h[1] % (tree.units + 1)))
    out, prefix, middle = rearranged(tree, form, *ranks)
    return tree.units, form, flat(out), prefix, middle


def _by_bytes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column `at` has about BATCH_BYTES in each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield batch.slice(s, e - s)


def hashes(key: Column, seed: str = "1") -> list[Column]:
    """The first four 8-digit groups of the sha256 of `seed:key` as numbers; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", keep: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row.

    `keep` in 100 documents are cut, `spm` in 100 of those with the suffix first; cuts follow the id, so a document is cut alike
    wherever and whenever it is. Plain stay empty and null texts (n 0, output empty) and texts that hold a sentinel: their
    code points are null. Ids may repeat or be null, a row for each comes back. Other columns are not read; an empty table
    gives no rows. Nothing is shuffled, and a task holds a few MB of texts, or one text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col(id_col), seed), 1)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, 1):
            h = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            made = [_example(t.decode("utf-8", "surrogateescape"), x, keep, spm) for t, x in zip(batch.column(1).to_pylist(), h, strict=True)]
            n, form, out, prefix, middle = (list(x) for x in zip(*made, strict=True))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([x.encode("utf-8", "surrogateescape") for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(examples: DataFrame, *, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """examples with the text that each output was made of, from output and form alone; a column of that name is replaced.

    A null output is an empty text, a null form plain.
    """

    @F.arrow_udf(T.BinaryType())
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts = zip(outputs.to_pylist(), forms.to_pylist(), strict=True)
        return pa.array([rebuilt(o.decode("utf-8", "surrogateescape"), f).encode("utf-8", "surrogateescape") for o, f in texts], pa.binary())

    text, form = F.coalesce(F.col(output_col).cast("string"), F.lit("")).cast("binary"), F.coalesce(F.col(form_col), F.lit("plain"))
    return examples.withColumn(name, back(text, form).cast("string"))


def digests(examples: DataFrame) -> DataFrame:
    """Examples with digests in place of their texts; restored_sha256 is that of the text rebuilt from the output."""
    back = restore(examples)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
