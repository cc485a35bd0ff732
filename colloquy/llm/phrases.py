"""Collocations: phrases of two or three words that occur more often than their parts let expect, by language.

Words that are frequent enough to be in any such phrase get numbers, pieces break at all others. Each position is a key of
fixed width, three numbers in a row, so that the keys of a pair's positions are neighbours in the order of keys. Blocks of
documents radix sort and count their own keys first: a phrase that is everywhere travels once a block. Counted keys are dealt
into buckets by a hash of the whole phrase, triples and pairs apart, so a pair that many triples begin with makes no bucket
large; a block sends each bucket one row of packed keys, and a bucket sorts and adds up what all blocks sent. All later steps
read the phrases that are frequent enough and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm._shared import stored
from colloquy.llm.wordblocks import pack, unpack

#: Bytes of text, and distinct words, after which a block is closed.
BLOCK_BYTES, BLOCK_WORDS = 16_000_000, 1_000_000
#: Bytes of a word's number: room for 2^40 frequent words.
WIDTH = 5
#: Places of frequent words for each bucket, about: a bucket's keys are sorted in one task.
BUCKET_PLACES = 1_000_000

# What ends a piece, what lies between words, the language of documents without one.
_ENDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")
NO_LANGUAGE = "und"


class _Block:
    """Documents as one sequence of word numbers, 0 where a piece ends. A word has a number in each language."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.parts: list[tuple[str, np.ndarray]] = []
        self.bytes = self.words = 0

    def add(self, lang: str, raw: bytes) -> None:
        words: list[bytes] = []
        for piece in raw.translate(_ENDS).split(b"\n"):
            if own := piece.split():
                words += own
                words.append(b"")
        known = self.known.setdefault(lang, {b"": 0})
        before, put = len(known), known.setdefault
        self.parts.append((lang, np.fromiter((put(w, len(known)) for w in words), np.uint32, len(words))))
        self.bytes += len(raw)
        self.words += len(known) - before

    def row(self, number: int) -> dict:
        base, start = {}, 0
        for lang, known in self.known.items():
            base[lang] = start
            start += len(known) - 1
        numbers = np.concatenate([np.where(p > 0, p + np.uint32(base[lang]), 0) for lang, p in self.parts] or [np.empty(0)]).astype(np.uint32)
        counts = np.bincount(numbers, minlength=start + 1)[1:]
        words = [{"lang": lang, "word": w} for lang, known in self.known.items() for w in known if w]
        return {"block": number, "numbers": pack(numbers), "words": words, "counts": counts}


_BLOCKS = "block long, numbers binary, words array<struct<lang: string, word: binary>>, counts array<long>"


def _blocks(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_BLOCKS))
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text.cast("string").cast("binary").alias("text")).where(F.length("text") > 0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(lang, text.as_py())
                if now.bytes >= BLOCK_BYTES or now.words >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([now.row(at)], schema=arrow)
                    at, now = at + 1, _Block()
        if now.parts:
            yield pa.RecordBatch.from_pylist([now.row(at)], schema=arrow)

    return rows.mapInArrow(packed, _BLOCKS)


def _numbered(frequent: DataFrame) -> DataFrame:
    """frequent with `id` from 1 on: each partition numbers its rows after those of the partitions before."""
    own = stored(frequent.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "phrase-words")
    # a row for each partition
    before = own.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return own.join(F.broadcast(before), "part").select((F.col("before") + F.col("nth") + 1).alias("id"), "lang", "word", "f")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by columns of numbers, the most significant first: 16 bits at a time, from the last on."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        top, shift = int(column.max(initial=0)), 0
        while top >> shift:
            digit = ((column >> shift) & 0xFFFF).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
            shift += 16
    return order


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of bytes whose order is that of the columns."""
    return np.concatenate([c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :] for c in columns], axis=1)


def ids_of(keys: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in range(0, keys.shape[1], WIDTH):
        wide = np.zeros((len(keys), 8), np.uint8)
        wide[:, 8 - WIDTH :] = keys[:, k : k + WIDTH]
        out.append(wide.reshape(-1).view(">u8").astype(np.int64))
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[len(keys) > 0, (keys[1:] != keys[:-1]).any(1)])


def _bucket_of(columns: list[np.ndarray], n_buckets: int) -> np.ndarray:
    """The bucket of each phrase, by a hash of its words' numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)) % np.uint64(n_buckets)


def _pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").reshape(-1))


def _unpack_keys(blob: bytes, width: int) -> np.ndarray:
    return unpack(blob, f"V{width}").view(np.uint8).reshape(-1, width)


_CHUNKS = "bucket long, triples binary, n_triples binary, pairs binary, n_pairs binary"


def _dealt(columns: list[np.ndarray], sums: np.ndarray, n_buckets: int) -> dict[int, tuple[bytes, bytes]]:
    """Packed keys and counts by bucket."""
    bucket = _bucket_of(columns, n_buckets)
    order = radix_order([bucket.astype(np.int64)])
    bucket, keys, sums = bucket[order], keys_of([c[order] for c in columns]), sums[order].astype(np.uint32)
    starts = np.flatnonzero(np.r_[len(bucket) > 0, bucket[1:] != bucket[:-1]])
    return {int(bucket[s]): (_pack_keys(keys[s:e]), pack(sums[s:e])) for s, e in zip(starts, np.r_[starts, len(bucket)][1:], strict=True)}


def _count_block(n_buckets: int):  # noqa: ANN202
    """One block's places with two frequent words in a row, counted: a row of triples and pairs for each bucket."""

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = unpack(left.column("numbers")[0].as_py(), np.uint32)
        ids = np.zeros(max(int(numbers.max(initial=0)), int(np.asarray(right.column("no")).max(initial=0))) + 1, np.int64)
        ids[np.asarray(right.column("no"))] = np.asarray(right.column("id"))
        said = np.r_[ids[numbers], 0, 0]
        at = np.flatnonzero((said[:-2] > 0) & (said[1:-1] > 0))
        columns = [said[at], said[at + 1], said[at + 2]]
        order = radix_order(columns)
        a, b, c = (x[order] for x in columns)
        new_pair = np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        pair = np.flatnonzero(new_pair)
        triple = np.flatnonzero(new_pair | np.r_[len(a) > 0, c[1:] != c[:-1]])
        n_triples, n_pairs = np.diff(np.r_[triple, len(a)]), np.diff(np.r_[pair, len(a)])
        # 0 where there is no third word
        triple, n_triples = triple[c[triple] > 0], n_triples[c[triple] > 0]
        three, two = _dealt([a[triple], b[triple], c[triple]], n_triples, n_buckets), _dealt([a[pair], b[pair]], n_pairs, n_buckets)
        none = (None, None)
        rows = [(k, *three.get(k, none), *two.get(k, none)) for k in sorted({*three, *two})]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i, name in enumerate(("bucket", "triples", "n_triples", "pairs", "n_pairs"))})

    return counted


class _Runs:
    """Adds up neighbours of one key over any number of batches; the run at the end waits for the next batch."""

    def __init__(self, width: int):
        self.keys, self.sums = np.empty((0, width), np.uint8), np.empty(0, np.int64)

    def feed(self, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = np.concatenate([self.keys, keys]), np.r_[self.sums, sums]
        starts = _starts(keys)
        if not len(starts):
            return keys, sums
        keys, sums = keys[starts], np.add.reduceat(sums, starts)
        self.keys, self.sums = keys[-1:], sums[-1:]
        return keys[:-1], sums[:-1]


def _add_up(least: int):  # noqa: ANN202
    """A bucket's rows to its phrases that are frequent enough."""

    def total(keys: list, sums: list, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        said = [(_unpack_keys(k, width), unpack(n, np.uint32)) for k, n in zip(keys, sums, strict=True) if k is not None]
        own = np.concatenate([k for k, _ in said] or [np.empty((0, width), np.uint8)])
        order, runs = radix_order(ids_of(own)), _Runs(width)
        found, n = runs.feed(own[order], np.concatenate([n for _, n in said] or [np.empty(0)]).astype(np.int64)[order])
        found, n = np.concatenate([found, runs.keys]), np.r_[n, runs.sums]
        take = n >= least
        return ids_of(found[take]), n[take]

    def added(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_pylist()
        (a, b, c), f = total(column("triples"), column("n_triples"), 3 * WIDTH)
        (d, e), g = total(column("pairs"), column("n_pairs"), 2 * WIDTH)
        return pa.table({"a": np.r_[a, d], "b": np.r_[b, e], "c": np.r_[c, np.zeros(len(g), np.int64)], "f": np.r_[f, g]})

    return added


def _chunks(blocks: DataFrame, words: DataFrame, n_buckets: int) -> DataFrame:
    """The counted phrases of each block, packed: one row for each bucket that has any."""
    asked = blocks.select("block", F.posexplode("words").alias("no", "w")).select("block", (F.col("no") + 1).alias("no"), F.col("w.lang").alias("lang"), F.col("w.word").alias("word"))
    known = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "no", "id")
    return blocks.select(F.col("block").alias("own"), "numbers").groupBy("own").cogroup(known.groupBy("block")).applyInArrow(_count_block(n_buckets), _CHUNKS)


def _phrase_counts(blocks: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(a, b, c, f): the numbers of two or three words, c 0 for two, of all phrases with f >= least."""
    places = words.agg(F.sum("f")).first()[0] or 0
    n_buckets = places // BUCKET_PLACES + 1
    n_tasks = max(n_buckets, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _chunks(blocks, words, n_buckets).repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(_add_up(least), "a long, b long, c long, f long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact: counts up to 10^14 stay within 38 digits."""
    return F.expr(f"(1000000BD * cast({a} AS decimal(14, 0)) * cast({a} AS decimal(14, 0))) div (cast({left} AS decimal(19, 0)) * cast({right} AS decimal(19, 0)))").cast("long")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best phrases (all, if None).

    Texts are lower-cased (A-Z) and split into pieces at `[.,;:!?\\x0A-\\x0D]`, those into words at space and tab. a is a phrase's
    number of occurrences within pieces, at least `least`; l and r are those of its two parts at the cut that scores lowest
    (of equal ones the first), n all words of the language, score floor(1000000 a a / (l r)). A pair goes where a phrase of
    three words that is frequent enough holds it in at least `share` in 100 of its occurrences. Order: score, a, then the
    phrase's bytes. A null lang is `und`; null and empty texts say nothing; repeated rows count again; an empty table gives
    no rows; columns besides the two are not read. A text is in one block whole, so a task needs memory for the longest.
    """
    blocks = stored(_blocks(docs, F.col(lang_col), F.col(text_col)), "phrase-blocks")
    said = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words.lang").alias("lang"), F.col("w.words.word").alias("word"), F.col("w.counts").alias("count"))
    counts = said.groupBy("lang", "word").agg(F.sum("count").alias("f"))
    totals = said.groupBy("lang").agg(F.sum("count").alias("n"))
    words = stored(_numbered(counts.where(F.col("f") >= least)), "phrase-dictionary")
    found = stored(_phrase_counts(blocks, words, least), "phrase-counts")

    pairs, triples = found.where("c = 0"), found.where("c > 0")
    held = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("held"))
    kept = pairs.join(held, ["a", "b"], "left").where(F.coalesce(100 * F.col("held") < share * F.col("f"), F.lit(True))).select("a", "b", "c", "f", F.lit(None).cast("long").alias("ab"), F.lit(None).cast("long").alias("bc"))
    ab, bc = pairs.select("a", "b", F.col("f").alias("ab")), pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("bc"))
    phrases = kept.unionByName(triples.join(ab, ["a", "b"]).join(bc, ["b", "c"]).select("a", "b", "c", "f", "ab", "bc"))

    def word(k: str, *more: str) -> DataFrame:
        return words.select(F.col("id").alias(k), F.col("f").alias(f"f{k}"), F.col("word").cast("string").alias(f"w{k}"), *more)

    named = phrases.join(word("a", "lang"), "a").join(word("b"), "b").join(word("c"), "c", "left")
    pair = F.col("c") == 0
    cuts = named.withColumns({"s1": F.when(pair, _score("f", "fa", "fb")).otherwise(_score("f", "fa", "bc")), "s2": F.when(~pair, _score("f", "ab", "fc"))})
    early = pair | (F.col("s1") <= F.col("s2"))
    scored = cuts.select(
        "lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), F.when(early, F.col("fa")).otherwise(F.col("ab")).alias("l"),
        F.when(pair, F.col("fb")).when(early, F.col("bc")).otherwise(F.col("fc")).alias("r"), F.when(early, F.col("s1")).otherwise(F.col("s2")).alias("score"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
