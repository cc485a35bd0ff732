"""Documents as blocks of numbered words.

A block is some tens of MB of text of one input partition: its distinct words, and each document as an array of
word numbers. Blocks are written once to the shared folder. What depends on a word anywhere in the corpus is then
looked up by word instead of by position: each block sends its distinct words, dealt into buckets by hash, once;
a bucket sees every block's words of its share, works out a value for each distinct word, and answers each block in
the order in which it asked. A word that is frequent everywhere travels once per block, so no bucket is hot, and
no table of words of the whole corpus is gathered anywhere.

Blocks are bucketed files (by block number), so that joining the answers back does not shuffle the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._shared import scratch_path, scratch_table

#: Bytes of text, and distinct words, after which a block is closed.
BLOCK_BYTES, BLOCK_WORDS = 16_000_000, 1_000_000
#: Bytes of input for each bucket, at most: a bucket's share of all blocks' words is held by one task.
BUCKET_BYTES = 64_000_000


def pack(values: np.ndarray) -> bytes:
    """Compressed integers: the bytes of each significance together."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T if len(values) else np.empty((width, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split()


class _Open:
    def __init__(self, number: int, n_buckets: int):
        self.number, self.n_buckets = number, n_buckets
        self.known: dict[bytes, int] = {}
        self.keys: list = []
        self.flags: list[bool] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key: object, words: list[bytes], flag: bool) -> None:
        known = self.known
        put = known.setdefault
        self.parts.append(np.fromiter((put(w, len(known)) for w in words), np.uint32, len(words)))
        self.keys.append(key)
        self.flags.append(flag)
        self.bytes += sum(map(len, words))

    def row(self) -> dict:
        sizes = np.array([len(p) for p in self.parts], np.int64)
        tokens = np.concatenate([*self.parts, np.empty(0, np.uint32)]).astype(np.uint32)
        flagged = np.repeat(np.array(self.flags, bool), sizes)
        n = len(self.known)
        uses, in_flagged = np.bincount(tokens, minlength=n), np.bincount(tokens[flagged], minlength=n)
        words = list(self.known)
        bucket = np.fromiter((xxhash.xxh32_intdigest(w, 7) % self.n_buckets for w in words), np.int64, n)
        # by bucket, then the most used first: small numbers compress well within a bucket's range
        order = np.lexsort((-uses, bucket))
        by_use = np.empty(n, np.uint32)
        by_use[order] = np.arange(n, dtype=np.uint32)
        ends = np.cumsum(np.bincount(bucket, minlength=self.n_buckets))
        blobs, counts = [], []
        for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True):
            blobs.append(pack_words([words[i] for i in order[s:e]]))
            counts.append(pack(in_flagged[order[s:e]].astype(np.uint32)))
        # numbers in the stored documents: by use over the whole block; `order` maps a use rank to a word number
        rank = np.argsort(-uses, kind="stable")
        place = np.empty(n, np.uint32)
        place[rank] = np.arange(n, dtype=np.uint32)
        return {"block": self.number, "keys": self.keys, "sizes": sizes.astype(np.int32), "flags": self.flags, "tokens": pack(place[tokens]), "ranks": pack(by_use[rank]), "words": blobs, "counts": counts, "n_words": n}


class Blocks:
    """A written table of blocks, and the way to look words up."""

    COLUMNS = ("block", "keys", "sizes", "flags", "tokens", "ranks")

    def __init__(self, df: DataFrame, n_buckets: int, key_type: str):
        self.df, self.n_buckets, self.key_type = df, n_buckets, key_type

    def look_up(self, answer: Callable[[int, list[tuple[int, list[bytes], dict[str, bytes]]]], Iterator[dict]], schema: str, extra: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """answer(bucket, [(block, words, blobs)]) is called for each bucket; its dicts become rows of schema.

        carry names the per-bucket blob columns to send along: "counts", or columns of extra (block, bucket, ...).
        """
        own = [c for c in carry if c == "counts"]
        asked = self.df.select("block", F.posexplode(F.arrays_zip("words", *own)).alias("bucket", "_z")).select("block", "bucket", F.col("_z.words").alias("words"), *[F.col(f"_z.{c}").alias(c) for c in own])
        if extra is not None:
            asked = asked.join(extra, ["block", "bucket"])

        def grouped(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            rows.sort(key=lambda r: r["block"])
            asked_by = [(r["block"], unpack_words(r["words"]), {c: r[c] for c in carry}) for r in rows]
            return pa.Table.from_pylist(list(answer(rows[0]["bucket"], asked_by)), schema=arrow)

        arrow = _arrow(self.df.sparkSession, schema)
        return asked.groupBy("bucket").applyInArrow(grouped, schema)

    def with_answers(self, answers: DataFrame, fn: Callable[[dict, dict[str, list]], Iterator[pa.Table]], schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
        """fn(block row, answer columns as lists by bucket) for each block; answers has block and bucket."""
        arrow = _arrow(self.df.sparkSession, schema)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            got = right.sort_by("bucket").to_pydict() if right.num_rows else {n: [] for n in right.schema.names}
            for row in left.to_pylist():
                out += list(fn(row, got))
            return pa.concat_tables([*out, arrow.empty_table()]).cast(arrow)

        return self.df.select(*self.COLUMNS, *columns).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)

    def each(self, fn: Callable[[dict], Iterator[pa.RecordBatch]], schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
        """fn(block row) for each block, without a shuffle."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(len(batch)):
                    yield from fn(batch.slice(n, 1).to_pylist()[0])

        return self.df.select(*self.COLUMNS, *columns).mapInArrow(run, schema)


def numbers(row: dict) -> np.ndarray:
    """All documents' words as word numbers: positions in the concatenation of the block's bucket lists."""
    return unpack(row["ranks"], np.uint32)[unpack(row["tokens"], np.uint32)]


def _arrow(spark, schema: str) -> pa.Schema:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def bucket_count(docs: DataFrame) -> int:
    """Buckets follow the size of the input that the plan knows of, and are no fewer than the shuffle partitions."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-known // BUCKET_BYTES)) if known < 1 << 60 else least


def build(docs: DataFrame, key: Column, text: Column, flag: Column, *, lower: bool = False, label: str = "blocks", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write docs as blocks. flag marks the documents whose words `counts` counts; a null flag is false.

    Words lie between ASCII white space; lower puts A-Z in lower case. A null text has no words. Every row has its
    place, in no particular order; keys may repeat or be null. An empty table gives no blocks. A text is in one block
    whole, so a task needs memory for the longest text; blocks number the data's size over block_bytes.
    """
    spark = docs.sparkSession
    n_buckets = bucket_count(docs)
    rows = docs.select(key.alias("key"), text.cast("string").cast("binary").alias("text"), F.coalesce(flag, F.lit(False)).alias("flag"))
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"block long, keys array<{key_type}>, sizes array<int>, flags array<boolean>, tokens binary, ranks binary, words array<binary>, counts array<binary>, n_words int"
    arrow = _arrow(spark, schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        now = _Open(at, n_buckets)
        for batch in batches:
            keys, flags, texts = batch.column("key").to_pylist(), batch.column("flag").to_pylist(), batch.column("text")
            for k, f, t in zip(keys, flags, texts, strict=True):
                raw = t.as_py() or b""
                now.add(k, (raw.lower() if lower else raw).split(), f)
                if now.bytes >= block_bytes or len(now.known) >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=arrow)
                    at += 1
                    now = _Open(at, n_buckets)
        if now.keys:
            yield pa.RecordBatch.from_pylist([now.row()], schema=arrow)

    name = f"colloquy_{label}_{uuid.uuid4().hex}"
    scratch_table(name)
    rows.mapInArrow(blocks, schema).write.bucketBy(min(n_buckets, 100_000), "block").option("path", scratch_path(spark, label)).format("parquet").saveAsTable(name)
    return Blocks(spark.table(name), n_buckets, key_type)
