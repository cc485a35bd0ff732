"""SimHash near-duplicates found through a Golay code.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits, each read as a word of the binary Golay code
[23, 12] with leading zeros. Every 23-bit word lies within 3 bits of exactly one codeword. The keys of a segment
are the codewords nearest to it and to each of its one-bit neighbours, 6 at most: two segments at a distance of 2
or less have a common word within one bit of either, hence a common key. Of 4 differing bits in three segments at
most one segment has more than 2, so two linked fingerprints share the keys of at least two segments. Fingerprints
meet on the keys of each pair of segments, and the distance of those that meet is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm._shared import spare, stored
from colloquy.llm.components import components

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((43, 21), (22, 21), (0, 22))
DISTANCE = 4
_RUN = 64


def _remainders(n_bits: int) -> np.ndarray:
    """Remainder by GENERATOR of every word of n_bits."""
    one = np.zeros(n_bits, np.uint32)
    for i in range(n_bits):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        one[i] = x
    out = np.zeros(1 << n_bits, np.uint32)
    for i in range(n_bits):
        out[1 << i : 2 << i] = out[: 1 << i] ^ one[i]
    return out


class Golay:
    def __init__(self) -> None:
        self.rest = _remainders(23).astype(np.uint16)
        self.error = np.zeros(2048, np.uint32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                self.error[self.rest[e]] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 leading bits of the codeword nearest to each word."""
        return (words ^ self.error[self.rest[words]]) >> np.uint32(11)

    def keys(self, words: np.ndarray, width: int) -> np.ndarray:
        """Rows of up to 6 distinct keys, the others -1."""
        near = np.stack([words, *(words ^ np.uint32(1 << i) for i in range(width))], 1)
        found = np.sort(self.index(near).astype(np.int64), 1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, 1)[:, :6]


_golay: Golay | None = None


def pair_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) of 64-bit fingerprints."""
    global _golay
    _golay = _golay or Golay()
    own = [_golay.keys((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32), width) for at, width in SEGMENTS]
    keys, which = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        key = own[i][:, :, None] << 12 | own[j][:, None, :] | n << 24
        there = (own[i][:, :, None] >= 0) & (own[j][:, None, :] >= 0)
        keys.append(key[there])
        which.append(np.repeat(prints, there.sum((1, 2))))
    return np.concatenate(keys), np.concatenate(which)


def shingle_digests(text: str | None, width: int = 4) -> bytes:
    """8 bytes for each word shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return b""
    plain = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(plain, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return b"".join(map(xxhash.xxh64_digest, [plain[s : e - 1] for s, e in zip(starts, ends[width - 1 :], strict=False)], repeat(42)))


def vote(digests: bytes) -> bytes:
    """64 bits, the most significant first: each is 1 if set in over half the digests."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    votes = sum((np.unpackbits(rows[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(rows), 65536)), np.zeros(64, np.int64))
    return np.packbits(votes * 2 > len(rows)).tobytes()


def fingerprint(text: str | None, width: int = 4) -> bytes:
    """The vote of the text's word shingles."""
    return vote(shingle_digests(text, width))


def fingerprints(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, fp): every row's id, a hash of its text, and its fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = b"".join(fingerprint(t.as_py(), width) for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], ["doc_id", "copy", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, copy long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what the links among prints join, fewer than there are prints."""
    left = np.unique(prints)
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for seed in queue.pop():
                near = _distance(left, seed) <= DISTANCE
                if near.any():
                    found, left = left[near], left[~near]
                    yield np.full(len(found), seed), found
                    queue.append(found)


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys are sorted. Runs of up to _RUN rows give their links, longer ones a spanning forest of theirs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for s, m in zip(starts[sizes > _RUN], sizes[sizes > _RUN], strict=True):
        for x, y in _forest(prints[s : s + m]):
            a.append(x)
            b.append(y)
    some = np.repeat((sizes > 1) & (sizes <= _RUN), sizes)
    keys, prints = keys[some], prints[some]
    for d in range(1, _RUN):
        i = np.flatnonzero(keys[:-d] == keys[d:])
        if not len(i):
            break
        near = i[_distance(prints[i], prints[i + d]) <= DISTANCE]
        a.append(prints[near])
        b.append(prints[near + d])
    return np.concatenate([*a, prints[:0]]), np.concatenate([*b, prints[:0]])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at DISTANCE or less.

    Where many fingerprints meet on a key, a spanning forest of their links stands for them all, so the table grows
    as the fingerprints do. All of a task's rows of a key stream through it in order.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(own), 4096):
                keys, which = pair_keys(own[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(which.view(np.int64))], ["key", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int32), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                a, b = _links(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})
        if len(keys):
            a, b = _links(keys, prints)
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    table = prints.select("fp").distinct().mapInArrow(keyed, "key int, fp long")
    return table.repartition("key").sortWithinPartitions("key").mapInArrow(met, "a long, b long")


def _classes(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, root): each fingerprint's least id, and the one that stands for its component."""
    prints = stored(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "simhash")
    roots = stored(components(links(prints)), "simhash-roots")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, classes.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Words are what lies between ASCII white space, A-Z in lower case; a text of fewer words than a shingle is one
    shingle; one without words, empty or null has fingerprint zero and is linked like any other. component_id is
    the smallest id reachable by links; ids that are null take no part in that minimum. Repeated rows are separate
    rows of one component. An empty table gives no rows. Other columns are not read.
    """
    prints, classes = _classes(docs, width, id_col, text_col)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, with no id only where none has one.

    Of different texts under that id the one with the least hash stays, and of repeated rows one. An empty table stays empty.
    Other columns are kept and may have any name.
    """
    prints, classes = _classes(docs, width, id_col, text_col)
    first = prints.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "copy", F.col("doc_id").cast("string").alias("s"))).alias("f"))
    *key, nth = spare(docs.columns, "id", "null", "copy", "nth")
    chosen = first.select(F.coalesce("f.s", F.lit("")).alias(key[0]), F.col("f.n").alias(key[1]), F.col("f.copy").alias(key[2]))
    rows = docs.withColumns(dict(zip(key, (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.xxhash64(text_col)), strict=True)))
    kept = rows.join(chosen, key).withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    return kept.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
