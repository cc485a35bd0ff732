"""Near copies by Jaccard similarity of word shingles, found by SimHash and, beyond its reach, by min-hash bands.

A text is the set of its shingles' hashes. Equal sets are one node from the start. The fingerprints of all texts meet on Golay keys
(`simhash.links`); where the sets behind a link are similar enough, shingle by shingle, they are joined, and what SimHash has joined
is not compared again. Two sets of similarity 0.8 differ in some ten bits of 64, more than Golay keys of pairs of segments find, so
minima of each set under BANDS * ROWS hash functions make BANDS keys for the rest; two sets of similarity s share no key
with probability (1 - s^ROWS)^BANDS, below 4e-6 at 0.8. Every link is a verified one. Where more than
_RUN sets meet on a key, their links are searched breadth-first from a seed, each found one being a seed for the rest:
a spanning forest of all their links, without all pairs of them. Only keys are written for every text; sets are made again for those
texts that meet another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm import simhash
from colloquy.llm._shared import spare, stored
from colloquy.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
_RUN = 64
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
_MIX = _rng.integers(0, 2**63, (ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    return distinct(simhash.shingle_digests(text, width))


def distinct(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(own), 2048):
        least = np.minimum(least, (own[i : i + 2048, None] * _A + _B).min(0))
    keys = np.zeros(BANDS, np.uint64)
    for m, row in zip(_MIX, least.reshape(ROWS, BANDS), strict=True):
        keys = (keys ^ row) * m
        keys ^= keys >> np.uint64(29)
    return keys + np.arange(BANDS, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _forest(prints: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    left, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            seed = queue.pop()
            own = sets[seed]
            starts = np.r_[0, np.cumsum(sizes[left])[:-1]]
            flat = np.concatenate([sets[i] for i in left])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
            near = both >= similarity * (len(own) + sizes[left] - both) - 1e-9
            for i in left[near]:
                yield int(prints[seed]), int(prints[i])
                queue.append(i)
            left = left[~near]


def _verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (fp, set) are similar enough."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda of, name: known.select(F.col("fp").alias(of), F.col("set").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")


def _by_fingerprint(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: sets whose SimHash fingerprints (columns fp, print) are linked, as many as make a forest.

    Of the sets with one fingerprint each meets the least, and the least of linked fingerprints meet.
    """
    own = keys.where(F.length("keys") > 0).groupBy("print").agg(F.min("fp").alias("least"))
    same = keys.where(F.length("keys") > 0).join(own, "print").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(own.select(F.col("print").alias("fp"))).distinct()
    name = lambda of: own.select(F.col("print").alias(f"print_{of}"), F.col("least").alias(of))
    far = near.toDF("print_a", "print_b").join(name("a"), "print_a").join(name("b"), "print_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(far).where("a <> b").distinct()


def _by_bands(keys: DataFrame) -> DataFrame:
    """(a, b, big): sets that meet on a key of the min-hash bands as pairs, or as (key, set, true) where very many meet."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_pydict({"key": keys, "fp": np.repeat(batch.column("fp").to_numpy(), BANDS)})

    def runs(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.repeat(np.diff(np.r_[starts, len(keys)]), np.diff(np.r_[starts, len(keys)]))
        many, some = size > _RUN, (size > 1) & (size <= _RUN)
        a, b, big = [keys[many]], [prints[many]], [np.ones(many.sum(), bool)]
        keys, prints = keys[some], prints[some]
        for d in range(1, _RUN):
            i = np.flatnonzero(keys[:-d] == keys[d:])
            if not len(i):
                break
            a.append(prints[i])
            b.append(prints[i + d])
            big.append(np.zeros(len(i), bool))
        return pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b), "big": np.concatenate(big)})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield runs(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield runs(keys, prints)

    table = keys.where(F.length("keys") > 0).select("keys", "fp").mapInArrow(keyed, "key long, fp long")
    return table.repartition("key").sortWithinPartitions("key").mapInArrow(met, "a long, b long, big boolean")


def links(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between distinct sets (columns fp, print, keys), or a spanning forest of them where very many meet.

    sets_of gives (fp, set) of the sets that are asked for (column fp).
    """

    def forest(table: pa.Table) -> pa.Table:
        prints = table.column("b").to_numpy()
        found = list(_forest(prints, [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()], similarity))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = stored(_by_bands(keys), "neardup-met")
    pairs = found.where("NOT big").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = found.where("big").select("a", "b")
    by_print = stored(_by_fingerprint(keys), "neardup-prints")
    ends = F.explode(F.array("a", "b")).alias("fp")
    asked = pairs.select(ends).unionByName(by_print.select(ends)).unionByName(large.select(F.col("b").alias("fp"))).distinct()
    known = stored(sets_of(asked), "neardup-asked")
    near = stored(_verified(by_print, known, similarity), "neardup-near")
    joined = stored(components(near), "neardup-joined")
    root = lambda of: joined.select(F.col("node").alias(of), F.col("root").alias(f"root_{of}"))
    open_pairs = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where("NOT coalesce(root_a = root_b, false)").select("a", "b")
    in_large = large.join(known.select(F.col("fp").alias("b"), "set"), "b")
    return near.unionByName(_verified(open_pairs, known, similarity)).unionByName(in_large.groupBy("a").applyInArrow(forest, "a long, b long"))


def one_of_each(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of texts linked by Jaccard similarity the one with the smallest id, a null id last.

    Words lie between ASCII white space, A-Z in lower case. Texts without words are copies of each other. Of different
    texts under the least id the one with the least hash stays, and of repeated rows one. An empty table stays empty. Other
    columns are kept and may have any name.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_of = [simhash.shingle_digests(t.as_py(), width) for t in batch.column("text")]
            own = [distinct(d) for d in all_of]
            prints = np.frombuffer(b"".join(map(simhash.vote, all_of)), ">i8").astype(np.int64)
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), 3) for s in own], np.uint64).view(np.int64)
            keys = [band_keys(s).tobytes() if len(s) else b"" for s in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(fps), pa.array(prints), pa.array(keys, pa.binary())], ["doc_id", "copy", "fp", "print", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(own, pa.binary())], ["fp", "set"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    own = stored(rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, copy long, fp long, print long, keys binary"), "neardup")
    # one text of each set stands for it; texts of one set may differ in repeats and so in prints
    keys = own.groupBy("fp").agg(F.min("print").alias("print"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "copy")).alias("of"))

    def sets_of(asked: DataFrame) -> DataFrame:
        of = keys.join(asked, "fp", "left_semi").select("fp", F.col("of.doc_id").alias("own_id"), F.col("of.copy").alias("own_copy"))
        texts = rows.join(of, (F.col("copy") == F.col("own_copy")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("fp", "text")
        return texts.mapInArrow(sets, "fp long, set binary").groupBy("fp").agg(F.first("set").alias("set"))

    roots = stored(components(links(keys, sets_of, similarity)), "neardup-roots")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "copy", F.col("doc_id").cast("string").alias("s")))
    first = own.groupBy("fp").agg(place.alias("f")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    first = first.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("f").alias("f"))
    *key, nth = spare(docs.columns, "id", "null", "copy", "nth")
    chosen = first.select(F.coalesce("f.s", F.lit("")).alias(key[0]), F.col("f.n").alias(key[1]), F.col("f.copy").alias(key[2]))
    whole = docs.withColumns(dict(zip(key, (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.xxhash64(text_col)), strict=True)))
    kept = whole.join(chosen, key).withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    return kept.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
