"""BPE encoding and decoding through a distinct-word table.

Words are split in Spark tasks, each distinct word is encoded once in the bucket of the corpus-wide word table that it
belongs to, and ids are joined back by position within each block. Decoding joins ids with the vocabulary's
table of pieces: encode_decode() joins each block's ids of distinct words with it in Arrow, decode() is the same join
for any table of id lists, as a Spark join. White space never lies within a token of this kind of vocabulary, and
normalisation does not reach across it, so a text's ids are its words' ids one after the other.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import wordblocks
from colloquy.llm._shared import spare
from colloquy.llm.wordblocks import pack, unpack

_loaded: dict = {}


def vocabulary(name: str) -> str:
    """Where an installed vocabulary file is, by name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):  # noqa: ANN202
    """One tokenizer in each worker process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        if tok.decoder is not None:
            raise ValueError("pieces are joined by a space only where the tokenizer has no decoder of its own")
        size = max(tok.get_vocab().values()) + 1
        _loaded[path] = tok, pa.array([(tok.id_to_token(i) or "").encode() for i in range(size)], pa.large_binary())
    return _loaded[path]


def tokenizer(path: str):  # noqa: ANN201
    return _tokenizer(path)[0]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary, as many rows as it has entries."""
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(_tokenizer(path)[1])), pa.int32()), "piece": _tokenizer(path)[1].cast(pa.large_string())}))


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids, special tokens kept: a join of ids with pieces.

    Each different list is decoded once. An empty list is an empty text, a null one null; an id that the vocabulary has not
    is left out. The broadcast side has the vocabulary's size. A column of the given name is replaced.
    """
    plain = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != name.lower()])
    lists = plain.where(F.size(ids_col) > 0).select(F.col(ids_col).alias("ids")).distinct()
    named = lists.select("ids", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces(rows.sparkSession, path)), "id")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    key, text = spare(plain.columns, "ids", "text")
    texts = named.groupBy("ids").agg(said.alias(text)).withColumnRenamed("ids", key)
    out = plain.join(texts, F.col(ids_col) == F.col(key), "left")
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], F.when(F.col(ids_col).isNotNull(), F.coalesce(text, F.lit(""))).alias(name))


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and the number of ids of each word."""
    tok, _ = _tokenizer(path)
    flat, sizes = [], np.empty(len(words), np.uint32)
    for s in range(0, len(words), 20000):
        for n, e in enumerate(tok.encode_batch_fast([w.decode("utf-8", "replace") for w in words[s : s + 20000]], add_special_tokens=False), s):
            ids = e.ids
            sizes[n] = len(ids)
            flat.append(np.array(ids, np.uint32))
    return np.concatenate([*flat, np.empty(0, np.uint32)]), sizes


def _answers(path: str):  # noqa: ANN202
    def answer(bucket: int, asked: list) -> Iterator[dict]:
        known: dict[bytes, int] = {}
        asks = []
        for block, words, _ in asked:
            put = known.setdefault
            asks.append((block, np.fromiter((put(w, len(known)) for w in words), np.int64, len(words))))
        flat, sizes = encode_words(list(known), path)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        for block, which in asks:
            n = sizes[which].astype(np.int64)
            at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield {"block": block, "bucket": bucket, "ids": pack(flat[at].astype(np.uint32)), "sizes": pack(sizes[which])}

    return answer


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, block_bytes: int = 12_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with texts also ids and decoded themselves.

    ids are those of the tokenizer file at path, without added special tokens, truncation or padding; decoding keeps
    special tokens. A null or empty text has no ids and decodes to nothing. Ids and rows may repeat or be null, a
    row for each comes back. Other columns are not read. block_bytes is the text that a worker holds at once: smaller
    blocks take less memory, and more disk for words that blocks share. An empty table gives no rows.
    """
    blocks = wordblocks.build(docs, F.col(id_col), F.col(text_col), F.lit(False), label="bpe", block_bytes=block_bytes)
    schema = f"doc_id {blocks.key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    answers = blocks.look_up(_answers(path), "block long, bucket int, ids binary, sizes binary")

    def finish(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        table = _tokenizer(path)[1]
        raw, shown, count = [], [], []
        for ids, sizes in zip(got["ids"], got["sizes"], strict=True):
            own, n = unpack(ids, np.uint32), unpack(sizes, np.uint32).astype(np.int64)
            # ids with their pieces, then the pieces of each word together
            named = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(n)], table.take(pa.array(own.astype(np.int64))))
            shown += pc.binary_join(named, pa.scalar(b" ", pa.large_binary())).to_pylist()
            data, begin = own.astype("<u4").tobytes(), 0
            for end in np.cumsum(n).tolist():
                raw.append(data[4 * begin : 4 * end])
                begin = end
            count.append(n)
        has_ids = np.concatenate([*count, np.empty(0, np.int64)]) > 0
        all_have = bool(has_ids.all())
        tokens, at = wordblocks.numbers(row), 0
        out: dict[str, list] = {"doc_id": row["keys"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if texts else {})
        for size in row["sizes"]:
            own = tokens[at : at + size]
            at += size
            data = b"".join(map(raw.__getitem__, own.tolist()))
            said = b" ".join(map(shown.__getitem__, (own if all_have else own[has_ids[own]]).tolist()))
            out["n_tokens"].append(len(data) // 4)
            out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(said).hexdigest())
            if texts:
                out["ids"].append(np.frombuffer(data, "<u4").astype(np.int32))
                out["decoded"].append(said.decode())
        yield pa.table(out)

    return blocks.with_answers(answers, finish, schema)
