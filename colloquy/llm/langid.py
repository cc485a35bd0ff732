"""Language identification with blended-spectrum string kernels.

The features of a text are which byte n-grams of 1 to 3 bytes (lower case, everything but letters as one space)
it holds, hashed to a fixed number of bits. The kernel of two texts is the number of shared bits over the square
root of the product of their numbers of bits. Nyström landmarks L turn it into features K(x, L) W^(-1/2), and a
one-versus-rest kernel ridge regression is solved on those. Scoring is one matrix product for a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm._shared import spare

BITS = 1 << 14
_NOT_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_BATCH = 128
#: Bytes of a long text that are hashed at once; the presence bits of its parts are joined.
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def presence(text: str, out: np.ndarray) -> None:
    """Set the bits of the text's n-grams in out, a row of BITS zeros."""
    plain = b" " + text.lower().encode("utf-8", "replace").translate(_NOT_LETTERS) + b" "
    for start in range(0, len(plain), _PIECE):
        b = np.frombuffer(plain, np.uint8, min(_PIECE + 2, len(plain) - start), start).astype(np.uint32)
        out[b] = 1
        two = (b[:-1] << 8) | b[1:]
        for gram in (two, (two[:-1] << 8) | b[2:]):
            out[256 + (gram * np.uint32(2654435761) >> np.uint32(16)) % (BITS - 256)] = 1


class Model:
    """languages, the landmarks' bits, and a column of weights for each language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        used = np.flatnonzero(landmarks.any(0)) if len(landmarks) else np.empty(0, np.int64)
        self.languages, self.used = languages, used
        self.landmarks = (landmarks[:, used] / np.sqrt(np.maximum(landmarks.sum(1, keepdims=True, dtype=np.float64), 1))).astype(np.float32)
        self.weights = weights.astype(np.float32)

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(bits.sum(1, dtype=np.float32), 1))[:, None]
        return (bits[:, self.used].astype(np.float32) @ self.landmarks.T) / size

    def predict(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = self.kernel(bits) @ self.weights
        best = f.argmax(1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)


def train(labels: list[str], bits: np.ndarray, n_landmarks: int, ridge: float) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, BITS), np.uint8), np.zeros((0, 0)))
    which = np.array([languages.index(x) for x in labels])
    turn = np.empty(len(which), np.int64)  # landmarks take turns between the languages
    for k in range(len(languages)):
        turn[which == k] = np.arange((which == k).sum())
    marks = np.lexsort((which, turn))[:n_landmarks]
    model = Model(languages, bits[marks], np.zeros((0, 0)))
    k = np.concatenate([model.kernel(bits[i : i + _BATCH]) for i in range(0, len(bits), _BATCH)]).astype(np.float64)
    values, vectors = np.linalg.eigh((k[marks] + k[marks].T) / 2)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    half = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ half
    y = np.where(which[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(which, minlength=len(languages)), 1)  # languages count alike
    w = share[which][:, None] * len(which) / len(languages)
    solved = np.linalg.solve(z.T @ (z * w) + ridge * np.eye(z.shape[1]), z.T @ (y * w))
    model.weights = (half @ solved).astype(np.float32)
    return model


def _sample(docs: DataFrame, train_on: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(key, lang): rows of each language with the least hash, at most per_language of them.

    Hashes are uniform, so counts tell below which hash a language has about twice per_language rows: only those
    are ranked, and no task sees more of a language however frequent it is.
    """
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().collect()  # a row for each language, as the model has a column of weights for each
    if not counts:
        return rows.where("false")
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], float(min(1.0, (2 * per_language + 100) / r["count"])))])
    few = rows.where(F.col("key").cast("double") / 2.0**64 + 0.5 <= below[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy("key")
    return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("key", "lang")


def fit(docs: DataFrame, train_on: Column, *, per_language: int = 1500, n_landmarks: int = 160, ridge: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most per_language rows of each language, those whose hashed ids are least. Rows that `train_on` excludes are not looked at.

    Rows with a null text or language teach nothing, nor do texts without a letter. Rows that share an id are taken
    together. Without rows to learn from every text is `und`. Only the three named columns are read; others may have any name.
    """
    sample = _sample(docs, train_on, per_language, id_col, text_col, lang_col)
    k, l = spare(docs.columns, "key", "lang")
    chosen = F.broadcast(sample.select(F.col("key").alias(k), F.col("lang").alias(l)))
    key = F.xxhash64(F.col(id_col).cast("string"))
    own = docs.where(train_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).join(chosen, (key == F.col(k)) & (F.col(lang_col).cast("string") == F.col(l)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column("text").to_pylist():
                presence(text, row := np.zeros(BITS, np.uint8))
                bits.append(np.packbits(row).tobytes() if has_letter(text) else None)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "lang": batch.column("lang"), "bits": pa.array(bits, pa.binary())})

    rows = own.select(key.alias("key"), F.col(l).alias("lang"), F.col(text_col).alias("text")).mapInArrow(packed, "key long, lang string, bits binary").where("bits IS NOT NULL").orderBy("key", "lang", "bits").toArrow().to_pydict()
    bits = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8)).reshape(-1, BITS)
    return train(rows["lang"], bits, n_landmarks, ridge)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The id, the columns of `keep`, lang_pred and score (0 to 1) for every row.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text when no labelled
    row was there to learn from. A letter is what str.isalpha says. Whole texts count, however long. Repeated rows are
    answered alike. An empty table gives no rows. Columns not named are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = {id_col: F.col(id_col)} | (keep or {})
    (said,) = spare(list(keep), "text")
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias(said))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        matrix = np.zeros((_BATCH, BITS), np.uint8)
        for batch in batches:
            texts, lang, value = batch.column(said), [], []
            for start in range(0, len(texts), _BATCH):
                part = texts.slice(start, _BATCH).to_pylist()
                there = [bool(m.languages) and has_letter(t) for t in part]
                for n, text in enumerate(part):
                    matrix[n] = 0
                    if there[n]:
                        presence(text, matrix[n])
                best, sure = m.predict(matrix[: len(part)]) if any(there) else (np.zeros(len(part), int), np.zeros(len(part)))
                lang += [m.languages[b] if ok else "und" for b, ok in zip(best, there, strict=True)]
                value += [float(s) if ok else 0.0 for s, ok in zip(sure, there, strict=True)]
            kept = [batch.column(n) for n in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(value, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double")
