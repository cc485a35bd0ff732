"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs say that a document labelled 1 is better than one labelled 0. The chance that a is preferred to b
is the logistic function of w . (x_a - x_b), where x are features of the whole text: hashed words and character
trigrams, and numbers of its form; w minimises the logistic loss over pairs. A quantile of the training scores is the threshold, and scores are moved so that it lies at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the threshold lies among the scores.
CUT = 0.7
_UPPER, _LOWER, _DIGIT = (np.array([chr(c).isascii() and f(chr(c)) for c in range(256)]) for f in (str.isupper, str.islower, str.isdigit))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = np.isin(np.arange(256), list(_MARKS))


#: Buckets for words and for character trigrams; bytes that are hashed at once.
WORDS = TRIGRAMS = 192
_PIECE = 1 << 20
#: Texts that are measured at once.
_ROWS = 512
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[_DIGIT] = ord("0")
_FOLD[_SPACE] = 32
_POWERS = np.array([pow(0x9E3779B1, n, 1 << 32) for n in range(64)], np.uint32)


def _buckets(hashed: np.ndarray, n: int) -> np.ndarray:
    mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(2654435761)
    return np.bincount((mixed >> np.uint32(16)) % np.uint32(n), minlength=n)


def grams(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed words and of hashed trigrams, white space and digits alike; a long text is hashed in pieces."""
    words, runs = np.zeros(WORDS), np.zeros(TRIGRAMS)
    for s in range(0, len(raw), _PIECE):
        b = _FOLD[np.frombuffer(raw, np.uint8, min(_PIECE, len(raw) - s), s)]
        if len(b) > 2:
            runs += _buckets(b[:-2] * np.uint32(0x85EBCA6B) + b[1:-1] * np.uint32(0xC2B2AE35) + b[2:], TRIGRAMS)
        inside = b != 32
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if len(starts):
            at = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)])) if starts[0] == 0 else np.arange(len(b)) - np.r_[np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.r_[starts, len(b)]))]
            words += _buckets(np.add.reduceat(np.where(inside, b * _POWERS[at & 63], 0).astype(np.uint32), starts), WORDS)
    return np.sqrt(np.r_[words / max(words.sum(), 1), runs / max(runs.sum(), 1)])


def features(text: str | None) -> list[float]:
    """Numbers that describe a text's form: case, marks, repetition, word and line lengths."""
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    n, nw, nl = max(len(raw), 1), max(len(words), 1), len(lines)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    upper, letters = byte[_UPPER].sum(), byte[_UPPER].sum() + byte[_LOWER].sum() + byte[128:].sum()
    marks = byte[_MARK].sum()
    distinct = len(set(words))
    again = sum(a == b for a, b in pairwise(words))
    single = sum(len(w) == 1 for w in words)
    usual = byte[list(b".,;:'\"-()?")].sum()
    long_words = sum(len(w) > 15 for w in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(nl), min((n - byte[_SPACE].sum()) / nw, 40.0),
        upper / max(letters, 1), marks / n, (marks - usual) / n, min((marks - usual) / nw, 5.0), usual / n,
        byte[_DIGIT].sum() / n, byte[10] / n, byte[128:].sum() / n, letters / n,
        min(byte[list(b"!")].sum() / nw, 5.0), min(byte[list(b"|")].sum() / nw, 5.0), min(byte[list(b"#$%&*")].sum() / nw, 5.0), min(byte[list(b".")].sum() / nw, 5.0), min(byte[list(b",")].sum() / nw, 5.0),
        distinct / nw, np.log1p(nw / max(distinct, 1)), again / nw, single / nw, long_words / nw,
        len(set(lines)) / nl, min(nw / nl, 200.0) / 200, float(not words), float(len(words) < 5), float(upper / max(letters, 1) > 0.3),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([np.r_[features(t), grams((t or "").encode("utf-8", "replace"))] for t in texts], np.float32)


_D = len(features("")) + WORDS + TRIGRAMS


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.w, self.cut, self.slope = mean, scale, w, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) * self.slope
        out = 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -500, 500)))
        return np.where(z >= 0, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


def train(x: np.ndarray, y: np.ndarray, n_pairs: int, decay: float = 3e-3, steps: int = 25) -> Model:
    """Without rows of both labels there is no pair: every score is the threshold's, and nothing is rejected."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = _D
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    draw = np.random.default_rng(0)
    better, worse = draw.choice(good, n_pairs), draw.choice(bad, n_pairs)
    w = np.zeros(d)
    for _ in range(steps):  # Newton's method on the mean logistic loss, some pairs at a time
        grad, curve = decay * w, decay * np.eye(d)
        for s in range(0, n_pairs, 4096):
            diff = z[better[s : s + 4096]] - z[worse[s : s + 4096]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
            grad -= diff.T @ (1 - p) / n_pairs
            curve += (diff * (p * (1 - p)).astype(np.float32)[:, None]).T @ diff / n_pairs
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, float(np.linalg.norm(step)) / 5)
        if float(np.abs(step).max()) < 1e-6:
            break
    raw = z @ w
    # the quantile of the training scores that parts the labels best, both labels counting alike
    levels = np.linspace(0, 1, 2001)
    cuts = np.quantile(raw, levels)
    below = lambda s: np.searchsorted(np.sort(s), cuts, "left") / len(s)
    gain = below(raw[bad]) - below(raw[good])
    at = np.flatnonzero(gain >= gain.max() - 1e-12)
    cut = float(cuts[at[0]] + cuts[at[-1]]) / 2
    return Model(mean, scale, w, cut, 1 / max(float(raw.std()), 1e-9))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, *, max_train: int = 20000, n_pairs: int = 40000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most max_train labelled rows, those whose hashed ids are least.

    train_on is a condition on the id column of labels; rows that it excludes are not looked at. Rows with a null
    id or label, or a label that is neither 0 nor 1, are left out. Without rows of both labels every score is the
    threshold's. Of docs and labels only the named columns are read; others may have any name.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    own = own if train_on is None else own.where(train_on)
    chosen = own.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct().orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), _ROWS):
                part = batch.slice(s, _ROWS)
                x = _matrix(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("_y"), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(measure, "id string, y int, x binary").orderBy("id", "y", "x").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, _D)
    return train(x, got["y"].to_numpy(), n_pairs)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every row; 0.7 and more is accepted.

    Scores depend on the whole text only. A null text scores as an empty one. Repeated rows score alike. An empty table
    stays empty. A column of docs with the given name is replaced, others may have any name.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            parts = (batch.column(text_col).slice(s, _ROWS).to_pylist() for s in range(0, len(batch), _ROWS))
            own = np.concatenate([*(sent.value.scores(_matrix(p)) for p in parts), np.empty(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(own, pa.float64())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(measure, f"{schema}, `{name}` double")
