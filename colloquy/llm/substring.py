"""Substring dedup with automata of repeated phrases.

A window is a run of `width` words of one document. Its anchor is the run of `anchor` words in it with the least hash, so
equal windows have equal anchors, and neighbouring windows mostly share one. Hashes only confirm, corpus-wide, what may
recur: blocks send the hashes of their anchors, once each, and learn which occur in two documents; of the windows with such
an anchor they send the hash with their least and largest document id, and learn the least and largest of the corpus. The block of a
recurring window's first document then gives out the passage itself, as words: the windows about one anchor and the words
that they cover. Blocks that hold later copies ask for passages by anchor. Each block compiles the anchors of
the passages that it was given into Aho-Corasick automata, in shards of a bounded number of phrases, and
streams all of its documents through them: what they report are the only places that are looked at. The windows about
each are compared with the passages word by word, and a word is removed only where they are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import wordblocks
from colloquy.llm._shared import stored
from colloquy.llm.wordblocks import numbers, pack, unpack

ANCHOR = 6
#: Phrases of one automaton.
SHARD = 20000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CODE = np.uint64((1 << 40) - 1)


class _View:
    """A block's words in a row: word hashes, document bounds, valid windows and the anchor of each one."""

    def __init__(self, row: dict, width: int):
        self.width = width
        self.tokens = numbers(row)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = [w for b in row["words"] for w in wordblocks.unpack_words(b)]
        self.has_id = np.array([k is not None for k in row["keys"]], bool)
        self.ids = np.array([k or 0 for k in row["keys"]], np.int64)
        n = len(self.tokens)
        self.hashed = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.h = self.hashed[self.tokens] if n else np.empty(0, np.uint64)
        fits = np.zeros(n, bool)
        for s, e in zip(self.ends - self.sizes, self.ends, strict=True):
            fits[s : max(s, e - width + 1)] = True
        self.windows = np.flatnonzero(fits)
        if not len(self.windows):
            self.anchors = self.runs = np.empty(0, np.uint64)
            return
        runs = np.zeros(n - ANCHOR + 1, np.uint64)
        for j in range(ANCHOR):
            runs *= _A
            runs += self.h[j : n - ANCHOR + 1 + j]
        runs ^= runs >> np.uint64(29)
        runs *= _B
        runs ^= runs >> np.uint64(32)
        span, low, at = width - ANCHOR + 1, runs, 1
        while at < span:  # the least of `span` runs by doubling
            step = min(at, span - at)
            low = np.minimum(low[:-step], low[step:])
            at += step
        self.runs = runs
        self.anchors = low[self.windows]  # of each valid window

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows that start at `at`."""
        return _mixed((self.h[at + j] for j in range(self.width)), len(at))


def _mixed(columns: Iterable[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for x in columns:
        one = one * _B + x
        two = (two + x) * _A
        two ^= two >> np.uint64(31)
    return one, two >> np.uint64(32)


def _bucket(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((codes * _A >> np.uint64(41)) % np.uint64(n_buckets)).astype(np.int64)


def _parts(bucket: np.ndarray, n_buckets: int) -> list[slice]:
    ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
    return [slice(s, e) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def _by_doc(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least and the largest id of each, and which of them each row has."""
    order = np.lexsort((ids, *reversed(keys)))
    keys, ids = tuple(k[order] for k in keys), ids[order]
    new = np.ones(len(ids), bool)
    if len(ids):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    which = np.empty(len(ids), np.int64)
    which[order] = np.cumsum(new) - 1
    return tuple(k[starts] for k in keys), ids[starts], ids[np.r_[starts[1:], len(ids)] - 1] if len(ids) else ids, which


def _seeds(view: _View, n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """The distinct anchors of a block by bucket, and whether each is in documents of different ids."""
    doc = view.doc_of(view.windows)
    use = view.has_id[doc]
    use[1:] &= (view.anchors[1:] != view.anchors[:-1]) | (doc[1:] != doc[:-1])  # neighbours mostly share one
    (anchors,), least, most, _ = _by_doc((view.anchors[use],), view.ids[doc[use]])
    bucket = _bucket(anchors, n_buckets)
    order = np.lexsort((anchors & _CODE, bucket))
    return anchors[order], (least != most)[order], _parts(bucket, n_buckets)


class _Candidates:
    """The distinct windows with a recurring anchor, by bucket: two hashes, least and largest id in the block; and the places of each."""

    def __init__(self, view: _View, recurring: np.ndarray, n_buckets: int):
        place = np.minimum(np.searchsorted(recurring, view.anchors), max(len(recurring) - 1, 0))
        doc = view.doc_of(view.windows)
        use = (recurring[place] == view.anchors) & view.has_id[doc] if len(recurring) else np.zeros(len(doc), bool)
        self.places, self.anchors, self.ids = view.windows[use], view.anchors[use], view.ids[doc[use]]
        one, two = view.hashes(self.places)
        (one, two), least, most, which = _by_doc((one, two), self.ids)
        bucket = _bucket(one, n_buckets)
        order = np.lexsort((two, one, bucket))
        self.one, self.two, self.least, self.most, self.parts = one[order], two[order], least[order], most[order], _parts(bucket, n_buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.which = rank[which]


def _recurring(anchors: np.ndarray, parts: list[slice], bits: list[bytes]) -> np.ndarray:
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=p.stop - p.start).astype(bool) for b, p in zip(bits, parts, strict=True)]
    return np.sort(anchors[np.concatenate(flags)]) if flags else anchors[:0]


_SEPARATOR = 255


def _stream(view: _View, phrases: np.ndarray) -> np.ndarray:
    """Places of the words where one of the phrases, rows of ANCHOR word numbers, starts.

    A word is three or four signs, each place with signs of its own, so a phrase can only match whole words and every
    state has few ways on; a separator stands between documents. Shards hold neighbours in order of their signs, so
    that most of a text leaves an automaton at its first state.
    """
    n_signs = 3 if len(view.words) <= 85**3 else 4
    base = 255 // n_signs

    def signs(words: np.ndarray) -> np.ndarray:
        left, own = words.astype(np.uint32), np.empty((len(words), n_signs), np.uint8)
        for j in range(n_signs):
            own[:, j] = base * j + left % base
            left = left // base
        return own

    digits = np.empty((len(view.tokens) + len(view.sizes), n_signs), np.uint8)
    inside = np.ones(len(digits), bool)
    inside[view.ends + np.arange(len(view.sizes))] = False
    digits[~inside] = _SEPARATOR
    digits[inside] = signs(view.tokens)
    text = digits.tobytes().decode("latin-1")
    place = np.cumsum(inside) - 1  # a sign's place among the words
    plain = signs(phrases.reshape(-1)).tobytes().decode("latin-1")
    own = sorted({plain[i : i + n_signs * ANCHOR] for i in range(0, len(plain), n_signs * ANCHOR)})
    found: list[np.ndarray] = []
    for s in range(0, len(own), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in own[s : s + SHARD]:
            automaton.add_word(phrase)
        automaton.make_automaton()
        ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
        found.append(place[(ends + 1) // n_signs - ANCHOR])
    return np.sort(np.concatenate([*found, np.empty(0, np.int64)]))


def _passages(view: _View, have: _Candidates, own: np.ndarray) -> dict[tuple[int, bytes, int, int], None]:
    """(anchor, words, the anchor's place among them, id) of the windows `own` (of have.places): neighbours with one anchor together."""
    starts, codes, ids = have.places[own], have.anchors[own], have.ids[own]
    at = np.zeros(len(starts), np.int64)
    for j in reversed(range(view.width - ANCHOR + 1)):
        at[view.runs[starts + j] == codes] = j
    at += starts
    first = np.ones(len(starts), bool)
    first[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(first)
    last = np.r_[begin[1:], len(starts)] - 1
    words, tokens = view.words, view.tokens
    out: dict[tuple[int, bytes, int, int], None] = {}
    for code, s, e, place, i in zip(codes[begin].tolist(), starts[begin].tolist(), (starts[last] + view.width).tolist(), (at - starts)[begin].tolist(), ids[begin].tolist(), strict=True) if len(begin) else ():
        out[code, b" ".join([words[t] for t in tokens[s:e].tolist()]), place, i] = None
    return out


def _pack_passages(found: list[tuple[bytes, int, int]]) -> dict[str, bytes]:
    return {"said": zstandard.ZstdCompressor(level=1).compress(b"\n".join(w for w, _, _ in found)), "at": pack(np.array([p for _, p, _ in found], np.uint32)), "ids": pack(np.array([i for _, _, i in found], np.int64))}


def _unpack_passages(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    at = unpack(row["at"], np.uint32)
    return zstandard.ZstdDecompressor().decompress(row["said"]).split(b"\n") if len(at) else [], at, unpack(row["ids"], np.int64)


class _Known:
    """The passages that a block was given, as numbers of its own words: their windows in order of hash, and their anchors."""

    def __init__(self, view: _View, got: dict[str, list]):
        number = {w: n for n, w in enumerate(view.words)}.get
        words, sizes, places, least = [], [], [], []
        for said, at, of in zip(got["said"], got["at"], got["ids"], strict=True):
            texts, place, i = _unpack_passages({"said": said, "at": at, "ids": of})
            sizes += [t.count(b" ") + 1 for t in texts]
            own = b" ".join(texts).split()
            words.append(np.fromiter((number(w, -1) for w in own), np.int64, len(own)))
            places.append(place.astype(np.int64))
            least.append(i)
        flat, size, nothing = np.concatenate([*words, np.empty(0, np.int64)]), np.array(sizes, np.int64), np.empty(0, np.int64)
        begin = np.cumsum(size) - size
        n = size - view.width + 1  # windows of each passage
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows = flat[at[:, None] + np.arange(view.width)]
        here = (rows >= 0).all(1)  # a window with a word that the block has not is not in it
        self.windows, self.ids = rows[here], np.repeat(np.concatenate([*least, nothing]), n)[here]
        phrases = flat[(begin + np.concatenate([*places, nothing]))[:, None] + np.arange(ANCHOR)]
        self.anchors = phrases[(phrases >= 0).all(1)]
        self.one, _ = _mixed((view.hashed[self.windows[:, j]] for j in range(view.width)), len(self.windows))
        order = np.argsort(self.one, kind="stable")
        self.one, self.windows, self.ids = self.one[order], self.windows[order], self.ids[order]

    def later(self, view: _View, at: np.ndarray) -> np.ndarray:
        """Whether the window that starts there equals, word by word, one of a document with a smaller id."""
        hit = np.zeros(len(at), bool)
        if not len(self.one) or not len(at):
            return hit
        doc = view.doc_of(at)
        one, _ = view.hashes(at)
        place, todo = np.searchsorted(self.one, one), np.arange(len(at))
        while len(todo):
            todo = todo[place[todo] < len(self.one)]
            todo = todo[self.one[place[todo]] == one[todo]]
            same = view.has_id[doc[todo]] & (self.ids[place[todo]] < view.ids[doc[todo]])
            for j in range(view.width):
                same &= view.tokens[at[todo] + j] == self.windows[place[todo], j]
            hit[todo[same]] = True
            todo = todo[~same]
            place[todo] += 1
        return hit


def remove_repeats(docs: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with texts also the kept words joined by one space.

    A word goes when a window of `width` words covers it whose words, as they stand in the input, also start in a document
    with a smaller id. Words lie between ASCII white space. A null or empty text has no words. Rows with one id are no
    earlier than each other, and a row without an id neither loses words nor makes others lose any. Ids must be of an
    integer type. A document shorter than a window keeps its words. Whole texts are read. An empty table gives no rows.
    Other columns are not read and may have any name.
    """
    if width < ANCHOR:
        raise ValueError(f"width must be at least {ANCHOR}")
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be of an integer type, not {kind}: its order says which document is the earlier")
    blocks = wordblocks.build(docs, F.col(id_col).cast("long"), F.col(text_col), F.lit(False), label="substring", block_bytes=12_000_000)
    n_buckets = blocks.n_buckets

    def send_seeds(row: dict) -> Iterator[pa.RecordBatch]:
        anchors, several, parts = _seeds(_View(row, width), n_buckets)
        rows = [{"block": row["block"], "bucket": n, "a": pack(np.diff(anchors[p] & _CODE, prepend=np.uint64(0))), "b": np.packbits(several[p]).tobytes()} for n, p in enumerate(parts)]
        yield pa.RecordBatch.from_pylist(rows, schema=_table("a", "b"))

    def meet_seeds(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        codes = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        several = [np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(c)) for r, c in zip(rows, codes, strict=True)]
        _, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        twice = np.bincount(inverse) + np.bincount(inverse, weights=np.concatenate(several)) > 1
        ends = np.cumsum([len(c) for c in codes])[:-1]
        return pa.Table.from_pylist([{"block": r["block"], "bucket": r["bucket"], "bits": np.packbits(f).tobytes()} for r, f in zip(rows, np.split(twice[inverse], ends), strict=True)], schema=_table("bits"))

    seeds = stored(blocks.each(send_seeds, _ddl("a", "b"), columns=("words",)).groupBy("bucket").applyInArrow(meet_seeds, _ddl("bits")), "substring-seeds")

    def candidates(view: _View, got: dict[str, list]) -> _Candidates:
        anchors, _, parts = _seeds(view, n_buckets)
        return _Candidates(view, _recurring(anchors, parts, got["bits"]), n_buckets)

    def send_windows(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        have = candidates(_View(row, width), got)
        rows = [{"block": row["block"], "bucket": n, "a": pack(np.diff(have.one[p], prepend=np.uint64(0))), "b": pack(have.two[p].astype(np.uint32)), "c": pack(have.least[p]), "d": pack(have.most[p] - have.least[p])} for n, p in enumerate(have.parts)]
        yield pa.Table.from_pylist(rows, schema=_table("a", "b", "c", "d"))

    def meet_windows(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        one = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        low = np.concatenate([unpack(r["c"], np.int64) for r in rows])
        high = low + np.concatenate([unpack(r["d"], np.int64) for r in rows])
        keys = np.concatenate(one), np.concatenate([unpack(r["b"], np.uint32) for r in rows])
        _, least, _, which = _by_doc(keys, low)
        _, _, most, _ = _by_doc(keys, high)
        ends = np.cumsum([len(c) for c in one])[:-1]
        parts = zip(rows, np.split(least[which], ends), np.split((most - least)[which], ends), strict=True)
        return pa.Table.from_pylist([{"block": r["block"], "bucket": r["bucket"], "least": pack(x), "more": pack(y)} for r, x, y in parts], schema=_table("least", "more"))

    asked = blocks.with_answers(seeds, send_windows, _ddl("a", "b", "c", "d"), columns=("words",))
    confirmed = asked.groupBy("bucket").applyInArrow(meet_windows, _ddl("least", "more"))

    def send_passages(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        view = _View(row, width)
        have = candidates(view, got)
        least = np.concatenate([*(unpack(b, np.int64) for b in got["least"]), np.empty(0, np.int64)])
        more = np.concatenate([*(unpack(b, np.int64) for b in got["more"]), np.empty(0, np.int64)])
        first = least[have.which]
        wanted = np.unique(have.anchors[first < have.ids])
        offers = list(_passages(view, have, np.flatnonzero((first == have.ids) & (more[have.which] != 0))))
        offers.sort(key=lambda o: o[0])
        codes = np.array([o[0] for o in offers], np.uint64)
        bucket, asks = _bucket(codes, n_buckets), _bucket(wanted, n_buckets)
        rows = []
        for n in range(n_buckets):
            own = np.flatnonzero(bucket == n)
            rows.append({"block": row["block"], "bucket": n, "asks": pack(np.diff(wanted[asks == n], prepend=np.uint64(0))), "codes": pack(np.diff(codes[own], prepend=np.uint64(0))), **_pack_passages([offers[i][1:] for i in own.tolist()])})
        yield pa.Table.from_pylist(rows, schema=_table("asks", "codes", "said", "at", "ids"))

    def meet_passages(group: pa.Table) -> pa.Table:
        codes, passages = [], []
        for part in group.select(["codes", "said", "at", "ids"]).to_pylist():
            codes.append(np.cumsum(unpack(part["codes"], np.uint64), dtype=np.uint64))
            passages += zip(*(x if isinstance(x, list) else x.tolist() for x in _unpack_passages(part)), strict=True)
        code = np.concatenate([*codes, np.empty(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        code = code[order]
        out = []
        for r in group.select(["block", "bucket", "asks"]).to_pylist():
            asks = np.cumsum(unpack(r["asks"], np.uint64), dtype=np.uint64)
            low, high = np.searchsorted(code, asks), np.searchsorted(code, asks, "right")
            at = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(int((high - low).sum()))
            out.append({"block": r["block"], "bucket": r["bucket"], **_pack_passages([passages[i] for i in order[at].tolist()])})
        return pa.Table.from_pylist(out, schema=_table("said", "at", "ids"))

    offered = blocks.with_answers(seeds.join(confirmed, ["block", "bucket"]), send_passages, _ddl("asks", "codes", "said", "at", "ids"), columns=("words",))
    given = offered.groupBy("bucket").applyInArrow(meet_passages, _ddl("said", "at", "ids"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def finish(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        view = _View(row, width)
        known = _Known(view, got)
        located = _stream(view, known.anchors) if len(known.anchors) else np.empty(0, np.int64)
        starts = np.unique(located[:, None] - np.arange(width - ANCHOR + 1)) if len(located) else located
        valid = np.zeros(len(view.tokens) + 1, bool)
        valid[view.windows] = True
        starts = starts[starts >= 0]
        starts = starts[valid[starts]]
        starts = starts[known.later(view, starts)]
        cover = np.zeros(len(view.tokens) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + width, -1)
        keep = np.cumsum(cover[:-1]) == 0
        out: dict[str, list] = {"doc_id": row["keys"], "n_words": view.sizes, "n_removed": [], "kept_sha256": []} | ({"kept": []} if texts else {})
        for s, e in zip(view.ends - view.sizes, view.ends, strict=True):
            kept = view.tokens[s:e][keep[s:e]].tolist()
            said = b" ".join(map(view.words.__getitem__, kept))
            out["n_removed"].append(int(e - s) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(said).hexdigest())
            if texts:
                out["kept"].append(said.decode("utf-8", "replace"))
        yield pa.table(out)

    return blocks.with_answers(given, finish, schema, columns=("words",))


def _table(*blobs: str) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((b, pa.binary()) for b in blobs)])


def _ddl(*blobs: str) -> str:
    return ", ".join(["block long", "bucket int", *(f"{b} binary" for b in blobs)])
