"""Benchmark decontamination with a BM25 index of the test items.

The index holds each term's impact on each item, with counts and mean length of the whole benchmark. Every passage of every
document is a query that retrieves all items above threshold: an item's threshold is the least score that a passage can
have which verification would confirm, so retrieval loses nothing. The search is block-max WAND for many passages at
once. A passage's lists are ordered by their largest impact; the pivot is the first at which the running sum of these
reaches the least threshold, so lists before it are not opened, as no item in them alone can reach it. Items lie in
blocks with the largest impact of each term in the block; a block that no list from the pivot on names is skipped, and so
is one whose bound, the sum of its block maxima and of what the unopened lists can add, stays below the block's
least threshold. Only in the blocks left are the scores worked out, by looking the block up in each list.

Retrieved items are verified word by word, in windows of the passage whose length follows the item: an item is held
where a window has `similarity` of the word shingles of its question and its answer together, or of its question alone
if that is long enough.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm._shared import spare, stored

WIDTH, SIMILARITY = 5, 0.8
#: Words that a question needs to count without its answer; words of the shortest window.
QUESTION, WINDOW = 10, 32
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_BLOCK = 8


def terms(text: str | None) -> list[bytes]:
    """Words in lower case, ASCII marks and white space between them."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def shingles(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    """Runs of width words; all words where there are fewer."""
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer, without lines the last sentence, without sentences the second half of the words."""
    for cut in ("\n", ". "):
        head, _, tail = text.strip().rpartition(cut)
        if terms(head) and terms(tail):
            return head, tail
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def window_size(n_words: int) -> int:
    """Words of a document among which an item of n_words words is looked for: words may have been put in between."""
    return max(2 * n_words, WINDOW)


def _runs(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


class _Part:
    """A text's shingles: of width words, or of all where it has fewer."""

    def __init__(self, words: list[bytes], width: int):
        self.width, self.n_words, self.set = min(width, len(words)), len(words), shingles(words, width)

    def bound(self, held: set[bytes], width: int) -> float:
        """The share of the shingles in a whole passage whose runs of width words are held; 1 for shorter shingles."""
        return len(self.set & held) / len(self.set) if self.width == width and self.set else 1.0

    def best(self, words: list[bytes], grams: dict[int, list[bytes]], span: int) -> tuple[float, int]:
        """The largest share of the shingles in a window of span words, and the first place of such a window."""
        if not self.set:
            return 1.0, 0
        w, own = self.width, self.set
        if w not in grams:
            grams[w] = _runs(words, w)
        hits = [(i, g) for i, g in enumerate(grams[w]) if g in own]
        have: Counter[bytes] = Counter()
        most, at, left = 0, 0, 0
        for i, g in hits:
            have[g] += 1
            while i + w - hits[left][0] > span:  # the window ends with shingle i
                old = hits[left][1]
                have[old] -= 1
                if not have[old]:
                    del have[old]
                left += 1
            if len(have) > most:
                most, at = len(have), max(0, hits[left][0])
        return most / len(own), at

    def least(self, impacts: dict[bytes, float], words: list[bytes], similarity: float) -> float:
        """The least sum of impacts of the terms of a window that has the share `similarity` of the shingles."""
        times = Counter(words)
        full, room = sum(impacts[t] for t in times), len(self.set) - int(np.ceil(similarity * len(self.set) - 1e-9))
        if not room:
            lost = 0.0
        elif len(self.set) < self.n_words - self.width + 1:  # a shingle stands twice: each one lacking costs its own terms
            lost = sum(sorted((impacts[t] for t in times), reverse=True)[: room * self.width])
        else:
            # the most that words can weigh which may be lacking: a shingle is lacking where a word in it is. most[d, k]: the
            # weight so far with k shingles lacking and the last such word d words back; a repeated term weighs its share
            most = np.full((self.width + 1, room + 1), -np.inf)
            most[self.width, 0] = 0.0
            for n, t in enumerate(words):
                new = np.full_like(most, -np.inf)
                new[0] = most.max(0) + impacts[t] / times[t]
                new[1:] = most[:-1]
                new[self.width] = np.maximum(new[self.width], most[self.width])
                if n >= self.width - 1:  # the shingle that ends here
                    new[: self.width, 1:] = new[: self.width, :-1]
                    new[: self.width, 0] = -np.inf
                most = new
            lost = float(most.max())
        return max(full - lost - 1e-9, 0.0)


class Index:
    """BM25 impacts of a bounded number of items. known: items, mean words and items with each term, of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], known: tuple[int, float, dict[bytes, int]], step: int, width: int = WIDTH, similarity: float = SIMILARITY, question: int = QUESTION, k1: float = 1.2, b: float = 0.75):
        n, mean, frequency = known
        self.width, self.similarity, self.question, self.step = width, similarity, question, step
        own = [(i, terms(t), t) for i, t in items]
        own = [x for x in own if x[1]]
        self.ids = [i for i, _, _ in own]
        self.span = [window_size(len(w)) for _, w, _ in own]
        self.term = {t: k for k, t in enumerate(sorted({t for _, w, _ in own for t in w}))}
        idf = {t: float(np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))) for t in self.term}
        self.impacts: list[dict[bytes, float]] = []
        self.parts: list[tuple[_Part, _Part, _Part]] = []
        self.least = np.zeros(len(own))
        for k, (_, words, text) in enumerate(own):
            impacts = {t: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean)) for t, f in Counter(words).items()}
            asked, said = (terms(p) for p in question_and_answer(text))
            parts = (_Part(words, width), _Part(asked, width), _Part(said, width))
            self.least[k] = parts[0].least(impacts, words, similarity)
            if len(asked) >= question:
                self.least[k] = min(self.least[k], parts[1].least(impacts, asked, similarity))
            self.impacts.append(impacts)
            self.parts.append(parts)
        self.n_blocks = max(1, -(-len(own) // _BLOCK))
        self.block_least = np.array([self.least[i : i + _BLOCK].min() for i in range(0, len(own), _BLOCK)])
        # postings by term and block, each with its items' impacts
        rows = sorted((self.term[t] * self.n_blocks + k // _BLOCK, k % _BLOCK, x) for k, impacts in enumerate(self.impacts) for t, x in impacts.items())
        key = np.array([r[0] for r in rows], np.int64)
        self.post_key, place = np.unique(key, return_inverse=True)
        self.post_items = np.zeros((len(self.post_key), _BLOCK))
        self.post_items[place, [r[1] for r in rows]] = [r[2] for r in rows]
        self.post_max = self.post_items.max(1, initial=0)
        # a table of all terms and blocks finds postings faster, where it is small
        size = len(self.term) * self.n_blocks
        self.table = np.full(size if size <= 1 << 22 else 0, -1, np.int32)
        if len(self.table):
            self.table[self.post_key] = np.arange(len(self.post_key))
        of_term = self.post_key // self.n_blocks
        self.starts = np.searchsorted(of_term, np.arange(len(self.term)))
        self.sizes = np.bincount(of_term, minlength=len(self.term))
        self.list_max = np.maximum.reduceat(self.post_max, self.starts) if len(rows) else np.empty(0)

    def retrieved(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Rows (passage, item) whose score reaches the item's threshold; (passage, term) are distinct pairs of n passages."""
        top = self.list_max[term]
        order = np.lexsort((top, passage))
        passage, term, top = passage[order], term[order], top[order]
        sizes = np.bincount(passage, minlength=n)
        begin = np.cumsum(sizes) - sizes
        running = np.cumsum(top)
        running -= (running - top)[begin[passage]] if len(top) else 0
        opened = running + 1e-9 >= self.block_least.min()  # from the pivot on
        unopened = np.bincount(passage[~opened], weights=top[~opened], minlength=n)
        p, t = passage[opened], term[opened]
        size = self.sizes[t]
        at = np.repeat(self.starts[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        blocks, inverse = np.unique(np.repeat(p, size) * self.n_blocks + self.post_key[at] % self.n_blocks, return_inverse=True)
        bound = np.bincount(inverse, weights=self.post_max[at], minlength=len(blocks)) + unopened[blocks // self.n_blocks]
        blocks = blocks[bound + 1e-9 >= self.block_least[blocks % self.n_blocks]]
        out = []
        for s in range(0, len(blocks), 4096):
            part = blocks[s : s + 4096]
            where, which = part // self.n_blocks, part % self.n_blocks
            size = sizes[where]
            slot = np.repeat(np.arange(len(part)), size)
            at = np.repeat(begin[where] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            key = term[at] * self.n_blocks + which[slot]
            found = self._find(key)
            hit = found >= 0
            slot, found = slot[hit], found[hit]
            # with all lists looked up the bound is that of the block itself
            full = np.bincount(slot, weights=self.post_max[found], minlength=len(part)) + 1e-9 >= self.block_least[which]
            rank, keep = np.cumsum(full) - 1, full[slot]
            slot, found, where, which, part = rank[slot[keep]], found[keep], where[full], which[full], part[full]
            score = np.stack([np.bincount(slot, weights=self.post_items[found, j], minlength=len(part)) for j in range(_BLOCK)], 1)
            item = which[:, None] * _BLOCK + np.arange(_BLOCK)
            ok = item < len(self.ids)
            ok[ok] = score[ok] + 1e-9 >= self.least[item[ok]]
            out.append(np.stack([np.broadcast_to(where[:, None], item.shape)[ok], item[ok]], 1))
        return np.concatenate([*out, np.empty((0, 2), np.int64)])

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The posting of each term and block, -1 where there is none."""
        if len(self.table):
            return self.table[key]
        at = np.minimum(np.searchsorted(self.post_key, key), len(self.post_key) - 1)
        return np.where(self.post_key[at] == key, at, -1)

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that it holds, each with its best window."""
        found: list[dict[int, dict]] = [{} for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        step, get = self.step, self.term.get
        batch: list[tuple[int, int, list[bytes]]] = []
        pairs: list[np.ndarray] = []
        n = 0

        def flush() -> None:
            if not pairs:
                return
            keys = np.concatenate(pairs)
            firsts = [f for _, f, _ in batch]
            now, held, grams, passage = -1, set(), {}, []
            for p, item in self.retrieved(keys // len(self.term), keys % len(self.term), n).tolist():
                doc, first, words = batch[bisect_right(firsts, p) - 1]
                start = (p - first) * step
                if p != now:
                    now, passage = p, words[start : start + 2 * step]
                    grams = {self.width: _runs(passage, self.width)}
                    held = set(grams[self.width])
                self._verify(passage, grams, held, item, found[doc])

        for doc, text in enumerate(texts):
            words = terms(text)
            ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                continue
            # passages of two steps, one step apart: every window of a step or less lies in one
            chunk, own = at // step, ids[at]
            first = n
            count = max(1, -(-len(words) // step) - 1)
            passage = np.concatenate([chunk, chunk - 1])
            ok = (passage >= 0) & (passage < count)
            pairs.append(np.unique((passage[ok] + first) * len(self.term) + np.concatenate([own, own])[ok]))
            batch.append((doc, first, words))
            n += count
            if n > 2048:
                flush()
                batch, pairs, n = [], [], 0
        flush()
        return [sorted(f.values(), key=lambda m: (m["item_id"], m["overlap"], m["score"])) for f in found]

    def _verify(self, words: list[bytes], grams: dict[int, list[bytes]], held: set[bytes], item: int, found: dict[int, dict]) -> None:
        whole, asked, said = self.parts[item]
        if max(whole.bound(held, self.width), asked.bound(held, self.width) if asked.n_words >= self.question else 0.0) < self.similarity - 1e-9:
            return
        span = self.span[item]
        share, at = whole.best(words, grams, span)
        of_question, of_answer = asked.best(words, grams, span)[0], said.best(words, grams, span)[0]
        by_item = share >= self.similarity - 1e-9
        if not by_item and (asked.n_words < self.question or of_question < self.similarity - 1e-9):
            return
        have = set(words[at : at + span])
        score = sum(x for t, x in self.impacts[item].items() if t in have)
        match = {"item_id": self.ids[item], "score": score, "overlap": share, "question_overlap": of_question, "answer_overlap": of_answer, "whole": by_item}
        old = found.get(item)
        if old is None or (share, of_question, score) > (old["overlap"], old["question_overlap"], old["score"]):
            found[item] = match | {"whole": by_item or bool(old and old["whole"])}


LEAKS = "array<struct<item_id: bigint, score: double, overlap: double, question_overlap: double, answer_overlap: double, whole: boolean>>"
_LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap")), ("whole", pa.bool_())]))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [terms(t) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pass"), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], ["pass", "n", "terms"])


def indexes(benchmark: DataFrame, item_col: str, text_col: str, width: int, similarity: float, items_per_pass: int) -> Iterator[Index]:
    """An index for each part of the benchmark, of about items_per_pass items, with statistics of all of it."""
    own = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    passes = max(1, -(-own.count() // items_per_pass))
    own = own.withColumn("pass", F.pmod(F.xxhash64("i"), F.lit(passes)))
    described = stored(own.mapInArrow(_described, "pass long, n long, terms array<binary>").where("n > 0"), "decontam-terms")
    n, total, longest = described.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    frequency = described.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    if passes > 1:
        frequency = stored(frequency, "decontam-frequency")
    for k in range(passes):
        items = own.where(F.col("pass") == k).orderBy("i", "t").select("i", "t").collect()
        mine = described.where(F.col("pass") == k).select(F.explode("terms").alias("t")).distinct()
        counts = {bytes(r["t"]): r["f"] for r in frequency.join(mine, "t", "left_semi").collect()}
        yield Index([(r["i"], r["t"]) for r in items], (n, total / max(n, 1), counts), window_size(longest), width, similarity)


def with_leaks(docs: DataFrame, benchmark: DataFrame, *, name: str = "leaks", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, items_per_pass: int = 20000) -> DataFrame:
    """docs and a column of the items that each text holds; `whole` tells those held with question and answer from those by their question.

    An item is held where some window of the text, of twice the item's words and 32 at least, has the share `similarity` of
    the item's word shingles (question and answer together), or of its question's if that has 10 words or more. Item ids
    are cast to long. The benchmark is read in parts of about items_per_pass items, whose built indexes are broadcast one by
    one, so no more than these are on an executor; each part searches all documents, and answers do not depend on their number.
    Items without words and items with a null id never match; a null or empty text holds nothing. Repeated items are found
    each; repeated rows are answered alike. Whole texts are searched. A column of docs with the given name is replaced,
    others may have any name. Empty tables are searched, or hold nothing, like others.
    """
    spark = docs.sparkSession
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    out, columns = plain, []
    for index in indexes(benchmark, item_col, item_text_col, width, similarity, items_per_pass):
        (column,) = spare([*out.columns, *columns], "leaks")
        columns.append(column)
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast(index), text_col, column), ", ".join([*kept, f"`{column}` {LEAKS}"]))
    found = F.array_sort(F.concat(*[F.col(c) for c in columns]))
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], found.alias(name))


def _searcher(sent, text_col: str, column: str):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            found = []
            for s in range(0, len(batch), 512):
                found += index.search(batch.column(text_col).slice(s, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _LEAK_TYPE)], [*batch.schema.names, column])

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, overlap, question_overlap, answer_overlap, whole."""
    rows = with_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return rows.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
