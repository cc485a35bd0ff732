"""Class-based bigram language model with exchange clustering (Brown classes).

P(w | previous) = P(class of w | class of previous) * P(w | class of w). The clustering starts from the most frequent
training words: exchange on the table of their bigrams, each word in turn moving to the class that raises the likelihood
of the training bigrams most; the classes are clustered the same way into groups, and every other word joins the tail
class whose neighbour groups explain its own neighbours best. From there all training words, frequent or rare, are
exchanged in repeated sweeps over the whole corpus: blocks count each word's neighbours by class, with both words
rare or not, and every word moves to the class, of all, that gains most against the class bigrams of the corpus less its
own. Words of one sweep move at once, from the third sweep on half of them, so each new state is counted anew; sweeps end
when the likelihood gains little, and a state that lost is dropped for the one before.
Emissions are add-half over the class's words, transitions are smoothed towards the class unigram. The unknown word is a
class of its own; words seen once lend it half their transitions. The model sums to one over the training words, the
unknown word and the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import wordblocks
from colloquy.llm._shared import remove, scratch_path, stored
from colloquy.llm.wordblocks import numbers, pack, unpack

ADD = 0.5


_BINS = 200


def _bin(counts: np.ndarray) -> np.ndarray:
    """Four bins an octave: bin b holds the counts from 2^(b/4) up to the next bin's first."""
    edges = np.ceil(2 ** (np.arange(_BINS) / 4))
    return np.minimum(np.searchsorted(edges, counts, "right") - 1, _BINS - 1)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(table: np.ndarray, t: np.ndarray, f: np.ndarray, loop: float) -> np.ndarray:
    """What each class gains in sum(n log n) from a word that table is without: t to each class, f after each, loop to itself."""
    row, col = table.sum(1), table.sum(0)
    gain = (_xlogx(table + t) - _xlogx(table)).sum(1) + (_xlogx(table + f[:, None]) - _xlogx(table)).sum(0)
    diag = np.diag(table)
    gain += _xlogx(diag + t + f + loop) - _xlogx(diag + t) - _xlogx(diag + f) + _xlogx(diag)
    left, right = t.sum() + loop, f.sum() + loop
    return gain - (_xlogx(row + left) - _xlogx(row) + _xlogx(col + right) - _xlogx(col))


def _rare_fit(table: np.ndarray, own: np.ndarray, to: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word's neighbours (rows of to, by) in each class, in its own class without the word itself."""
    n = max(table.sum(), 1)
    fit = np.zeros((len(own), len(table)))
    at = np.arange(len(own))
    mine = np.zeros(len(own))
    for counts, seen in ((table, to), (table.T, by)):
        prior = ADD * len(table) * (counts.sum(0) + ADD) / (n + ADD * len(table))
        size = counts.sum(1) + prior.sum()
        fit += seen @ np.log((counts + prior) / size[:, None]).T
        less = np.log((np.maximum(counts[own] - seen, 0) + prior) / np.maximum(size[own] - seen.sum(1), prior.sum())[:, None])
        mine += (seen * less).sum(1)
    fit[at, own] = mine
    return fit


def likelihood(table: np.ndarray) -> float:
    """What of the log-likelihood of the training bigrams depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchange(counts: np.ndarray, n_classes: int, sweeps: int, least_moves: float = 0.002) -> np.ndarray:
    """Class of each row of a square matrix of bigram counts (previous, next), by the exchange algorithm."""
    n = len(counts)
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n) % n_classes
    n_classes = min(n_classes, max(n, 1))
    to = np.zeros((n, n_classes))  # word followed by class
    by = np.zeros((n, n_classes))  # word after class
    for c in range(n_classes):
        to[:, c] = counts[:, own == c].sum(1)
        by[:, c] = counts[own == c].sum(0)
    table = np.stack([to[own == c].sum(0) for c in range(n_classes)])
    for _ in range(sweeps):
        moves = 0
        for w in order:
            a, loop = own[w], float(counts[w, w])
            t, f = to[w].copy(), by[w].copy()
            t[a] -= loop
            f[a] -= loop
            # the table without w, then the gain in sum(n log n) of adding w to each class
            table[a] -= t
            table[:, a] -= f
            table[a, a] -= loop
            b = int(_gain(table, t, f, loop).argmax())
            table[b] += t
            table[:, b] += f
            table[b, b] += loop
            if b != a:
                moves += 1
                own[w] = b
                to[:, a] -= counts[:, w]
                to[:, b] += counts[:, w]
                by[:, a] -= counts[w]
                by[:, b] += counts[w]
        if moves <= least_moves * n:
            break
    return own


def _previous(row: dict, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, unit, document number) of every token of a block's documents, each document's end counted as one."""
    sizes = np.array(row["sizes"], np.int64)
    stop = np.cumsum(sizes + 1) - 1
    n = len(units) + len(sizes)
    with_end = np.full(n, end, np.int64)
    inside = np.ones(n, bool)
    inside[stop] = False
    with_end[inside] = units
    before = np.empty_like(with_end)
    before[1:] = with_end[:-1]
    if n:
        before[0] = end
    return before, with_end, np.repeat(np.arange(len(sizes)), sizes + 1)


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """The sum of sparse count vectors of a fixed size, added up per slice of the vector before they reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.int64)
        rows = table.to_pylist()
        for r in rows:
            np.add.at(total, unpack(r["at"], np.uint32), unpack(r["n"], np.uint32).astype(np.int64))
        at = np.flatnonzero(total)
        return pa.table({"slice": pa.array([rows[0]["slice"]], pa.int32()), "at": [pack(at.astype(np.uint32))], "n": [pack(total[at].astype(np.uint64))]})

    out = np.zeros(size, np.int64)
    for r in df.groupBy("slice").applyInArrow(add, "slice int, at binary, n binary").toLocalIterator():
        out[r["slice"] * _SLICE + unpack(r["at"], np.uint32)] = unpack(r["n"], np.uint64)
    return out


_SLICE = 1 << 18


def _slices(vector: np.ndarray) -> Iterator[dict]:
    for s in range(0, len(vector), _SLICE):
        at = np.flatnonzero(vector[s : s + _SLICE])
        if len(at):
            yield {"slice": s // _SLICE, "at": pack(at.astype(np.uint32)), "n": pack(vector[s + at].astype(np.uint32))}


def _slice_batch(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = list(_slices(vector))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))


def score(docs: DataFrame, train_on: Column, *, n_words: int = 2000, n_classes: int = 64, n_groups: int = 12, sweeps: int = 12, corpus_sweeps: int = 6, least_gain: float = 0.005, id_col: str = "doc_id", text_col: str = "text", keep_classes: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs.

    Learns from the rows of which train_on is true (a null condition is true: such rows are not held out). Tokens are words
    between ASCII white space, A-Z in lower case, then one end for each text; a null or empty text is its end alone.
    base_score is the add-half unigram model's log10 probability, score the class model's. Counts and statistics come
    from all training rows, and all training words are clustered: n_words bounds only the table that the clustering starts
    from, corpus_sweeps the sweeps after it, which end once one gains less than least_gain nats a token. Without training rows both models have no word but the unknown one, and N is 0. Repeated rows count and are scored each.
    With keep_classes also `words`, the text's words, and `classes`, the class of each. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    in_training = F.coalesce(train_on, F.lit(True))
    blocks = wordblocks.build(docs, F.col(id_col), F.col(text_col), in_training, lower=True, label="classlm")

    # corpus counts of every word, and the most frequent ones
    def count(bucket: int, asked: list) -> Iterator[dict]:
        total: dict[bytes, int] = {}
        for _, words, blobs in asked:
            for w, c in zip(words, unpack(blobs["counts"], np.uint32).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        known = sorted(((c, w) for w, c in total.items() if c), key=lambda x: (-x[0], x[1]))
        bins = np.bincount(_bin(np.array([c for c, _ in known], np.int64)), minlength=_BINS)
        yield {"n": sum(c for c, _ in known), "v": len(known), "bins": bins.tolist(), "top": [{"w": w, "c": c} for c, w in known[:n_words]]}

    sums = stored(blocks.look_up(count, "n long, v long, bins array<bigint>, top array<struct<w: binary, c: bigint>>", carry=("counts",)), "classlm-counts")
    ends = blocks.df.agg(F.sum(F.size(F.filter("flags", lambda f: f)))).first()[0] or 0
    words_n, words_v = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    train_n, train_v = words_n + ends, words_v + (ends > 0)
    # few more words than n_words are sorted: those from the bin of counts on that completes them
    bins = np.array(sums.agg(*[F.coalesce(F.sum(F.col("bins")[i]), F.lit(0)) for i in range(_BINS)]).first())
    enough = np.flatnonzero(np.cumsum(bins[::-1]) >= n_words)
    at_least = _BINS - 1 - int(enough[0]) if len(enough) else 0
    frequent = F.filter("top", lambda t: t["c"] >= int(np.ceil(2 ** (at_least / 4))))
    head = [(bytes(r["w"]), r["c"]) for r in sums.select(F.explode(frequent).alias("t")).select("t.*").orderBy(F.desc("c"), "w").limit(n_words).collect()]
    index = {w: n for n, (w, _) in enumerate(head)}
    k = len(head)
    other, end = k, k + 1
    heads = spark.sparkContext.broadcast(index)

    def head_units(row: dict) -> np.ndarray:
        known = heads.value
        return np.fromiter((known.get(w, other) for b in row["words"] for w in wordblocks.unpack_words(b)), np.int64, row["n_words"])

    def training(row: dict) -> np.ndarray:
        return np.repeat(np.array(row["flags"], bool), np.array(row["sizes"], np.int64) + 1)

    def bigrams(row: dict) -> Iterator[pa.RecordBatch]:
        before, unit, _ = _previous(row, head_units(row)[numbers(row)], end)
        use = training(row)
        yield from _slice_batch(np.bincount(before[use] * (k + 2) + unit[use], minlength=(k + 2) ** 2))

    pairs = _summed(blocks.each(bigrams, "slice int, at binary, n binary", columns=("words", "n_words")), (k + 2) ** 2).reshape(k + 2, k + 2)
    n_classes, n_groups = min(n_classes, max(k, 1)), min(n_groups, max(k, 1))
    classes = exchange(pairs[:k, :k], n_classes, sweeps) if k else np.empty(0, np.int64)
    table = np.zeros((n_classes, n_classes), np.int64)
    np.add.at(table, (classes[:, None], classes[None, :]), pairs[:k, :k])
    group_of_class = exchange(table, n_groups, 30)
    # classes: those of the head, a tail class for each group, the unknown word, the end
    last, total = n_classes + n_groups, n_classes + n_groups + 2
    groups = np.r_[group_of_class[classes] if k else np.empty(0, np.int64), n_groups, n_groups]
    group_share = np.bincount(groups[:k], weights=pairs[:k, :k].sum(1) if k else None, minlength=n_groups)[:n_groups] + ADD
    group_pairs = np.zeros((n_groups, n_groups))
    np.add.at(group_pairs, (group_of_class[:, None], group_of_class[None, :]), table)
    near = np.log((group_pairs + group_pairs.T + ADD) / (group_pairs + group_pairs.T + ADD).sum(1, keepdims=True))
    prior = np.log(group_share / group_share.sum())

    def neighbours(row: dict) -> Iterator[pa.RecordBatch]:
        units, own = head_units(row), numbers(row)
        before, unit, _ = _previous(row, np.arange(len(own)), -1)
        use = training(row) & (unit >= 0)
        g = np.r_[groups[units[own]], n_groups]  # the last entry answers for an end
        word = np.r_[own, 0]
        after = np.r_[unit[1:], -1]
        seen = np.zeros(row["n_words"] * n_groups, np.int64)
        for side in (before, after):
            ok = use & (side >= 0)
            at, near_by = word[unit[ok]], g[side[ok]]
            tail = (units[at] == other) & (near_by < n_groups)
            seen += np.bincount(at[tail] * n_groups + near_by[tail], minlength=len(seen))
        seen = seen.reshape(-1, n_groups)
        stops = np.cumsum([len(wordblocks.unpack_words(b)) for b in row["words"]])
        rows = [{"block": row["block"], "bucket": n, "seen": pack(seen[s:e].reshape(-1).astype(np.uint32))} for n, (s, e) in enumerate(zip(np.r_[0, stops[:-1]], stops, strict=True))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("seen", pa.binary())]))

    around = blocks.each(neighbours, "block long, bucket int, seen binary", columns=("words", "n_words"))
    head_class = {w: (int(classes[n]), c) for n, (w, c) in enumerate(head)}
    head_table = spark.sparkContext.broadcast(head_class)

    def assign(bucket: int, asked: list) -> Iterator[dict]:
        known: dict[bytes, int] = {}
        asks = []
        for block, words, blobs in asked:
            put = known.setdefault
            asks.append((block, np.fromiter((put(w, len(known)) for w in words), np.int64, len(words)), unpack(blobs["counts"], np.uint32), unpack(blobs["seen"], np.uint32).reshape(-1, n_groups)))
        counts, seen = np.zeros(len(known), np.int64), np.zeros((len(known), n_groups))
        for _, which, c, s in asks:
            counts[which] += c
            seen[which] += s
        fit = seen @ near.T + prior
        chosen = n_classes + fit.argmax(1)
        # words without a frequent neighbour are dealt over the tail classes: the sweeps tell them apart
        for w, n in known.items():
            if not seen[n].any():
                chosen[n] = n_classes + xxhash.xxh32_intdigest(w, 13) % n_groups
        for w, n in known.items():
            if w in head_table.value:
                chosen[n] = head_table.value[w][0]
        chosen[counts == 0] = last
        sizes, types = np.bincount(chosen, weights=counts, minlength=total), np.bincount(chosen[counts > 0], minlength=total)
        for i, (block, which, _, _) in enumerate(asks):
            yield {"block": block, "bucket": bucket, "count": pack(counts[which].astype(np.uint64)), "cls": pack(chosen[which].astype(np.uint16)), "sizes": sizes.astype(int).tolist() if not i else None, "types": types.tolist() if not i else None}

    known_schema = "block long, bucket int, count binary, cls binary, sizes array<bigint>, types array<bigint>"
    known = stored(blocks.look_up(assign, known_schema, extra=around, carry=("counts", "seen")), "classlm-words")

    def contexts(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        # of each word the classes before and after it, and with the first bucket the block's class bigrams
        own = [unpack(b, np.uint16) for b in got["cls"]]
        stops = np.cumsum([0, *map(len, own)])
        n = int(stops[-1])
        cls = np.r_[np.concatenate([*own, np.empty(0, np.uint16)]), total - 1].astype(np.uint32)
        before, word, _ = _previous(row, numbers(row), n)
        use = training(row)
        before, word = before[use].astype(np.uint32), word[use].astype(np.uint32)
        table = np.bincount(cls[before].astype(np.int64) * total + cls[word], minlength=total * total)
        after, to = before < n, word < n
        keys = np.concatenate([before[after] * np.uint32(2 * total) + cls[word[after]], word[to] * np.uint32(2 * total) + (cls[before[to]] + np.uint32(total))])
        at, times = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(at, stops * 2 * total)
        rows = []
        for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            places = np.diff(at[s:e], prepend=np.uint32(stops[i] * 2 * total)).astype(np.uint32)
            rows.append({"block": row["block"], "bucket": got["bucket"][i], "cls": got["cls"][i], "places": pack(places), "times": pack(times[s:e].astype(np.uint32)), "slice": None, "at": None, "n": None})
        if rows:
            rows[0] |= next(_slices(table), {})
            yield pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("cls", "places", "times")], ("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    loops = {w: int(pairs[n, n]) for w, n in index.items()}

    def move(table: np.ndarray, sweep: int) -> Callable[[int, list], Iterator[dict]]:
        def moved(bucket: int, asked: list) -> Iterator[dict]:
            known: dict[bytes, int] = {}
            put = known.setdefault
            asks = [(block, np.fromiter((put(w, len(known)) for w in words), np.int64, len(words)), blobs) for block, words, blobs in asked]
            counts, cls, seen = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.zeros(len(known) * 2 * total, np.uint32)
            for _, which, blobs in asks:
                counts[which] += unpack(blobs["counts"], np.uint32)
                cls[which] = unpack(blobs["cls"], np.uint16)
                at = np.cumsum(unpack(blobs["places"], np.uint32), dtype=np.int64)
                seen[which[at // (2 * total)] * 2 * total + at % (2 * total)] += unpack(blobs["times"], np.uint32)
            seen = seen.reshape(-1, 2 * total)
            chosen = cls.copy()
            for s in range(0, len(known), 8192):
                part = seen[s : s + 8192].astype(np.float64)
                chosen[s : s + 8192] = _rare_fit(table, cls[s : s + 8192], part[:, :total], part[:, total:])[:, :last].argmax(1)
            # frequent words one after the other, by their exact gain
            now = table.copy()
            for w in sorted(known.keys() & loops_of.value.keys(), key=lambda w: -counts[known[w]]):
                i, loop = known[w], float(loops_of.value[w])
                a, t, f = cls[i], seen[i, :total].astype(np.float64), seen[i, total:].astype(np.float64)
                t[a] -= loop
                f[a] -= loop
                now[a] -= t
                now[:, a] -= f
                now[a, a] -= loop
                b = chosen[i] = _gain(now, t, f, loop)[:last].argmax()
                now[b] += t
                now[:, b] += f
                now[b, b] += loop
            if sweep > 1:
                stays = np.fromiter((xxhash.xxh32_intdigest(w, 11) + sweep & 1 for w in known), bool, len(known))
                chosen[stays] = cls[stays]
            chosen[counts == 0] = last
            sizes, types = np.bincount(chosen, weights=counts, minlength=total), np.bincount(chosen[counts > 0], minlength=total)
            for i, (block, which, _) in enumerate(asks):
                yield {"block": block, "bucket": bucket, "count": pack(counts[which].astype(np.uint64)), "cls": pack(chosen[which].astype(np.uint16)), "sizes": sizes.astype(int).tolist() if not i else None, "types": types.tolist() if not i else None}

        return moved

    loops_of = spark.sparkContext.broadcast(loops)
    before_it, best = known, -np.inf
    for n in range(corpus_sweeps + 1 if words_n else 0):
        path = scratch_path(spark, "classlm-contexts")
        blocks.with_answers(known.select("block", "bucket", "cls"), contexts, "block long, bucket int, cls binary, places binary, times binary, slice int, at binary, n binary").write.parquet(path)
        near_by = spark.read.parquet(path)
        table = _summed(near_by.where("slice IS NOT NULL").select("slice", "at", "n"), total * total).reshape(total, total).astype(np.float64)
        now = likelihood(table) / train_n
        if now < best:
            known = before_it
        enough = now - best < least_gain
        best = max(now, best)
        if not enough and n < corpus_sweeps:
            before_it = known
            around = near_by.select("block", "bucket", "cls", "places", "times")
            known = stored(blocks.look_up(move(table, n), known_schema, extra=around, carry=("counts", "cls", "places", "times")), "classlm-words")
        remove(spark, path)
        if enough:
            break

    def transitions(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        # were one token left out, a word seen once would be unknown: half of it stands for the unknown word
        cls = np.concatenate([*(unpack(b, np.uint16) for b in got["cls"]), np.empty(0, np.uint16)]).astype(np.int64)
        once = np.concatenate([*(unpack(b, np.uint64) for b in got["count"]), np.empty(0, np.uint64)]) == 1
        cls, once = np.r_[cls, total - 1], np.r_[once, False]
        before, word, _ = _previous(row, numbers(row), len(cls) - 1)
        use = training(row)
        before, word = before[use], word[use]
        seen = np.zeros(total * total, np.int64)
        for rows, which in ((cls[before], slice(None)), (np.full(len(word), last), once[before])):
            p, w = rows[which], word[which]
            seen += np.bincount(p * total + cls[w], weights=2 - once[w], minlength=len(seen)).astype(np.int64)
            seen += np.bincount(p * total + last, weights=once[w], minlength=len(seen)).astype(np.int64)
        rows = list(_slices(seen))
        if rows:
            yield pa.Table.from_pylist(rows, schema=pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    answers = known.select("block", "bucket", "count", "cls")
    moves = _summed(blocks.with_answers(answers, transitions, "slice int, at binary, n binary"), total * total).reshape(total, total) / 2
    stats = known.where("sizes IS NOT NULL").select(F.posexplode(F.arrays_zip("sizes", "types")).alias("c", "z")).groupBy("c").agg(F.sum("z.sizes").alias("s"), F.sum("z.types").alias("t")).collect()
    sizes, types = np.zeros(total), np.zeros(total)
    for r in stats:
        sizes[r["c"]], types[r["c"]] = r["s"], r["t"]
    sizes[total - 1], types[total - 1] = ends, 1
    types[last] += 1  # the unknown word
    # transitions: Witten-Bell smoothing towards the add-half share of each class that has a word
    share = np.where(types > 0, np.r_[sizes[:last], moves[:last, last].sum(), sizes[last + 1 :]] + ADD * types, 0)
    share /= share.sum()
    kinds = (moves > 0).sum(1, keepdims=True)
    follow = (moves + np.maximum(kinds, 1) * share) / np.maximum(moves.sum(1, keepdims=True) + np.maximum(kinds, 1), 1)
    with np.errstate(divide="ignore"):
        follow = np.log10(follow)
    emit_total = np.log10(np.maximum(sizes + ADD * types, ADD))
    emit_total[total - 1] = np.log10(ends + ADD)  # the end is all that its class has
    base_total = np.log10(train_n + ADD * (train_v + 1))
    schema = f"doc_id {blocks.key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double" + (", words array<string>, classes array<int>" if keep_classes else "")

    def finish(row: dict, got: dict[str, list]) -> Iterator[pa.Table]:
        cls = np.concatenate([*(unpack(b, np.uint16) for b in got["cls"]), np.empty(0, np.uint16)]).astype(np.int64)
        count = np.concatenate([*(unpack(b, np.uint64) for b in got["count"]), np.empty(0, np.uint64)]).astype(np.float64)
        cls, count = np.r_[cls, total - 1], np.r_[count, ends]  # the end is the last word
        before, word, doc = _previous(row, numbers(row), len(cls) - 1)
        c = cls[word]
        log_count = np.log10(count + ADD)
        base = log_count - base_total
        own = log_count - emit_total[cls]
        n = len(row["sizes"])
        per_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
        n_tokens = np.array(row["sizes"], np.int64) + 1
        value = per_doc(own[word] + follow[cls[before], c])
        classes: dict[str, list] = {}
        if keep_classes:
            said = [w.decode("utf-8", "replace") for b in row["words"] for w in wordblocks.unpack_words(b)]
            parts = [word[s : e - 1] for s, e in zip(np.cumsum(n_tokens) - n_tokens, np.cumsum(n_tokens), strict=True)]
            classes = {"words": [[said[w] for w in p] for p in parts], "classes": [cls[p].astype(np.int32) for p in parts]}
        yield pa.table({
            "doc_id": row["keys"], "held_out": ~np.array(row["flags"], bool), "n_tokens": n_tokens, "n_known": per_doc(count[word] > 0).astype(np.int64),
            "train_tokens": np.full(n, train_n, np.int64), "base_score": per_doc(base[word]), "score": value, "perplexity": 10 ** np.minimum(-value / n_tokens, 300), **classes,
        })

    return blocks.with_answers(answers, finish, schema, columns=("words",) if keep_classes else ())
