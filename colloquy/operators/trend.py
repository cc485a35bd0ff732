"""The running trend of conversations: after each answer, what all turns up to it add up to.

Every turn is measured once, by itself; a turn's row then holds sums over the turns before it and small windows of the last
few. In a batch, turns are dealt by ranges of (conversation, turn), so that one very long conversation lies in many
partitions: sums run within a partition, and one row for each conversation and partition carries them on. In a stream the same
numbers are kept as state by conversation. Severity is one expression over these numbers, the same for both.

Repeated rows (of one conversation, turn, role and text) count once, rows without an id or turn number not at all. A turn's rows
go by role, then by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from colloquy.functions import text as tx
from colloquy.functions.lexicons import DEFAULT, Lexicon
from colloquy.functions.similarity import with_ratios
from colloquy.operators import scoring
from colloquy.scratch import stored

COUNTS = ["n_messages", "n_assistants", "formula_hits", "emoji_hits", "hype_hits", "vulnerability_hits", "tension_hits"]
_ORDER = ["turn", "role", "tie"]
#: Messages whose domains are recent, answers whose openings and whose repetition are.
MESSAGES, HEADS, LOOPS = 4, 4, 3


def measured(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lx: Lexicon = DEFAULT, spec: Column | None = None, tier: Column | None = None) -> DataFrame:
    """What each user's or assistant's turn adds: id, turn, role, tie, counts (one array, domains last), domains, head, loops, allowed.

    spec and tier are columns of turns that say which domains its conversation may touch.
    """
    rows = turns.where(F.col(role_col).isin("user", "assistant") & F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    said, answer = tx.text_of(F.col(text_col)), F.col(role_col) == "assistant"
    of_answer = lambda c: F.when(answer, c).otherwise(0)
    own = {
        "n_messages": F.lit(1), "n_assistants": of_answer(F.lit(1)), "formula_hits": of_answer(tx.pattern_count(said, lx.formulas)), "emoji_hits": of_answer(tx.emoji_count(said)), "hype_hits": tx.marker_count(said, lx.trend_hype),
        "vulnerability_hits": of_answer(tx.marker_count(said, lx.vulnerability)), "tension_hits": of_answer(tx.marker_count(said, lx.tension)),
    }
    domains = tx.let(tx.domain_counts(said, lx.domains), lambda m: F.array(*[F.coalesce(F.element_at(m, name), F.lit(0)).cast("long") for name in sorted(lx.domains)]))
    allowed = scoring.allowed_domains(spec if spec is not None else F.lit(""), tier if tier is not None else F.lit("low"), lx)
    rows = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.xxhash64(said).alias("tie"), *[c.cast("long").alias(k) for k, c in own.items()], domains.alias("_d"), F.when(answer, tx.compact(F.substr(said, F.lit(1), F.lit(90)))).alias("head"), (answer & (tx.ngram_repetition(said) > 0.46)).alias("loops"), allowed.alias("allowed"))
    names = F.array(*map(F.lit, sorted(lx.domains)))
    seen = F.transform(F.filter(F.arrays_zip(names.alias("n"), F.col("_d").alias("k")), lambda x: x["k"] > 0), lambda x: x["n"])
    return rows.select("id", *_ORDER, F.concat(F.array(*COUNTS), "_d").alias("counts"), seen.alias("domains"), "head", "loops", "allowed")


def _severity(df: DataFrame, lx: Lexicon, with_similarity: bool) -> DataFrame:
    """id, turn, nth, severity, drift_severity, warnings and counts, from sums (array), recent, heads, looped and allowed."""
    names = sorted(lx.domains)
    df = df.withColumns({name: F.col("sums")[k] for k, name in enumerate(COUNTS)})
    hits = F.transform(F.array(*map(F.lit, names)), lambda n, i: F.struct(n.alias("k"), F.get("sums", i + len(COUNTS)).cast("int").alias("v")))
    df = df.withColumn("drift_counts", F.map_from_entries(F.filter(hits, lambda e: e["v"] > 0)))
    pairs = F.greatest(F.size("heads") - 1, F.lit(0))
    df = with_ratios(df, "_sims", F.slice("heads", F.lit(1), pairs), F.slice("heads", F.lit(2), pairs), 0.58) if with_similarity else df
    alike = F.size(F.filter("_sims", lambda s: s > 0.58)) if with_similarity else F.lit(0)
    entropy, seen = tx.entropy(F.col("drift_counts")), F.map_keys("drift_counts")
    df = df.withColumns({"_alike": alike, "drift_entropy": entropy, "drift_unexpected": F.array_sort(F.array_except(seen, "allowed")), "drift_recent_unexpected": F.array_sort(F.array_except("recent", "allowed"))})
    c, recent_n = F.col, F.size("drift_recent_unexpected")
    drift = [
        ("recent turns jump to several other topics", recent_n >= 2, F.lit(2.2) + recent_n * 0.35), ("recent turns touch another topic", (recent_n == 1) & (c("n_messages") >= 8), F.lit(0.8)),
        ("too many topics", (F.size("drift_counts") >= 5) & (c("drift_entropy") >= 1.75), F.lit(1.4)), ("too many topics outside the plan", F.size("drift_unexpected") >= 3, F.lit(1.2)),
    ]
    own = [
        ("formulas", c("formula_hits") >= 2, F.lit(2.5) + F.least(F.lit(3.0), c("formula_hits") * 0.6)), ("alike openings", (F.size("heads") >= 3) & (c("_alike") >= 2), F.lit(2.0)),
        ("hype without vulnerability", (c("n_assistants") >= 4) & (c("emoji_hits") / F.greatest(c("n_assistants"), F.lit(1)) >= 1.8) & (c("hype_hits") >= 8) & (c("vulnerability_hits") == 0), F.lit(2.0)),
        ("no tension", (c("n_assistants") >= 5) & (c("tension_hits") == 0) & (c("vulnerability_hits") == 0), F.lit(1.4)), ("repetition within an answer", c("looped"), F.lit(1.4)),
    ]
    total = lambda found: reduce(lambda a, b: a + b, [F.when(cond, value).otherwise(0.0) for _, cond, value in found])
    df = df.withColumn("drift_severity", F.round(total(drift), 2))
    warnings = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in own + drift]))
    return df.select("id", "turn", c("n_assistants").alias("nth"), F.round(total(own) + c("drift_severity"), 2).alias("severity"), "drift_severity", warnings.alias("warnings"), *COUNTS, "drift_counts", "drift_entropy")



def by_turn(turns: DataFrame, *, lx: Lexicon = DEFAULT, with_similarity: bool = True, **columns) -> DataFrame:  # noqa: ANN003
    """A row after each assistant's turn: id, turn, nth (answers so far), severity, drift_severity, warnings, counts so far.

    columns: as of `measured`. Two answers in one turn have a row each. An empty table gives no rows.
    """
    spark = turns.sparkSession
    id_col, turn_col = columns.get("id_col", "conv_id"), columns.get("turn_col", "turn")
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, turn_col)
    rows = stored(measured(dealt, lx=lx, **columns).withColumn("part", F.spark_partition_id()), "trend-turns")
    own = Window.partitionBy("id", "part").orderBy(*_ORDER)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("id", "part", *_ORDER).orderBy("head"))).where("again = 1").drop("again")
    width = len(COUNTS) + len(lx.domains)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.array(*[F.sum(F.col("counts")[k]).over(upto) for k in range(width)]))
    rows = rows.withColumn("near", F.collect_list("domains").over(own.rowsBetween(1 - MESSAGES, 0)))

    # one row for each conversation and partition: its sums, and its last few messages and answers; then what lies before it
    back = Window.partitionBy("id", "part").orderBy(*[F.desc(c) for c in _ORDER])
    place = lambda x: F.struct(*_ORDER, x.alias("x"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"])
    last = rows.withColumn("k", F.row_number().over(back)).where(F.col("k") < MESSAGES)
    parts = last.groupBy("id", "part").agg(F.max_by("within", F.struct(*_ORDER)).alias("total"), ordered(place(F.col("domains"))).alias("tail"))
    before = Window.partitionBy("id").orderBy("part")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("id", "part", F.array(*[F.coalesce(F.sum(F.col("total")[k]).over(earlier), F.lit(0)) for k in range(width)]).alias("base"), F.flatten(F.collect_list("tail").over(before.rowsBetween(1 - MESSAGES, -1))).alias("before"))
    answers = rows.where(F.col("role") == "assistant")
    heads = answers.withColumn("k", F.row_number().over(back)).where(F.col("k") < HEADS).groupBy("id", "part").agg(ordered(place(F.struct("head", "loops"))).alias("tail"))
    heads = heads.select("id", "part", F.flatten(F.collect_list("tail").over(before.rowsBetween(1 - HEADS, -1))).alias("heads_before"))

    said = answers.withColumn("heads_near", F.collect_list(F.struct("head", "loops")).over(own.rowsBetween(1 - HEADS, 0)))
    full = said.join(parts, ["id", "part"]).join(heads, ["id", "part"])
    end = lambda a, n: F.slice(a, F.greatest(F.lit(1), F.size(a) - (n - 1)), F.lit(n))
    openings = F.concat("heads_before", "heads_near")
    running = full.select(
        "id", "turn", "allowed", F.zip_with("within", "base", lambda a, b: a + b).alias("sums"), F.array_distinct(F.flatten(end(F.concat("before", "near"), MESSAGES))).alias("recent"),
        F.transform(end(openings, HEADS), lambda x: x["head"]).alias("heads"), F.exists(end(openings, LOOPS), lambda x: x["loops"]).alias("looped"),
    )
    return _severity(running, lx, with_similarity)


class _Running(StatefulProcessor):
    """Sums and the last few messages of one conversation; a row after each answer. Turns that are not after the last one seen
    are left out, so a batch that comes again adds nothing."""

    STATE = "last struct<turn: long, role: string, tie: bigint>, sums array<long>, recent array<array<string>>, heads array<string>, loops array<boolean>"

    def __init__(self, out: list[str], idle_ms: int | None):
        self.out, self.idle_ms = out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trend", self.STATE, self.idle_ms) if self.idle_ms else handle.getValueState("trend", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values(_ORDER, kind="stable")
        last, sums, recent, heads, loops = self.state.get() if self.state.exists() else (None, None, [], [], [])
        last = tuple(last) if last is not None else None
        recent, heads, loops, out = [list(x) for x in recent], list(heads), list(loops), []
        for turn, role, tie, counts, domains, head, looped, allowed in zip(*(batch[c] for c in (*_ORDER, "counts", "domains", "head", "loops", "allowed")), strict=True):
            at = (int(turn), role, int(tie))
            if last is not None and at <= last:
                continue
            last = at
            sums = [int(x) for x in counts] if sums is None else [int(a) + int(b) for a, b in zip(sums, counts, strict=True)]
            recent = [*recent, list(domains)][-MESSAGES:]
            if role == "assistant":
                heads, loops = [*heads, head][-HEADS:], [*loops, bool(looped)][-LOOPS:]
                out.append((key[0], at[0], list(allowed), sums, list(dict.fromkeys(x for y in recent for x in y)), heads, any(loops)))
        if last is not None:
            self.state.update((last, sums, recent, heads, loops))
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def stream_by_turn(turns: DataFrame, *, lx: Lexicon = DEFAULT, with_similarity: bool = True, idle: int | None = None, **columns) -> DataFrame:  # noqa: ANN003
    """The rows of `by_turn` from a stream, each when its answer comes in. Any split of the turns into batches gives the same
    rows, as long as a conversation's turns come in order.

    Needs the RocksDB state store. idle: milliseconds after which a conversation's state goes when nothing was said (never, if
    None). State is some hundred bytes a conversation, however long it is.
    """
    rows = measured(turns, lx=lx, **columns)
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    fields = ["id", "turn", "allowed", "sums", "recent", "heads", "looped"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, turn long, allowed array<string>, sums array<long>, recent array<string>, heads array<string>, looped boolean"
    running = rows.groupBy("id").transformWithStateInPandas(_Running(fields, idle), schema, "Append", "ProcessingTime" if idle else "None")
    return _severity(running, lx, with_similarity)
