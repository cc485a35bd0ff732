"""A reply without a model: the first of some candidates that is unlike what was said before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.lexicons import DEFAULT, Lexicon
from colloquy.functions.similarity import with_ratios
from colloquy.operators import messages as ms

#: Sequence ratio from which a candidate is like an earlier message.
LIKE = 0.82


def in_order(candidates: Column, key: Column) -> Column:
    """Candidates, each once and without blanks, in an order of their own for each key: by the digest of `key:candidate`."""
    kept = F.array_distinct(F.filter(F.transform(candidates, tx.strip), lambda c: c != ""))
    ranked = F.transform(kept, lambda c: F.struct(F.sha2(F.concat(key.cast("string"), F.lit(":"), c), 256).alias("r"), c.alias("c")))
    return F.transform(F.array_sort(ranked), lambda x: x["c"])


def unlike(df: DataFrame, name: str, candidates: Column, said: Column, key: Column, *, like: float = LIKE, fallback: bool = False) -> DataFrame:
    """df with the first candidate in the key's order whose ratio with each text of `said` is below like; null if there is none.

    With fallback the first of all takes its place. Both are arrays of texts, null counts as empty; texts are compared in
    compact form, and an empty one is like nothing. Nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({"_c": in_order(F.coalesce(candidates, none), key), "_s": F.transform(F.coalesce(said, none), tx.compact)})
    left = F.flatten(F.transform("_c", lambda c: F.transform("_s", lambda _: tx.compact(c))))
    right = F.flatten(F.transform("_c", lambda _: F.col("_s")))
    df = with_ratios(df.withColumns({"_l": left, "_r": right}), "_q", F.col("_l"), F.col("_r"), like - 1e-9)
    alike = lambda i: F.exists(F.slice("_q", i * F.size("_s") + 1, F.size("_s")), lambda q: q >= like)
    fresh = F.filter(F.transform("_c", lambda c, i: F.when(~alike(i), c)), lambda c: c.isNotNull())
    chosen = F.coalesce(F.get(fresh, F.lit(0)), F.get("_c", F.lit(0)) if fallback else F.lit(None).cast("string"))
    return df.withColumn(name, chosen).drop("_c", "_s", "_l", "_r", "_q")


def with_pool(df: DataFrame, name: str, *, messages: str = "messages", turn: Column, most: Column, lx: Lexicon = DEFAULT) -> DataFrame:
    """df with the kind of reply that a transcript asks for: `opening` before any user message, `ending` at the last turn, `plain`
    after an answer that reads like a template or like the message before it, `continuation` otherwise."""
    users, answers = ms.contents(F.col(messages), "user"), ms.contents(F.col(messages), "assistant")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    df = with_ratios(df, "_like", F.array(tx.compact(last(answers))), F.array(tx.compact(last(users))), 0.55)
    stiff = (tx.marker_hits(last(answers), lx.assistant_templates) > 0) | (F.col("_like")[0] > 0.55)
    kind = F.when(F.size(users) == 0, "opening").when(turn >= most - 1, "ending").when(stiff, "plain").otherwise("continuation")
    return df.withColumn(name, kind).drop("_like")


def local_replies(df: DataFrame, pools: DataFrame, *, id_col: str = "id", messages: str = "messages", turn: Column, most: Column, english: Column, lx: Lexicon = DEFAULT, name: str = "reply") -> DataFrame:
    """df with a user's reply from pools (pool, language `en` or `zh`, text): trimmed, unlike the last four user messages, or the
    first of its pool where all are alike; null where the pool has none. pools are some hundred texts and are broadcast."""
    lists = pools.where("text IS NOT NULL").groupBy(F.col("pool").alias("_pool"), F.col("language").alias("_lang")).agg(F.array_sort(F.collect_set(tx.trim_user(F.col("text")))).alias("_texts"))
    df = with_pool(df, "_kind", messages=messages, turn=turn, most=most, lx=lx)
    df = df.withColumn("_in", F.when(english, "en").otherwise("zh"))
    # one row for each pool and language
    out = df.join(F.broadcast(lists), (F.col("_kind") == F.col("_pool")) & (F.col("_in") == F.col("_lang")), "left")
    said = ms.keep_last(ms.contents(F.col(messages), "user"), 4)
    return unlike(out, name, F.col("_texts"), said, F.col(id_col), fallback=True).drop("_kind", "_in", "_pool", "_lang", "_texts")
