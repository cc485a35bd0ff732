"""Quality reports over the sample table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.lexicons import DEFAULT, Lexicon
from colloquy.operators import messages as ms


def measures(samples: DataFrame, lx: Lexicon = DEFAULT) -> DataFrame:
    """samples with turns, formula, emoji, hype and vulnerability."""
    asst, text = ms.role_text(F.col("messages"), "assistant"), F.array_join(ms.contents(F.col("messages")), "\n")
    return samples.withColumns({"turns": F.size(ms.with_role(F.col("messages"), "assistant")), "formula": tx.pattern_count(asst, lx.formulas), "emoji": tx.emoji_count(text), "hype": tx.marker_count(text, lx.report_hype), "vulnerability": tx.marker_count(asst, lx.report_vulnerability), "preview": F.replace(F.substr(asst, F.lit(1), F.lit(180)), F.lit("\n"), F.lit(" "))})


def averages(measured: DataFrame) -> DataFrame:
    return measured.agg(F.count("*").alias("total"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(f"avg_{c}") for c in ("turns", "formula", "emoji", "hype", "vulnerability")])


def histograms(samples: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(axis, value, n) for every column in one pass; blank values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return samples.select(pairs).select("p.*").where("value IS NOT NULL AND value <> ''").groupBy("axis", "value").agg(F.count("*").alias("n"))


def top_issues(measured: DataFrame, n: int = 50) -> DataFrame:
    """The samples with the most formulas, hype and emoji among those with an issue."""
    bad = (F.col("formula") > 0) | (F.col("hype") >= 8) & (F.col("vulnerability") == 0) | (F.col("emoji") >= F.greatest(F.lit(12), F.col("turns") * 2))
    return measured.where(bad).orderBy(F.desc("formula"), F.desc("hype"), F.desc("emoji"), "id").limit(n)


def coverage(pool: DataFrame, samples: DataFrame, key: str = "topic_id") -> DataFrame:
    """One row: topics of the pool, how many samples have, their ratio."""
    seen = samples.select(key).distinct().withColumn("seen", F.lit(1))
    out = pool.join(seen, key, "left").agg(F.count("*").alias("total"), F.count("seen").alias("covered"))
    return out.withColumn("ratio", F.round(F.col("covered") / F.greatest(F.col("total"), F.lit(1)), 4))


def missing(pool: DataFrame, samples: DataFrame, key: str = "topic_id") -> DataFrame:
    return pool.join(samples.select(key), key, "left_anti")


def confusion(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_status, new_status, n, changed): changed where the status differs or the score moved by over 0.05."""
    both = before.select("id", F.col("status").alias("old_status"), F.col("score").alias("s0")).join(after.select("id", F.col("status").alias("new_status"), F.col("score").alias("s1")), "id")
    changed = (F.col("old_status") != F.col("new_status")) | (F.abs(F.col("s1") - F.col("s0")) > 0.05)
    return both.groupBy("old_status", "new_status").agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"))


def changes(before: DataFrame, after: DataFrame, n: int = 200) -> DataFrame:
    """The first n samples by id whose status differs or whose score moved by over 0.05."""
    both = before.select("id", F.col("status").alias("old_status"), F.col("score").alias("old_score")).join(after.select("id", F.col("status").alias("new_status"), F.col("score").alias("new_score")), "id")
    moved = (F.col("old_status") != F.col("new_status")) | (F.abs(F.col("new_score") - F.col("old_score")) > 0.05)
    return both.where(moved).orderBy("id").limit(n)
