"""The sample table: upserts, updates, lookups, pages, exports, and the queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as tx
from colloquy.operators import messages as ms

STATUSES = ("accepted", "needs_review", "rejected")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", version: str = "updated_at", keep_first: str = "created_at") -> DataFrame:
    """One row a key: the latest version, with the created_at of the earliest. Of equal versions the new table's row wins."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_side"))
    first = F.first(keep_first).over(Window.partitionBy(key).orderBy(F.asc(version), "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("_nth", F.row_number().over(latest)).withColumn("_first", first).where("_nth = 1").withColumn(keep_first, F.col("_first")).select(*old.columns)


def update(samples: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """samples with the columns of changes set where the key is there; other columns, updated_at too, stay."""
    names = [c for c in changes.columns if c != key]
    own = changes.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in names])
    out = samples.join(own, key, "left").withColumns({c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in names})
    return out.select(*samples.columns)


def stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("avg_score"))


def matching(samples: DataFrame, *, status: str | None = None, q: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """The samples of a status whose messages, or any of the other text columns named, hold q: literally, in lower case."""
    out = samples if status is None else samples.where(F.col("status") == status)
    texts = [ms.conversation_text(F.col("messages")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return out if not q.strip() else out.where(F.lower(F.concat_ws("\n", *texts)).contains(q.strip().lower()))


def search(samples: DataFrame, *, status: str | None = None, q: str = "", limit: int = 50, offset: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """A page of the matching samples, best score first."""
    return ordered(matching(samples, status=status, q=q, columns=columns)).offset(max(0, offset)).limit(min(200, max(1, limit)))


def search_count(samples: DataFrame, **which: object) -> DataFrame:
    """One row, `total`: how many samples match, whatever the page."""
    return matching(samples, **which).agg(F.count("*").alias("total"))


def ordered(samples: DataFrame) -> DataFrame:
    return samples.orderBy(F.desc("score"), F.desc("updated_at"), "id")


def lookup(samples: DataFrame, key: object) -> DataFrame:
    return samples.where(F.col("id") == key)


def recent(samples: DataFrame, n: int) -> DataFrame:
    return samples.orderBy(F.desc("updated_at"), "id").limit(n)


def batch(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return samples.join(ids, "id", "left_semi")


def export(samples: DataFrame, *, include_review: bool = False, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Rows {id, messages, conversations, metadata} of accepted samples, metadata laid over score and status."""
    out = samples.where(F.col("status").isin("accepted", *(("needs_review",) if include_review else ())))
    out = out if sources is None else out.where(F.col("source").isin(*sources))
    own = F.create_map(F.lit("score"), F.col("score").cast("string"), F.lit("status"), F.col("status"))
    if "metadata" in samples.columns:
        given = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        own = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), given)
    return out.select("id", "messages", ms.to_sharegpt(F.col("messages")).alias("conversations"), own.alias("metadata"), "score", "updated_at")


def validate(samples: DataFrame) -> DataFrame:
    """Edited samples: known statuses only, scores from 0 to 10, stripped messages without blanks."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))))
    return samples.withColumns({"status": known, "score": tx.clamp(F.col("score")), "messages": ms.validated(F.col("messages"))})


def with_hash(samples: DataFrame) -> DataFrame:
    return samples.withColumn("text_hash", tx.fingerprint(ms.conversation_text(F.col("messages"))))


def newest_per_id(files: DataFrame) -> DataFrame:
    """Of several copies of an id the one modified last, of equal times the one scanned last."""
    last = Window.partitionBy("id").orderBy(F.desc("mtime"), F.desc("scan"))
    return files.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def progress(done: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * done / F.greatest(total, F.lit(1)), 1)


def decode(rows: DataFrame) -> DataFrame:
    """Stored rows with their five JSON texts as values: messages and conversations as arrays, spec, metadata and review as variants.

    A text that is null or no JSON becomes null. Other columns stay.
    """
    turns = {"messages_json": ("messages", "array<struct<role:string,content:string>>"), "sharegpt_json": ("conversations", "array<struct<from:string,value:string>>")}
    typed = {name: F.from_json(F.col(raw), kind) for raw, (name, kind) in turns.items() if raw in rows.columns}
    loose = {name: F.try_parse_json(F.col(f"{name}_json")) for name in ("spec", "metadata", "review") if f"{name}_json" in rows.columns}
    return rows.withColumns(typed | loose).drop(*turns, *[f"{name}_json" for name in loose])
