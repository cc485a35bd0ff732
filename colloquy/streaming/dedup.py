"""Duplicates in a stream, against a growing table of fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions import text as tx


def dedup_stream(stream: DataFrame, seen: str, out: str, checkpoint: str, *, id_col: str = "id", text_col: str = "text") -> StreamingQuery:
    """Append to `out` the rows whose canonical text no earlier row has, and their fingerprints to `seen` (Parquet folders).

    Within a batch the smallest id stays. Each batch has a folder of its own, so a batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.withColumn("fingerprint", tx.fingerprint(F.col(text_col)))
        firsts = own.groupBy("fingerprint").agg(F.min(id_col).alias(id_col))
        fresh = own.join(firsts, ["fingerprint", id_col], "left_semi")
        known = spark.read.schema("fingerprint string, batch long").parquet(seen).where(F.col("batch") < number) if number else None
        fresh = fresh if known is None else fresh.join(known, "fingerprint", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.read.parquet(f"{out}/batch={number}").select("fingerprint").write.mode("overwrite").parquet(f"{seen}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(turns: DataFrame, *, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Turns and characters of each conversation and window of event time `ts`, complete when the watermark has passed."""
    return turns.withWatermark("ts", lateness).groupBy(F.window("ts", window), "conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
