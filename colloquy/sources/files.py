"""Files in and out: status folders of JSON samples, JSONL, training sets, and the notebook that trains on them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import store
from colloquy.operators.messages import MESSAGES

SAMPLE = f"id string, created_at string, updated_at string, status string, score double, messages {MESSAGES}, source string, duplicate_of string"
FOLDERS = {"accepted": "reviewed", "rejected": "rejected", "needs_review": "raw"}


def folder(status: Column) -> Column:
    return F.when(status == "accepted", "reviewed").when(status == "rejected", "rejected").otherwise("raw")


def write_mirrors(samples: DataFrame, path: str) -> None:
    """One JSON line a sample under folder=reviewed, rejected or raw; what lay there before is replaced."""
    samples.withColumn("folder", folder(F.col("status"))).write.mode("overwrite").partitionBy("folder").json(path)


def _scan(spark: SparkSession, path: str, multiline: bool, glob: str) -> DataFrame:
    raw = spark.read.schema(f"{SAMPLE}, folder string, _corrupt string").option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).option("recursiveFileLookup", False).json(path)
    return raw.select("*", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_path").alias("scan"))


def read_mirrors(spark: SparkSession, path: str, *, multiline: bool = False, glob: str = "*.json") -> DataFrame:
    """All samples of the status folders, the newest file's for each id. Corrupt files are left out; a missing status follows
    from the folder, other missing fields get defaults."""
    good = _scan(spark, path, multiline, glob).where(F.col("_corrupt").isNull() & F.col("id").isNotNull())
    by_folder = F.when(F.col("folder") == "reviewed", "accepted").when(F.col("folder") == "rejected", "rejected").otherwise("needs_review")
    filled = good.withColumns({"status": F.when(F.col("status").isin(*store.STATUSES), F.col("status")).otherwise(by_folder), "score": F.coalesce("score", F.lit(0.0)), "source": F.coalesce("source", F.lit("teacher")), "messages": F.coalesce("messages", F.array().cast(MESSAGES))})
    return store.newest_per_id(filled).drop("mtime", "scan", "_corrupt", "folder")


def unread_mirrors(spark: SparkSession, path: str, *, multiline: bool = False, glob: str = "*.json") -> DataFrame:
    """What read_mirrors leaves out: the fields that could be read, the raw record in `_corrupt` where it is broken, and its file in `scan`."""
    return _scan(spark, path, multiline, glob).where(F.col("_corrupt").isNotNull() | F.col("id").isNull())


def rebuild(spark: SparkSession, mirrors: str, table: str, *, aside: str | None = None) -> DataFrame:
    """Write the sample table anew from the mirrors; counts by status come back.

    Records that cannot be read are set aside under `aside`, beside the table by default. An id that is there twice is an error.
    """
    unread_mirrors(spark, mirrors).write.mode("overwrite").parquet(aside or f"{table.rstrip('/')}_corrupt")
    store.with_hash(read_mirrors(spark, mirrors)).write.mode("overwrite").parquet(table)
    written = spark.read.parquet(table)
    if not written.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"{table}: an id is there more than once")
    return written.groupBy("status").count()


def write_jsonl(rows: DataFrame, path: str, *, one_file: bool = False) -> None:
    """One object a line, UTF-8 as it is. A single file is for small results: one task writes it."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").json(path)


def write_training_sets(samples: DataFrame, path: str, **options: object) -> None:
    """chatml ({id, messages, metadata}) and sharegpt ({id, conversations, metadata}); an empty selection is an error."""
    rows = store.export(samples, **options)
    if rows.isEmpty():
        raise ValueError("no sample to export")
    rows = rows.orderBy(F.desc("score"), F.desc("updated_at"), "id")
    rows.select("id", "messages", "metadata").write.mode("overwrite").json(f"{path}/chatml")
    rows.select("id", "conversations", "metadata").write.mode("overwrite").json(f"{path}/sharegpt")


def write_notebook(path: str | Path, *, model: str, mode: str = "qlora", dataset: str = "train_chatml.jsonl", modes: tuple[str, ...] = ("qlora", "lora", "full"), targets: dict[str, str] | None = None) -> Path:
    """An nbformat-4 notebook that fine-tunes `model` on the exported set. With targets, `model` is one of their names."""
    if targets is not None:
        if model not in targets:
            raise ValueError(f"model must be one of {', '.join(targets)}")
        model = targets[model]
    if mode not in modes:
        raise ValueError(f"mode must be one of {', '.join(modes)}")
    cell = lambda kind, text: {"cell_type": kind, "metadata": {}, "source": text.splitlines(keepends=True)} | ({"outputs": [], "execution_count": None} if kind == "code" else {})
    cells = [
        cell("markdown", f"# Fine-tuning {model} ({mode})\n\nReads `{dataset}`, one conversation a line."),
        cell("code", f"from datasets import load_dataset\nrows = load_dataset('json', data_files={dataset!r}, split='train')"),
        cell("code", f"MODEL, MODE = {model!r}, {mode!r}\nQUANTISED = MODE == 'qlora'"),
        cell("code", "from transformers import AutoModelForCausalLM, AutoTokenizer\ntok = AutoTokenizer.from_pretrained(MODEL)\nmodel = AutoModelForCausalLM.from_pretrained(MODEL, load_in_4bit=QUANTISED)"),
        cell("code", "from trl import SFTConfig, SFTTrainer\ntexts = rows.map(lambda r: {'text': tok.apply_chat_template(r['messages'], tokenize=False)})\nSFTTrainer(model=model, train_dataset=texts, args=SFTConfig(output_dir='out')).train()"),
    ]
    Path(path).write_text(json.dumps({"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False, indent=1), encoding="utf-8")
    return Path(path)
