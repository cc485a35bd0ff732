"""Helpers that every training-data operator uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[str] = []
_tables: list[str] = []
_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of this machine's if that is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/colloquy-{app}"
        at, fs = _path(spark, _roots[app])
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return _roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, gone at the next release_scratch() or with the application."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_table(name: str) -> None:
    """Note a catalog table over a scratch path, to be dropped with it."""
    _tables.append(name)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete the written intermediate tables. Call it when results that read them have been stored."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop()}`")
    while _scratch:
        remove(spark, _scratch.pop())


def spare(taken: list[str], *labels: str) -> list[str]:
    """A column name for each label that is none of those taken, in any case."""
    used, out = {c.lower() for c in taken}, []
    for label in labels:
        name = f"_{label}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df below the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(key.cast("string")) % modulus


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space and 0x09 to 0x0D), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
