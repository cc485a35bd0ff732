"""Mirrors, one file a sample: moves with the status, what breaks off leaves nothing, what cannot be read is told."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import store
from colloquy.operators.messages import MESSAGES
from colloquy.sources import mirror

ROW = f"id string, status string, score double, messages {MESSAGES}, updated_at string"


def files(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


@pytest.fixture()
def samples(spark):
    spark.dataSource.register(mirror.MirrorSource)
    talk = [("user", "hé 火锅"), ("assistant", "line\nline")]
    return spark.createDataFrame([("a", "accepted", 9.5, talk, "1"), ("../b", "rejected", 1.0, [], "1"), (".c", "needs_review", None, talk, "1"), ("d e", None, 2.0, None, None)], ROW).repartition(2)


def test_one_file_each_and_back(spark, samples, tmp_path):
    path = f"{tmp_path}/mirror"
    samples.write.format("mirror").mode("append").save(path)
    assert files(path) == ["raw/%2Ec.json", "raw/d%20e.json", "rejected/..%2Fb.json".replace("..", "%2E."), "reviewed/a.json"]
    back = spark.read.format("mirror").load(path)
    key = lambda df: sorted((r["id"], r["status"], r["score"], r["messages"], r["updated_at"]) for r in df.collect())
    assert key(back) == key(samples) and {r["folder"] for r in back.collect()} == {"raw", "rejected", "reviewed"}


def test_a_status_change_moves_the_file(spark, samples, tmp_path):
    path = f"{tmp_path}/mirror"
    samples.write.format("mirror").mode("append").save(path)
    changed = samples.where("id = 'a'").withColumns({"status": F.lit("rejected"), "updated_at": F.lit("2")})
    for _ in range(2):  # a job that runs again changes nothing more
        changed.write.format("mirror").mode("append").save(path)
        assert files(path) == ["raw/%2Ec.json", "raw/d%20e.json", "rejected/%2E.%2Fb.json", "rejected/a.json"]
    newest = store.newest_per_id(spark.read.format("mirror").load(path).withColumn("scan", F.col("file")))
    assert {r["id"]: r["status"] for r in newest.collect()}["a"] == "rejected"
    changed.write.format("mirror").mode("overwrite").save(path)
    assert files(path) == ["rejected/a.json"]


def test_an_aborted_job_leaves_nothing(spark, samples, tmp_path):
    path = f"{tmp_path}/mirror"
    samples.write.format("mirror").mode("append").save(path)
    before = files(path)
    bad = samples.unionByName(samples.limit(1).withColumn("id", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="without an id"):
        bad.withColumn("status", F.lit("rejected")).write.format("mirror").mode("append").save(path)
    assert files(path) == before and os.listdir(path) == [d for d in os.listdir(path) if not d.startswith(".")]


def test_what_cannot_be_read_is_told(spark, samples, tmp_path):
    path = f"{tmp_path}/mirror"
    samples.write.format("mirror").mode("append").save(path)
    for name, text in (("x", "{broken"), ("y", "[]"), ("z", '{"id": "z", "messages": "none"}'), ("w", '{"id": 5, "score": "3"}')):
        (tmp_path / "mirror" / "raw" / f"{name}.json").write_text(text)
    got = {r["file"].rsplit("/")[-1]: r for r in spark.read.format("mirror").load(path).collect()}
    assert {n for n, r in got.items() if r["_corrupt"] is not None} == {"x.json", "y.json", "z.json"} and (got["w.json"]["id"], got["w.json"]["score"]) == ("5", 3.0)
    assert spark.read.format("mirror").load(f"{tmp_path}/nothing").count() == 0
