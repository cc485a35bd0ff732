"""The bucket table: only touched buckets are written, broken and late writers change nothing."""

import pytest

from colloquy.operators import store
from colloquy.sources import buckets

ROW = "id long, created_at long, updated_at long, score double, status string"


def rows(spark, ids, at=1, score=1.0):
    return spark.createDataFrame([(i, at, at, score, "accepted") for i in ids], ROW)


def all_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def table(spark, tmp_path):
    return buckets.BucketTable.create(rows(spark, range(200)), f"{tmp_path}/table", buckets=16)


def test_upserts_write_their_buckets_alone(spark, table):
    before, new = table.manifest(), rows(spark, [3, 500, 501], at=5, score=9.0)
    want = all_of(store.upsert(table.read(), new))
    touched = table.upsert(new)
    after = table.manifest()
    assert len(touched) <= 3 and {b for b in after["at"] if after["at"][b] != before["at"].get(b)} == set(map(str, touched))
    assert all_of(table.read()) == want and len(want) == 202
    assert (3, 1, 5, 9.0, "accepted") in want and all_of(table.read(0)) == all_of(rows(spark, range(200)))
    assert table.upsert(new.where("false")) == [] and table.versions() == [0, 1]
    assert len(table.upsert(rows(spark, range(400), at=7))) == 16 and table.read().count() == 402


def test_updates_lookups_and_deletes(spark, table):
    changes = spark.createDataFrame([(7, "rejected"), (9999, "rejected")], "id long, status string")
    assert len(table.update(changes)) <= 2
    found = table.lookup(spark.createDataFrame([(7,), (8,), (12345,), (7,)], "id long"))
    assert {(r["id"], r["status"]) for r in found.collect()} == {(7, "rejected"), (8, "accepted")} and table.read().count() == 200
    table.delete(table.read().select("id").where("id > 3"))
    assert [r[0] for r in all_of(table.read())] == [0, 1, 2, 3] and table.lookup(spark.createDataFrame([(50,)], "id long")).count() == 0


def test_a_writer_that_breaks_off_changes_nothing(spark, table, monkeypatch):
    def broken(self, manifest):
        raise OSError("lost")

    before = all_of(table.read())
    with monkeypatch.context() as m:
        m.setattr(buckets.BucketTable, "_switch", broken)
        with pytest.raises(OSError):
            table.upsert(rows(spark, [1, 2], at=9))
    assert all_of(buckets.BucketTable(spark, table.path).read()) == before and table.versions() == [0]
    table.upsert(rows(spark, [1, 2], at=9))
    assert table.vacuum() >= 1 and table.versions() == [1] and len(all_of(table.read())) == 200 and table.vacuum() == 0


def test_a_late_writer_is_told(spark, table):
    late, old = buckets.BucketTable(spark, table.path), table.manifest()
    table.upsert(rows(spark, [1], at=9))
    with pytest.raises(buckets.Conflict):
        late._put(old, rows(spark, [2], at=9), [0])
    assert table.versions() == [0, 1] and (1, 1, 9, 1.0, "accepted") in all_of(late.read())


def test_empty_tables(spark, tmp_path):
    table = buckets.BucketTable.create(rows(spark, []), f"{tmp_path}/none", buckets=4)
    assert table.read().collect() == [] and table.read().columns == ["id", "created_at", "updated_at", "score", "status"]
    table.upsert(rows(spark, [5]))
    assert table.read().count() == 1
    with pytest.raises(FileNotFoundError):
        buckets.BucketTable(spark, f"{tmp_path}/nothing").read()
