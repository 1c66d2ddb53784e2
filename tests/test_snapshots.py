import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from loomspark.sources import logs, snapshots


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_writer_killed_half_way_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        logs.read_latest(spark, root)
    logs.write_snapshot(spark.range(5), root, "2026-01-01")

    def half(batches):
        for batch in batches:
            yield batch
            if max(batch.column(0).to_pylist(), default=0) >= 98:
                raise RuntimeError("killed")

    broken = spark.range(100).repartition(4).mapInArrow(half, "id long")
    with pytest.raises(PythonException):
        logs.write_snapshot(broken.filter(F.col("id") >= 0), root, "2026-01-02")
    assert ids(logs.read_latest(spark, root)) == list(range(5))
    logs.write_snapshot(spark.range(7), root, "2026-01-02")
    assert ids(logs.read_latest(spark, root)) == list(range(7))


def test_killed_between_writing_and_the_rename(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    snapshots.commit(spark.range(3), root, "a")
    monkeypatch.setattr(snapshots, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        snapshots.commit(spark.range(9), root, "b")
    assert ids(snapshots.read(spark, root)) == [0, 1, 2] and snapshots.clean(spark, root) == 1


def test_a_reader_keeps_its_snapshot_while_it_is_replaced(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.commit(spark.range(3), root, "day")
    reader = snapshots.read(spark, root, "day")
    snapshots.commit(spark.range(4), root, "day")
    assert ids(reader) == [0, 1, 2] and ids(snapshots.read(spark, root, "day")) == [0, 1, 2, 3]


def test_parts(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        snapshots.commit(spark.range(n, n + 1), root, f"{n:03d}")
    assert ids(snapshots.read(spark, root)) == [0, 1, 2, 3] and ids(snapshots.read(spark, root, upto="002")) == [0, 1]
    snapshots.commit(spark.range(1), root, "all", alone=True)
    assert list(snapshots.parts(spark, root)) == ["all"] and snapshots.clean(spark, root) == 4 and ids(snapshots.read(spark, root)) == [0]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.commit(spark.range(1), root, "a")

    def other(now):
        snapshots.publish(spark, root, lambda x: x | {"theirs": "data/x"})
        return now | {"mine": "data/y"}

    with pytest.raises(RuntimeError):
        snapshots.publish(spark, root, other)
    assert "theirs" in snapshots.parts(spark, root) and "mine" not in snapshots.parts(spark, root)
