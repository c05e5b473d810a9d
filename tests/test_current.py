"""The keyed current table: size, repeats, crashes, expiry, and the stream that feeds it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.sinks.current import CurrentTable

KEEP = "k long, v long, t long"


def merge(rows):
    return rows.groupBy("k").agg(F.max_by(F.struct("v", "t"), "t").alias("r")).select("k", "r.*")


def batch(spark, rows):
    return spark.createDataFrame(rows, KEEP)


def rows_of(table, spark):
    return {tuple(r) for r in table.read(spark).collect()}


def newest(rows):
    out = {}
    for k, v, t in rows:
        if k not in out or t > out[k][1]:
            out[k] = (v, t)
    return {(k, *x) for k, x in out.items()}


def test_batches_merge_and_old_versions_go(spark, tmp_path):
    table, rng, seen = CurrentTable(str(tmp_path / "t"), merge, deltas=3, kept=2), random.Random(1), []
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    for n in range(9):
        rows = [(rng.randrange(12), rng.randrange(99), 1000 * n + i) for i in range(20)]
        rng.shuffle(rows)
        seen += rows
        table.apply(batch(spark, rows), n)
        assert rows_of(table, spark) == newest(seen)
        assert len(table.manifest(spark)["folders"]) <= 4  # a base and three changes
        stored = spark.read.parquet(*[f"{tmp_path}/t/data/{f}" for f in table.manifest(spark)["folders"]]).count()
        assert stored <= 12 * 4
    names = sorted(p.name for p in (tmp_path / "t" / "manifests").iterdir() if p.name.endswith(".json"))
    assert len(names) == 2
    held = {f for n in names for f in table.manifest(spark, int(n[:-5]))["folders"]}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == held


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = CurrentTable(str(tmp_path / "t"), merge)
    table.apply(batch(spark, [(1, 10, 1)]), 0)
    table.apply(batch(spark, [(1, 11, 2), (2, 5, 1)]), 1)
    before = table.manifest(spark)
    table.apply(batch(spark, [(1, 99, 9)]), 1)
    table.apply(batch(spark, [(1, 99, 9)]), 0)
    assert table.manifest(spark) == before and rows_of(table, spark) == {(1, 11, 2), (2, 5, 1)}


@pytest.mark.parametrize("where", ["_commit", "_expire"])
def test_a_crash_leaves_a_whole_version(spark, tmp_path, monkeypatch, where):
    table = CurrentTable(str(tmp_path / "t"), merge, deltas=1)
    for n in range(2):
        table.apply(batch(spark, [(1, n, n), (n + 10, 0, 0)]), n)
    before = rows_of(table, spark)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(CurrentTable, where, crash)
    with pytest.raises(OSError):
        table.apply(batch(spark, [(1, 7, 7)]), 2)  # this one also makes a new base
    monkeypatch.undo()
    done = before if where == "_commit" else {(1, 7, 7), (10, 0, 0), (11, 0, 0)}
    assert rows_of(table, spark) == done
    table.apply(batch(spark, [(1, 7, 7)]), 2)  # the stream repeats the batch
    assert rows_of(table, spark) == {(1, 7, 7), (10, 0, 0), (11, 0, 0)}
    table.apply(batch(spark, [(5, 5, 5)]), 3)
    assert rows_of(table, spark) == {(1, 7, 7), (10, 0, 0), (11, 0, 0), (5, 5, 5)}
    held = set(table.manifest(spark)["folders"])
    assert held <= {p.name for p in Path(tmp_path / "t" / "data").iterdir()}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one = CurrentTable(str(tmp_path / "t"), merge)
    one.apply(batch(spark, [(1, 1, 1)]), 0)
    with pytest.raises(RuntimeError):
        one._commit(spark, {"version": 1, "batch_id": 5, "folders": []})
    assert rows_of(one, spark) == {(1, 1, 1)}
