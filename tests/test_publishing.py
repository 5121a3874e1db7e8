"""Tables replaced while they are read, and work that stops and goes on."""

from __future__ import annotations

import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomstone.sources.published import Conflict, Published
from loomstone.streaming import resumable as R


def _rows(spark, n):
    return spark.range(n).select(F.col("id"), F.lit(n).alias("n"))


def test_versions_follow_each_other(spark, tmp_path):
    t = Published(spark, f"file://{tmp_path}/t")
    assert t.current() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    first = t.replace(_rows(spark, 3))
    before = t.read()
    second = t.replace(t.read().unionByName(_rows(spark, 2)))  # computed from the version it replaces
    assert t.read().count() == 5 and before.count() == 3 and t.current() == second
    with pytest.raises(Conflict):
        t.publish(t.stage(_rows(spark, 9)), first)
    assert t.current() == second
    third = t.replace(_rows(spark, 1))
    assert t.prune(1) == sorted([first, second]) and t.current() == third and t.read().count() == 1 and t.prune(1) == []


def test_two_writers_at_once_leave_one_whole_version(spark, tmp_path):
    t = Published(spark, f"file://{tmp_path}/t")
    t.replace(_rows(spark, 1))
    lost, seen, over = [], [], threading.Event()

    def write(n):
        for _ in range(3):
            try:
                Published(spark, t.path).replace(_rows(spark, n))
            except Conflict:
                lost.append(n)

    def read():
        while not over.is_set():
            rows = t.read().collect()
            seen.append(len({r.n for r in rows}) == 1 and len(rows) == rows[0].n)

    writers = [threading.Thread(target=write, args=(n,)) for n in (50, 70)]
    reader = threading.Thread(target=read)
    for x in (*writers, reader):
        x.start()
    for x in writers:
        x.join()
    over.set()
    reader.join()
    assert seen and all(seen)
    assert len(t._names("pointers")) == 7 - len(lost) and len(t._names("versions")) == 7 - len(lost)


def test_built_once(spark, tmp_path):
    made = []
    t = Published(spark, f"file://{tmp_path}/t")
    make = lambda n: lambda: made.append(n) or _rows(spark, n)
    assert t.build_once(make(2)) and not t.build_once(make(3)) and made == [2]

    def overtaken():
        Published(spark, t.path + "2").replace(_rows(spark, 4))
        return _rows(spark, 5)

    other = Published(spark, f"{t.path}2")
    assert not other.build_once(overtaken) and other.read().count() == 4 and len(other._names("versions")) == 1
    assert t.build_once(make(6), force=True) and t.read().count() == 6


def test_a_lock_left_behind_is_taken_away(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "_lock").write_text("gone")
    with pytest.raises(TimeoutError):
        Published(spark, f"file://{tmp_path}/t", patience=0.2).replace(_rows(spark, 1))
    Published(spark, f"file://{tmp_path}/t", patience=5, stale=0.0).replace(_rows(spark, 1))
    assert not (tmp_path / "t" / "_lock").exists()


def _work(done, broken=()):
    def work(rows):
        shards = sorted(r.shard for r in rows.select("shard").distinct().collect())
        if set(shards) & set(broken):
            raise ValueError("broken off")
        done.extend(shards)
        return rows.select("id", (F.col("id") * 2).alias("twice"), "shard")

    return work


def test_a_run_that_stops_goes_on_and_does_nothing_twice(spark, tmp_path):
    path, done = f"file://{tmp_path}/b", []
    R.lay_out(spark.range(500), path, "id", 10)
    assert R.run(spark, path, _work(done), each=2, most=2) == 2
    first = list(done)
    with pytest.raises(R.Incomplete):
        R.finish(spark, path)
    R.lay_out(spark.range(9), path, "id", 3)  # the layout stays as it was
    R.run(spark, path, _work(done), each=2)
    assert sorted(done) == list(range(10)) and done[: len(first)] == first
    assert sorted((r.id, r.twice) for r in R.finish(spark, path).collect()) == [(i, 2 * i) for i in range(500)]
    assert R.run(spark, path, _work(done)) == 0


def test_errors_and_a_lost_checkpoint(spark, tmp_path):
    import shutil

    path, done = f"file://{tmp_path}/b", []
    R.lay_out(spark.range(300), path, "id", 6)
    with pytest.raises(StreamingQueryException):
        R.run(spark, path, _work(done, broken={3}), each=1)
    marked = {r.shard for r in R.done_marks(spark, path).collect()}
    assert marked == set(done)
    shutil.rmtree(tmp_path / "b" / "state")
    R.run(spark, path, _work(done), each=1)
    assert sorted(done) == list(range(6))  # marked shards came by again and were passed over
    assert R.finish(spark, path).count() == 300
    shutil.rmtree(tmp_path / "b" / "results" / "shard=4")
    with pytest.raises(R.Incomplete):
        R.finish(spark, path)


def test_a_layout_has_more_shards_where_there_are_more_rows(spark, tmp_path):
    """Each shard is one file of few rows, whatever the number asked for; the build goes through all of them."""
    path = str(tmp_path / "build")
    R.lay_out(spark.range(2000), path, "id", 3, most=100)
    laid = spark.read.parquet(f"{path}/pending").select("id", "shard", F.col("_metadata.file_path").alias("file"))
    sizes = laid.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect()
    assert len(sizes) == 20 and {r.files for r in sizes} == {1} and sum(r.n for r in sizes) == 2000 and max(r.n for r in sizes) < 200
    R.run(spark, path, lambda rows: rows.select("id", "shard"), each=7)
    assert sorted(r.id for r in R.finish(spark, path).collect()) == list(range(2000))
