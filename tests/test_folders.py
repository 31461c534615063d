"""Folder stores: names as they are told, files opened only where their names say so, files whole or not at all, updates after a restart."""

import os

import pytest

from tidelog import types
from tidelog.functions import ids
from tidelog.sources import filestore, folders
from pyspark.sql import functions as F

ODD = ["a:b", "x=1", "50%", "a/b", ".hidden", "_x", "ü 1", "a%2Fb", "..", "v.1", "A~-", "\n"]


def test_names_are_spelled_and_read():
    for name in ODD:
        assert filestore.read_name(filestore.spelled(name)) == name
        assert not set(filestore.spelled(name)) & set("/:=\n ") and filestore.spelled(name)[0] not in "._"
    assert filestore.read_name("50%") == "50%" and filestore.read_name("x=1") == "x=1"


def test_odd_names_survive(spark, tmp_path):
    path = f"{tmp_path}/part=1/store"
    rows = spark.createDataFrame([("c", f"d{i % 3}", v, f"text {v}") for i, v in enumerate(ODD)], "collection string, document string, version string, text string").repartition(4)
    filestore.saved(rows, path, folders.DOCUMENTS)
    got = filestore.contents(filestore.listed(spark, path, folders.DOCUMENTS), path).collect()
    assert {r["version"]: r["content"].decode() for r in got} == {v: f"text {v}" for v in ODD}
    assert {c for r in got for c in r.asDict()} == {"collection", "document", "version", "file", "content"}
    filestore.saved(rows.withColumn("text", F.lit("again")), path, folders.DOCUMENTS)
    assert {r["content"] for r in filestore.contents(filestore.listed(spark, path, folders.DOCUMENTS), path).collect()} == {b"again"}
    assert not [f for _, _, files in os.walk(path) for f in files if f.startswith(".")]
    assert filestore.listed(spark, f"{tmp_path}/none", folders.LOG).collect() == []
    filestore.saved(rows.limit(0), f"{tmp_path}/empty", folders.DOCUMENTS)
    assert filestore.listed(spark, f"{tmp_path}/empty", folders.DOCUMENTS).collect() == []


def patches(spark, rows):
    ops = spark.createDataFrame(rows, "object long, patch long, n int, op long")
    u = lambda c: types.uuid(0, F.col(c), 0, 2, 5)
    none = lambda t: F.lit(None).cast(t)
    atom = F.struct(F.lit("integer").alias("tag"), F.col("op").alias("i"), none("double").alias("f"), none("string").alias("s"), none(types.UUID).alias("u"))
    return ops.select(u("object").alias("object_id"), u("patch").alias("patch_id"), F.col("n").alias("op_index"), u("op").alias("op_id"), u("object").alias("ref_id"), F.array(atom).alias("payload"))


def told(log):
    return sorted(r["payload"][0]["i"] for r in log.collect() if r["error"] is None)


def test_covered_files_are_not_opened(spark, tmp_path):
    path = str(tmp_path)
    folders.append_patches(patches(spark, [(1, 12, 0, 11), (1, 12, 1, 12), (1, 15, 0, 14), (1, 15, 1, 15), (2, 30, 0, 30)]), path)
    seen = spark.createDataFrame([(5, 14)], "replica long, time long")
    assert told(folders.load_log(spark, path)) == [11, 12, 14, 15, 30]
    covered = next(r["file"] for r in filestore.listed(spark, path, folders.LOG).withColumn("p", ids.from_file_name(F.col("patch"))).where("p.value = 12").collect())
    os.remove(covered)
    os.symlink("/proc/self/mem", covered)  # a file that cannot be read
    assert told(folders.load_log(spark, path, seen)) == [15, 30]
    with pytest.raises(Exception, match="(?i)error|errno"):
        folders.load_log(spark, path).collect()
    os.remove(covered)
    assert told(folders.load_log(spark, path)) == [14, 15, 30]


def test_only_asked_folders_are_listed(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(c, "d", "v", c) for c in "abc"], "collection string, document string, version string, text string")
    filestore.saved(rows, path, folders.DOCUMENTS)
    assert sorted(r[0] for r in folders.collections(spark, path).collect()) == list("abc")
    x = filestore.listed(spark, path, folders.DOCUMENTS)
    assert [r["version"] for r in x.where("collection = 'b'").collect()] == ["v"]
    reader = filestore.FolderReader(path, list(folders.DOCUMENTS))
    list(reader.pushFilters([filestore.EqualTo(("collection",), "b")]))
    assert [p.names for p in reader.partitions()] == [["b"]]
    assert [x["collection"] for x in x.where("collection IN ('a', 'c')").orderBy("collection").collect()] == ["a", "c"]


def test_a_failed_write_leaves_no_part_of_a_file(spark, tmp_path):
    at, _ = filestore.opened(str(tmp_path))
    os.makedirs(f"{tmp_path}/d/name")
    open(f"{tmp_path}/d/name/x", "w").close()
    with pytest.raises(OSError):
        filestore.place(at, f"{tmp_path}/d/name", b"text")  # a folder that is not empty stands there
    assert os.listdir(f"{tmp_path}/d") == ["name"]


def test_updates_go_on_after_a_restart(spark, tmp_path):
    path, place = f"{tmp_path}/store", f"{tmp_path}/place"

    def run():
        got = []
        q = folders.updates(spark, path, folders.LOG).writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(lambda x, n: got.extend(map(tuple, x.collect()))).start()
        q.awaitTermination()
        return sorted(got)

    name = lambda v: spark.range(1).select(ids.file_name(types.uuid(0, F.lit(v), 0, 2, 5))).first()[0]
    folders.append_patches(patches(spark, [(1, 12, 0, 11), (2, 13, 0, 13)]), path)
    assert run() == sorted([(name(1), name(12)), (name(2), name(13))])
    assert run() == []
    folders.append_patches(patches(spark, [(1, 15, 0, 14)]), path)
    assert run() == [(name(1), name(15))]


def test_many_updates_take_few_tasks(spark, tmp_path):
    """A turn's tasks do not grow with its files."""
    path, place, got, parts = f"{tmp_path}/store", f"{tmp_path}/place", [], []
    folders.append_patches(patches(spark, [(i % 50, 1000 + i, 0, i) for i in range(300)]), path)

    def told(x, n):
        parts.append(x.rdd.getNumPartitions())
        got.extend(map(tuple, x.collect()))

    q = folders.updates(spark, path, folders.LOG).writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(told).start()
    q.awaitTermination()
    tracker, cores = spark.sparkContext.statusTracker(), spark.sparkContext.defaultParallelism
    stages = [i for j in tracker.getJobIdsForGroup(str(q.runId)) for i in tracker.getJobInfo(j).stageIds]
    assert len(got) == len(set(got)) == 300 and parts == [cores]
    assert stages and max(tracker.getStageInfo(i).numTasks for i in stages) <= 4 * cores
