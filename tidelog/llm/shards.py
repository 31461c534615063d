"""Sharded storage with size-tiered compaction and a versioned manifest.

Every append writes its arrivals as a run: a folder of small immutable
files. Runs of similar size (one tier: sizes within a factor FAN_IN) are
merged, as soon as FAN_IN of them are there, into a run of target-sized
files. A manifest lists the live runs; a version is one file, written aside
and then published under its number in one step that refuses a number that
is taken. A writer that comes too late reads what the other did and tries
again. Readers use the runs of one version, so they see all of a merge or
nothing of it. There are at most FAN_IN - 1 runs a tier, so the manifest
grows with the logarithm of the data.

Only DataFrame functions and the file system's own operations run.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, fresh, shared_dir

FAN_IN = 4
TARGET_BYTES = 64 << 20
SMALLEST = 64 << 10
#: Versions that vacuum() leaves readable, and the age in seconds from which a run that none of them lists is no writer's work in hand.
KEEP_VERSIONS, KEEP_SECONDS = 8, 86_400
#: How often a writer tries again when others were first.
TRIES = 50
#: File systems whose rename copies, or replaces what is there: they need a commit service instead.
NOT_ATOMIC = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "swift")


class Shards:
    """A store of rows under path, for any number of readers and writers."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target, fan_in

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:08d}"

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def runs(self, version: int | None = None) -> list[dict]:
        """The live runs of a version, the newest if None; KeyError if there is no such version."""
        versions = self.versions()
        if version is None and not versions:
            return []
        version = versions[-1] if version is None else version
        if version not in versions:
            raise KeyError(f"no version {version}, it may have been vacuumed: there are {versions}")
        fs, p = self._fs(self._manifest(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, ready: str, target: str) -> None:
        """Give a finished file its name in one step; FileExistsError if that is taken, whenever it was."""
        fs, source = self._fs(ready)
        scheme = fs.getScheme()
        if scheme in NOT_ATOMIC:
            raise ValueError(f"{scheme} has no rename that refuses an existing target")
        jvm, to = self.spark._jvm, self._fs(target)[1]
        try:
            if scheme == "file":  # rename would replace what is there, a second link cannot
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(to), local(source))
                fs.delete(source, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(source, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(to):
                raise FileExistsError(f"{target} was published by another writer") from None
            raise

    def commit(self, runs: list[dict], after: int) -> int:
        """Make runs version after + 1; FileExistsError if another writer did."""
        ready = f"{self.path}/pending/{uuid.uuid4().hex}"
        fs, p = self._fs(ready)
        for folder in (p.getParent(), self._fs(self._manifest(1))[1].getParent()):
            fs.mkdirs(folder)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(runs).encode()))
        finally:
            out.close()
        try:
            self.publish(ready, self._manifest(after + 1))
        except FileExistsError:
            fs.delete(p, False)
            raise
        return after + 1

    def _changed(self, change: Callable[[list[dict]], list[dict] | None]) -> int | None:
        """Commit what change makes of the newest runs, again from the start if another writer was first; None if it makes None."""
        for _ in range(TRIES):
            at = (self.versions() or [0])[-1]
            after = change(self.runs(at) if at else [])
            if after is None:
                return None
            try:
                return self.commit(after, at)
            except FileExistsError:
                continue
        raise TimeoutError(f"other writers were first {TRIES} times")

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, SMALLEST) / SMALLEST, self.fan_in)))

    def _stated(self, folder: str, schema, below: str | None = None) -> list[dict]:
        """A run for each sub-folder below=... of a written folder, or for the folder itself; without those that have no rows."""
        path = F.regexp_extract("_metadata.file_path", f"({below}=[^/]*)/[^/]*$" if below else "()", 1)
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        files = reader.parquet(f"{self.path}/data/{folder}").groupBy(path.alias("part"), "_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("rows"))
        found = files.groupBy("part").agg(F.sum("file_size").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("files")).where("rows > 0").orderBy("part").collect()
        return [{"run": f"{folder}/{r['part']}".rstrip("/"), "bytes": r["bytes"], "rows": r["rows"], "files": r["files"], "tier": self.tier(r["bytes"])} for r in found]

    def written(self, df: DataFrame, wave: Column | None = None) -> list[dict]:
        """df's rows as one run for each wave (one if None), written in one pass and not committed."""
        folder = uuid.uuid4().hex
        below = None if wave is None else fresh(df, "wave")
        if below:
            df.withColumn(below, wave).write.partitionBy(below).parquet(f"{self.path}/data/{folder}")
        else:
            df.write.parquet(f"{self.path}/data/{folder}")
        return self._stated(folder, df.schema, below)

    def adopt(self, run: dict) -> int:
        """Commit a written run; its version."""
        return self._changed(lambda runs: [*runs, run])

    def append(self, df: DataFrame) -> int | None:
        """Commit df's rows as a new run; its version, or None if df is empty."""
        new = self.written(df)
        return self.adopt(new[0]) if new else None

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if None."""
        paths = [f"{self.path}/data/{r['run']}" for r in self.runs(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _full(self, runs: list[dict]) -> tuple[int, list[dict]] | None:
        """The lowest tier with enough runs for a merge, and its runs."""
        tiers: dict[int, list[dict]] = {}
        for r in sorted(runs, key=lambda r: r["bytes"]):
            tiers.setdefault(r["tier"], []).append(r)
        return next(((t, tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)

    def compact(self, schema) -> int:
        """Merge full tiers until none is left; how many merges were committed.

        A merge whose runs another writer took out meanwhile is given up, and
        its files go with the next vacuum.
        """
        merges = 0
        while (full := self._full(self.runs())) is not None:
            tier, old = full
            gone = {r["run"] for r in old}
            rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{r['run']}" for r in old])
            parts = max(1, math.ceil(sum(r["bytes"] for r in old) / self.target))
            (new,) = self.written(rows.coalesce(parts))
            new["tier"] = max(new["tier"], tier + 1)  # a merge always climbs, however well it compresses

            def merged(runs: list[dict]) -> list[dict] | None:
                rest = [r for r in runs if r["run"] not in gone]
                return [*rest, new] if len(runs) - len(rest) == len(gone) else None

            merges += self._changed(merged) is not None
        return merges

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, keep_seconds: float = KEEP_SECONDS) -> list[str]:
        """Drop all but the last versions, and the files that no version left lists and that are older than keep_seconds; the runs removed.

        Younger files may be a run that a writer has not committed yet.
        """
        versions = self.versions()
        for v in versions[: max(0, len(versions) - max(1, keep_versions))]:
            fs, p = self._fs(self._manifest(v))
            fs.delete(p, False)
        live = {r["run"] for v in self.versions() for r in self.runs(v)}
        fs, p = self._fs(f"{self.path}/data")
        limit, removed = (time.time() - keep_seconds) * 1000, []
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            name = folder.getPath().getName()
            inside = [s for s in fs.listStatus(folder.getPath()) if s.isDirectory() and "=" in s.getPath().getName()]
            runs = {f"{name}/{s.getPath().getName()}": s for s in inside} or {name: folder}
            for run, s in runs.items():
                if run not in live and s.getModificationTime() < limit:
                    fs.delete(s.getPath(), True)
                    removed.append(run)
        return removed


WAVES = 8


def loaded(df: DataFrame, store: Shards, id: str = "doc_id", waves: int = WAVES) -> DataFrame:
    """All rows of df, brought into store in waves of arrivals with compaction after each, and read back.

    Every row belongs to one wave by a hash of its id; null ids are spread by
    a hash of the whole row. All waves are dealt in one write; each is then
    committed as an append of its own. Rows keep all columns, nulls and
    repetitions; an empty table leaves the store as it is.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    wave = F.pmod(F.when(F.col(f"`{id}`").isNull(), whole).otherwise(F.xxhash64(F.col(f"`{id}`"))), F.lit(waves))
    for run in store.written(df, wave):
        store.adopt(run)
        store.compact(df.schema)
    store.vacuum()
    return store.read(df.schema)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_bytes, text_sha256 of every document, read back from the compacted store."""
    docs = documents(spark, sf_dir)
    x = loaded(docs, Shards(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"))
    return x.selectExpr("doc_id", "lang", "source", "CAST(octet_length(text) AS BIGINT) AS n_bytes", "sha2(text, 256) AS text_sha256")


ORACLE_SQL = "SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
