"""A reduced state that a stream keeps up and that goes on where it stopped.

States merge in any order, so a batch adds a run: its own reduced rows, and
no more. As soon as FAN runs of one level are last, they are reduced to one of
the next level, so a row is written again as often as there are levels, and
what a batch costs grows with the batch. A commit is a small file named by
the batch's number that tells the runs; a batch that comes again after a
restart is known by it and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidelog.sources import filestore

FAN = 4


class State:
    """A state in a folder that all machines share; one stream writes it, others may read. reduce has the columns of schema and takes its own results."""

    def __init__(self, spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame], schema: StructType, fan: int = FAN):
        self.spark, self.path, self.reduce, self.schema, self.fan = spark, path.rstrip("/"), reduce, schema, fan
        self.at, self.base = filestore.opened(self.path)

    def _commits(self) -> list[str]:
        found = self.at.get_file_info(fs.FileSelector(f"{self.base}/commits", allow_not_found=True))
        return sorted(x.base_name for x in found if x.base_name.isdigit())

    def _told(self, commit: str) -> dict:
        with self.at.open_input_stream(f"{self.base}/commits/{commit}") as f:
            return json.loads(f.read())

    def last(self) -> dict:
        """The last commit: batch, and runs as (name, level)."""
        commits = self._commits()
        return self._told(commits[-1]) if commits else {"batch": -1, "runs": []}

    def _rows(self, runs: list) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/{name}" for name, _ in runs])

    def _run(self, rows: DataFrame, number: int, level: int) -> list:
        name = f"{number:010d}-{uuid.uuid4().hex}"
        self.reduce(rows).write.parquet(f"{self.path}/runs/{name}")
        return [name, level]

    def take(self, batch: DataFrame, number: int) -> bool:
        """Add the batch of that number; False where it, or a later one, is there already."""
        last = self.last()
        if number <= last["batch"]:
            return False
        runs = [*last["runs"], self._run(batch, number, 0)]
        while len(runs) >= self.fan and len({level for _, level in runs[-self.fan :]}) == 1:
            runs[-self.fan :] = [self._run(self._rows(runs[-self.fan :]), number, runs[-1][1] + 1)]
        self.at.create_dir(f"{self.base}/commits", recursive=True)
        filestore.place(self.at, f"{self.base}/commits/{number:010d}", json.dumps({"batch": number, "runs": runs}).encode())
        self._clear()
        return True

    def _clear(self, keep: int = 3) -> None:
        """Drop what only older commits than the last few tell of, and runs of batches up to the last that no commit tells of."""
        commits = self._commits()
        stay = {name for c in commits[-keep:] for name, _ in self._told(c)["runs"]}
        for x in self.at.get_file_info(fs.FileSelector(f"{self.base}/runs", allow_not_found=True)):
            if x.base_name not in stay and not x.base_name.startswith("."):
                self.at.delete_dir(x.path)
        for c in commits[:-keep]:
            self.at.delete_file(f"{self.base}/commits/{c}")

    def read(self) -> DataFrame:
        """The state as of the last commit; empty before the first."""
        runs = self.last()["runs"]
        return self.reduce(self._rows(runs)) if runs else self.spark.createDataFrame([], self.schema)


def kept_up(stream: DataFrame, state: State, place: str, after: Callable[[int], None] | None = None) -> None:
    """Take all that is there of stream into state; place is the stream's checkpoint. after is called with each batch's number once it is in."""

    def step(batch: DataFrame, number: int) -> None:
        state.take(batch, number)
        if after:
            after(number)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
