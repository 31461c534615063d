"""What the training-data operators share: inputs, the shared folder and its intermediate tables, safe carrying of rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from tidelog.shared import shuffles_dropped

#: ASCII white space between words.
SPACES = " \t\n\x0b\x0c\r"
#: Paths of the tables that written() made, by table; folders open for deletion, by scratch() block; folders for the process's end.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_blocks: list[list[str]] = []
_at_end: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; a temporary folder is set
    only where that is unset and all runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None, beyond: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and its shuffle files go.

    The table goes when the scratch() block around it ends well, else at the
    end of the process; instead_of, a table written before that nothing will
    read again, goes at once; a table beyond its block belongs to the block
    around that. What a failed run wrote stays for recovery.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    (_blocks[-1 - beyond] if len(_blocks) > beyond else _at_end).append(path)
    if instead_of is not None and instead_of in _paths:
        drop_folders([_paths.pop(instead_of)])
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() makes inside are deleted when the block ends well; what is read from them must be written by then."""
    _blocks.append([])
    try:
        yield
    except BaseException:
        _blocks.pop()
        raise
    drop_folders(_blocks.pop())


def drop_folders(paths: list[str]) -> None:
    """Delete folders of the shared folder; what is not there does no harm."""
    jvm, conf = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None or conf is None:
        return
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        drop_folders(_at_end)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
