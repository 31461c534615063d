"""Stores that are folders of small text files: op logs of objects, and versions of documents.

    <path>/<object>/log/<patch>              an open frame a patch
    <path>/<collection>/<document>/<version>  a frame of states a version

Names of objects, patches and documents are ids as file names. Names are
listed as a table that spreads over the cluster; which files are opened is
decided from these alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ids
from tidelog.operators import reducers
from tidelog.shared import shared_dir
from tidelog.sources import filestore, frames, text

LOG = ("object", "log", "patch")
DOCUMENTS = ("collection", "document", "version")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(object_id) of the objects with a log."""
    return filestore.listed(spark, path, LOG).select(ids.from_file_name(F.col("object")).alias("object_id")).where("object_id IS NOT NULL").distinct()


def append_patches(ops: DataFrame, path: str) -> None:
    """Write rows (object_id, patch_id, op_index, op_id, ref_id, payload) as a file a patch; a patch that is there already is written again."""
    named = ops.withColumn("object", ids.file_name(F.col("object_id"))).withColumn("patch", ids.file_name(F.col("patch_id")))
    filestore.saved(frames.open_text(named, ["object", "patch"]), path, LOG)


def load_log(spark: SparkSession, path: str, version: DataFrame | None = None) -> DataFrame:
    """(object_id, patch_id, op_index, op_id, ref_id, payload, error) of the patches that version does not cover.

    version: (replica, time), a vector of clock values by origin; files whose
    names it covers are not opened, and then ops are skipped one by one.
    Files whose names are no ids have no rows.
    """
    files = filestore.listed(spark, path, LOG).select(ids.from_file_name(F.col("object")).alias("object_id"), ids.from_file_name(F.col("patch")).alias("patch_id"), "file")
    files = files.where("object_id IS NOT NULL AND patch_id IS NOT NULL")
    if version is not None:
        files = reducers.newer(files.withColumn("replica", F.col("patch_id.origin")).withColumn("time", F.col("patch_id.value")), version, [], "replica", "time").drop("replica", "time")
    texts = filestore.contents(files, path).select("object_id", "patch_id", F.decode("content", "UTF-8").alias("text"))
    ops = text.parsed_open(texts, keep=["object_id", "patch_id"])
    if version is None:
        return ops
    return reducers.newer(ops.withColumn("replica", F.col("op_id.origin")).withColumn("time", F.col("op_id.value")), version, [], "replica", "time").drop("replica", "time")


def save_versions(states: DataFrame, path: str, collection: str) -> None:
    """Write log rows with the columns document_id and version (text) as a frame of states a version; checkpointed, since writing reads them several times."""
    shared_dir(states.sparkSession)
    named = states.withColumn("document", ids.file_name(F.col("document_id"))).withColumn("collection", F.lit(collection)).checkpoint()
    filestore.saved(frames.states_text(frames.state_frame(named, ["collection", "document", "version"]), ["collection", "document", "version"]), path, DOCUMENTS)


def versions(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """(document_id, version, valid): the saved versions, and whether the document's name is just how its id is written."""
    x = filestore.listed(spark, path, DOCUMENTS).where(F.col("collection") == collection)
    return x.select(ids.from_file_name(F.col("document")).alias("document_id"), "version", ids.is_file_name(F.col("document")).alias("valid"))


def load_versions(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Log rows with document_id and version of all versions of documents with valid names; a broken version is a row with its error."""
    x = filestore.listed(spark, path, DOCUMENTS).where((F.col("collection") == collection) & ids.is_file_name(F.col("document")))
    texts = filestore.contents(x, path).select("document", "version", F.decode("content", "UTF-8").alias("text"))
    return text.parsed_log(texts, keep=["document", "version"]).withColumn("document_id", ids.from_file_name(F.col("document"))).drop("document")


def collections(spark: SparkSession, path: str) -> DataFrame:
    """(collection) of the collections that have a version of a document."""
    return filestore.listed(spark, path, DOCUMENTS).select("collection").distinct()


def updates(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A stream of the names of files as they arrive; its checkpoint holds which have been told, so a restart tells the others. No file is opened.

    Tasks list the folders, and the names told before are state that is dealt
    over the cluster: the driver holds no name, however many files there are.
    """
    return filestore.arriving(spark, path, names)
