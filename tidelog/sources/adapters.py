"""Driver tables as operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object user_id, field event_type, op event_id, value."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS object", "event_type AS field", "event_id AS op", "value", "ts", "props")


def events_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds are events that are no errors; an error removes every earlier add of its user and props, each by its last such error."""
    e = table(spark, sf_dir, "events")
    adds = e.where("event_type <> 'error'").selectExpr("user_id AS object", "event_id AS op", "CAST(0 AS BIGINT) AS ref", "event_type AS field", "props", "value")
    errors = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("object"), "props").agg(F.max("event_id").alias("gone"))
    removed = adds.join(errors, ["object", "props"]).where("gone > op").selectExpr("object", "gone AS op", "op AS ref", "field", "props", "value")
    return adds.unionByName(removed)


def events_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event i of a user, from 1 on, hangs below event i div 2 (0: the root)."""
    ranked = table(spark, sf_dir, "events").withColumn("op", F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT)"))
    return ranked.selectExpr("user_id AS object", "op", "op div 2 AS parent", "event_type")


def conversation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn n of a conversation refers to turn n - 1."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS object", "turn + 1 AS op", "turn AS parent", "role", "text")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of types.OPLOG: a frame a user, a chunk a field, and its ops by event id; the replica is the user."""
    name = types.uuid(0, ids.decode60(F.col("field")))
    user, zero = types.uuid(0, F.col("object"), 0, 2, 0), types.uuid()
    head = [types.uuid(0, ids.decode60(F.lit("lww"))).alias("type_id"), user.alias("object_id"), zero.alias("header_op_id"), zero.alias("header_ref_id")]
    x = events_lww(spark, sf_dir).withColumn("chunk_no", F.expr("CAST(ascii(field) * 256 + ascii(substring(field, 2)) AS INT)"))
    x = x.withColumn("op_index", F.expr("CAST(row_number() OVER (PARTITION BY object, field ORDER BY op) - 1 AS INT)"))
    frame = [F.col("object").alias("frame_no"), "chunk_no", F.lit("value").alias("chunk_kind"), *head]
    atom = F.struct(F.lit("float").alias("tag"), F.lit(None).cast("long").alias("i"), F.col("value").alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast(types.UUID).alias("u"))
    body = x.select(*frame, "op_index", types.uuid(0, F.col("op"), 0, 2, F.col("object")).alias("op_id"), name.alias("ref_id"), F.array(atom).alias("payload"))
    heads = x.select("object", "chunk_no").distinct().select(*frame, F.lit(-1).alias("op_index"), zero.alias("op_id"), zero.alias("ref_id"), F.array().cast(types.PAYLOAD).alias("payload"))
    return heads.unionByName(body)
