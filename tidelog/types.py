"""Ids, atoms and the canonical operation log as Spark types.

An id is 128 bits in five non-negative fields whose struct order is the ids'
unsigned order, so max, min and max_by work on it natively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "struct<variety: tinyint, value: bigint, variant: tinyint, version: tinyint, origin: bigint>"
ATOM = f"struct<tag: string, i: bigint, f: double, s: string, u: {UUID}>"
PAYLOAD = f"array<{ATOM}>"
OPLOG = (
    f"frame_no bigint, chunk_no int, chunk_kind string, type_id {UUID}, object_id {UUID}, header_op_id {UUID}, header_ref_id {UUID},"
    f" op_index int, op_id {UUID}, ref_id {UUID}, payload {PAYLOAD}"
)
MASK60 = (1 << 60) - 1


def uuid(variety: Column | int = 0, value: Column | int = 0, variant: Column | int = 0, version: Column | int = 0, origin: Column | int = 0) -> Column:
    """An id from its fields; the zero id means unset."""
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(c(variety, "tinyint").alias("variety"), c(value, "bigint").alias("value"), c(variant, "tinyint").alias("variant"), c(version, "tinyint").alias("version"), c(origin, "bigint").alias("origin"))


def is_zero(u: Column) -> Column:
    return (u["value"] == 0) & (u["origin"] == 0) & (u["variety"] == 0) & (u["variant"] == 0) & (u["version"] == 0)


def is_event(u: Column) -> Column:
    """Whether an id is an event's: variant 0 and version 2 or 3."""
    return (u["variant"] == 0) & u["version"].isin(2, 3)


def part() -> Column:
    """state, patch, op or query, of a log row."""
    return F.when(F.col("chunk_kind") == "query", "query").when(F.col("chunk_kind") == "closed", "op").when(is_zero(F.col("header_ref_id")), "state").otherwise("patch")
