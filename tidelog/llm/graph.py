"""Connected components: every task makes stars of its edges, vertices hang on their smallest parent, and chains are cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written

#: A vertex with fewer edges than this is never dealt to several tasks.
FEW_EDGES = 64
#: Tasks that share the edges of a hub.
SPREAD = 32
#: Edges that a task makes stars of at a time.
CHUNK_EDGES = 1_000_000
#: Vertices whose parents are broadcast; more are joined by a shuffle.
BROADCAST_PARENTS = 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that it reaches) of the vertices of edges, without the smallest ones themselves."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            moved = root != np.arange(len(ids))
            return ids[moved], ids[root[moved]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars (u, v), u the larger, so many edges at a time."""

    def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(t.column(c).to_numpy() for c in ("u", "v")))], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_EDGES:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def _told(e: DataFrame, up: DataFrame, hubs: list[int]) -> DataFrame:
    """e (u, v) with w of up (v, w) where v has one there; edges to hubs are dealt to several tasks, and what hubs have is sent to each."""
    hub = F.col("v").isin(hubs) if hubs else F.lit(False)
    part = F.when(hub, F.pmod(F.xxhash64("u"), F.lit(SPREAD))).otherwise(0).cast("int")
    parts = F.when(hub, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return e.select("u", "v", part.alias("part")).join(up.select("v", "w", F.explode(parts).alias("part")), ["v", "part"], "left").select("u", "v", "w")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of edges (u, v longs) with the smallest vertex that it reaches.

    A task's own edges become stars before they are dealt out, so a vertex
    has a row a chunk at most. Each round hangs a vertex on the smallest of
    its parents, and the other parents below that one, and then on what its
    parent hangs on. Edges to a parent with very many are not dealt by it, or
    to several tasks, so no vertex is a hot task. Null and repeated edges and
    loops are allowed; no edges give no rows.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = written(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v"), "edges")
    while True:
        per = e.select("u", "v").mapInArrow(_stars, "u long, v long").groupBy("u").agg(F.min("v").alias("v"), F.collect_set("v").alias("all"))
        hung = written(per.select("u", "v", F.array_remove("all", F.col("v")).alias("others")), "hung", instead_of=e)
        count = hung.count()
        up = hung.selectExpr("u AS v", "v AS w")
        if count <= BROADCAST_PARENTS:
            near = hung.select("u", "v").join(F.broadcast(up), "v", "left").select("u", "v", "w")
        else:
            many = hung.groupBy("v").count().where(F.col("count") > max(FEW_EDGES, count // parts))
            near = _told(hung.select("u", "v"), up, [r["v"] for r in many.select("v").collect()])  # parts of them at most, since each has count // parts edges
        below = hung.where(F.size("others") > 0).select(F.explode("others").alias("u"), "v", F.lit(True).alias("moved"))
        e = written(near.selectExpr("u", "coalesce(w, v) AS v", "w IS NOT NULL AS moved").union(below), "edges", instead_of=hung)
        if e.where("moved").isEmpty():
            return e.select("u", "v").union(e.selectExpr("v AS u", "v").distinct()).toDF("v", "c")
