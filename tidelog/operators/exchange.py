"""An exchange between all peers at once: what each lacks of what any other has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import reducers


def lacking(logs: DataFrame, peers: DataFrame, replica: str = "replica", time: str = "time") -> DataFrame:
    """(to, and the columns of an op) for each peer and op that another peer has beyond what its own vector covers.

    logs: (peer, replica, time, ...), with each replica's ops known to a peer
    up to a time. A replica's vectors are one row of as many times as there
    are peers; every op is read once, beside that row, and goes to the peers
    whose time is before its own or who have none. Peers of peers (peer) that
    hold nothing get all. Of an op that several hold one row goes on.
    """
    rest = [c for c in logs.columns if c not in ("peer", replica, time)]
    ops = logs.groupBy(replica, time).agg(F.max(F.struct(F.lit(0), *rest)).alias("_r"))
    vectors = reducers.version_vector(logs, ["peer"], replica, time).groupBy(replica).agg(F.collect_list(F.struct("peer", F.col(time).alias("upto"))).alias("_known"))
    every = peers.select("peer").unionByName(logs.select("peer")).distinct().agg(F.collect_set("peer").alias("_peers"))
    vectors = vectors.join(F.broadcast(every), F.lit(True))  # one row, an entry a peer
    late = F.transform(F.filter("_known", lambda k: k["upto"] < F.col(time)), lambda k: k["peer"])
    never = F.array_except("_peers", F.transform("_known", lambda k: k["peer"]))
    x = ops.join(vectors, replica).select(F.explode(F.concat(late, never)).alias("to"), replica, time, "_r")
    return x.select("to", replica, time, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def exchanged(logs: DataFrame, peers: DataFrame, replica: str = "replica", time: str = "time") -> DataFrame:
    """logs with what each peer gets from the others."""
    return logs.unionByName(lacking(logs, peers, replica, time).withColumnRenamed("to", "peer").select(*logs.columns))
