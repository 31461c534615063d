"""Further registered queries: list order through frames, large lists edited, dumps in order, updates of a folder store."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids, parsing
from tidelog.operators import edits, exchange, frames as reduction, lists, reducers, stores
from tidelog.plans.catalog import ORACLE_SQL, query
from tidelog.plans.codecs_catalog import _event_ops
from tidelog.shared import kept, shared_dir
from tidelog.sources import adapters, folders, frames, text
from tidelog.streaming import live, states

#: SQL: every user's events as a list: event n stands after event n div 2. Of every seventh user the second event, which others stand after, never comes. An error removes the event at a third of its place.
_LIST = """
    e AS (SELECT user_id AS object, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS op, event_type, value FROM events),
    s AS (SELECT * FROM e WHERE NOT (object % 7 = 0 AND op = 2)),
    gone AS (SELECT object, op // 3 AS target, max(1000000 + op) AS tombstone FROM e WHERE event_type = 'error' AND op >= 3 GROUP BY ALL),
    t AS (SELECT object, op, value, op // 2 AS root, [-op] AS path FROM s WHERE op = 1 OR (object % 7 = 0 AND op // 2 = 2) UNION ALL
          SELECT s.object, s.op, s.value, t.root, list_append(t.path, -s.op) FROM s JOIN t ON s.object = t.object AND s.op // 2 = t.op)"""


@query(f"""
    WITH RECURSIVE {_LIST}
    SELECT t.object, root AS ref, op, coalesce(tombstone, 0) AS gone, value, row_number() OVER (PARTITION BY t.object, root ORDER BY path) - 1 AS pos FROM t LEFT JOIN gone ON gone.object = t.object AND target = op
    UNION ALL SELECT gone.object, target, 0, tombstone, NULL, NULL FROM gone WHERE object % 7 = 0 AND target = 2
""")
def frame_reduce_lists(spark, sf_dir):
    """Lists whose order is not that of their ids, from states, patches, raw inserts and removals, some of which wait; reduced, written, read again and seen in order."""
    shared_dir(spark)  # checkpoints need one
    none = lambda t: F.lit(None).cast(t)
    u = lambda c: types.uuid(0, c, 0, 2, F.when(c == 0, 0).otherwise(9))
    n = F.expr("row_number() OVER (PARTITION BY object ORDER BY op)").cast("long")
    e = adapters.events_lww(spark, sf_dir).withColumn("n", n).checkpoint()
    real = F.array(F.struct(F.lit("float").alias("tag"), none("bigint").alias("i"), F.col("value").alias("f"), none("string").alias("s"), none(types.UUID).alias("u")))
    empty, zero = F.array().cast(types.PAYLOAD), types.uuid()

    def rows(x, kind, header, index, op, ref, payload):
        return x.select(
            F.col("object").alias("frame_no"), F.col("n").cast("int").alias("chunk_no"), F.lit(kind).alias("chunk_kind"), types.uuid(0, ids.decode60(F.lit("rga"))).alias("type_id"), types.uuid(0, F.col("object"), 0, 2, 3).alias("object_id"),
            zero.alias("header_op_id"), header.alias("header_ref_id"), index.cast("int").alias("op_index"), op.alias("op_id"), ref.alias("ref_id"), payload.alias("payload"),
        )

    sent, parent = e.where("NOT (object % 7 = 0 AND n = 2)"), F.expr("n div 2")
    first = sent.where("n <= 3").withColumn("place", F.when(F.col("n") == 2, 2).otherwise(F.floor(F.col("n") / 2)))  # the order of the first three: 1, 3, 2
    states = rows(first.withColumn("own", F.col("n")).withColumn("n", F.lit(0)), "value", zero, F.col("place"), u(F.col("own")), zero, real)
    patches = rows(sent.where("n > 3 AND n % 4 = 1"), "value", u(parent), F.lit(0), u(F.col("n")), zero, real)
    raw = rows(sent.where("n > 3 AND n % 4 <> 1"), "closed", zero, F.lit(0), u(F.col("n")), u(parent), real)
    gone = rows(e.where("field = 'error' AND n >= 3"), "closed", zero, F.lit(0), u(1_000_000 + F.col("n")), u(F.expr("n div 3")), empty)
    log = states.unionByName(patches).unionByName(raw).unionByName(gone.withColumn("chunk_no", F.col("chunk_no") + 1_000_000))
    said = frames.delta_coded(reduction.reduce_log(log).checkpoint(), ["frame"], width=64)
    again, waiting = lists.reduced(*lists.from_log(text.parsed_log(said).where("error IS NULL").checkpoint()))
    value = lambda c: ids.from_sortable(F.col(c))["value"].alias(c)
    placed = again.select(value("object"), value("ref"), value("op"), value("gone"), F.col("payload")[0]["f"].alias("value"), F.col("pos").cast("long").alias("pos"))
    left = waiting.select(value("object"), value("target"), F.lit(0).cast("long").alias("op"), value("tombstone"), none("double").alias("value"), none("bigint").alias("pos")).toDF(*placed.columns)
    return placed.unionByName(left)


_LINES = "SELECT CAST(ascii(lang) * 256 + ascii(substr(lang, 2)) AS BIGINT) AS object, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE lang IS NOT NULL"


@query(f"""
    SELECT object, row_number() OVER (PARTITION BY object ORDER BY source = 'src3', doc_id, i) - 1 AS pos, replace(line, 'an', 'AN') AS value FROM ({_LINES}) WHERE line <> ''
""")
def corpus_edit(spark, sf_dir):
    """All lines of a language are one list, edited by differences: lines changed, empty ones removed, one source's moved to the end; the ops are applied and read back."""
    docs = adapters.table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    lines = docs.selectExpr("CAST(ascii(lang) * 256 + ascii(substring(lang, 2)) AS BIGINT) AS object", "doc_id", "source", "posexplode(split(text, '\n')) AS (i, value)")
    current = lines.select("object", F.struct("doc_id", "i").alias("pos"), (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("op"), "value")
    wanted = lines.where("value <> ''").select("object", F.struct(F.coalesce(F.col("source") == "src3", F.lit(False)).alias("moved"), "doc_id", "i").alias("pos"), F.replace("value", F.lit("an"), F.lit("AN")).alias("value"))
    ops = kept(lists.edited(current, wanted, F.lit(1 << 50).cast("long")))
    zero = F.lit(0).cast("long")
    states = current.select("object", zero.alias("chunk"), zero.alias("ref"), (F.col("op") - 1).alias("pos"), "op", zero.alias("gone"), F.col("value").alias("payload"))
    inserts = ops.where("value IS NOT NULL").select("object", F.col("op").alias("chunk"), "ref", zero.alias("pos"), "op", zero.alias("gone"), F.col("value").alias("payload"))
    held = states.unionByName(inserts)
    rows, _ = lists.placed(held, ops.where("value IS NULL").selectExpr("object", "ref AS target", "op AS tombstone"), 0)
    alive = stores.scans.numbered(rows.where("gone = 0").select("object", "op", F.col("pos").alias("place")), ["object"], ["place"], "n")  # texts are moved once their places are known
    return alive.join(lists.payloads(held), ["object", "op"]).select("object", F.col("n").alias("pos"), F.col("payload").alias("value"))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS line, user_id AS object, event_id AS op, event_type AS field FROM events")
def log_dump(spark, sf_dir):
    """The whole log in the order of its times, each op with its line."""
    log = adapters.events_lww(spark, sf_dir).select("ts", "op", "object", "field")
    return stores.dumped(log, ["ts", "op"]).select("line", "object", "op", "field")


@query("SELECT user_id AS object, max(event_id) AS patch FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS part FROM events) GROUP BY user_id, part")
def folder_updates(spark, sf_dir):
    """Patches that come to a folder store in two turns, told by a stream that stops after each and goes on from its checkpoint."""
    base = f"{shared_dir(spark)}/updates-{uuid.uuid4().hex}"
    ops = _event_ops(spark, sf_dir).withColumn("patch_id", F.max("op_id").over(Window.partitionBy("object", F.floor(F.col("op_index") / 50))))
    ops = ops.withColumn("object_id", types.uuid(0, F.col("object"), 0, 2, 7))

    def told(x, n):
        x.write.mode("overwrite").parquet(f"{base}/told/turn={n}")  # a turn that is done again replaces itself

    for some in ("op_index < 50", "op_index >= 50"):
        folders.append_patches(ops.where(some), f"{base}/store")
        found = folders.updates(spark, f"{base}/store", folders.LOG)
        found.writeStream.option("checkpointLocation", f"{base}/place").trigger(availableNow=True).foreachBatch(told).start().awaitTermination()
    x = spark.read.schema("object string, patch string").parquet(f"{base}/told")
    return x.select(ids.from_file_name(F.col("object"))["value"].alias("object"), ids.from_file_name(F.col("patch"))["value"].alias("patch"))


@query("SELECT user_id AS object, event_id AS op, event_type AS field FROM events")
def open_parts(spark, sf_dir):
    """Every user's ops as open frames of sixteen at most, parsed again."""
    made = frames.open_text(_event_ops(spark, sf_dir), ["object"], width=16)
    got = text.parsed_open(made, keep=["object"]).where("error IS NULL")
    return got.select("object", F.col("op_id.value").alias("op"), F.col("payload")[0]["s"].alias("field"))


@query(ORACLE_SQL["lww_reduce"])
def stream_restart(spark, sf_dir):
    """The users' fields kept up from a stream of six files that stops after its third batch and goes on from its checkpoint."""
    base = f"{shared_dir(spark)}/restart-{uuid.uuid4().hex}"
    events = adapters.table(spark, sf_dir, "events")
    events.repartition(6, "event_id").write.parquet(f"{base}/in/events.parquet")
    reduce = lambda x: reducers.lww(x, ["object", "field"], "op", ["value"])
    log = adapters.events_lww(spark, sf_dir).select("object", "field", "op", "value")
    state = states.State(spark, f"{base}/state", reduce, reduce(log).schema)
    stream = live.source(spark, f"{base}/in", "events", events.schema).selectExpr("user_id AS object", "event_type AS field", "event_id AS op", "value")

    def stop(number: int) -> None:
        if number == 2:
            raise InterruptedError("stopped")

    try:
        states.kept_up(stream, state, f"{base}/place", stop)
    except Exception as e:
        if "stopped" not in str(e):
            raise
    states.kept_up(stream, state, f"{base}/place")
    return state.read()


@query("""
    WITH p AS (SELECT unnest(range(0, 5)) AS peer), e AS (SELECT event_id, user_id % 5 AS replica, event_type, max(event_id) OVER () AS most FROM events),
    held AS (SELECT peer, e.* FROM e, p WHERE peer < 4 AND event_id * 100 <= most * ((peer * 37 + replica * 53) % 101)), v AS (SELECT peer, replica, max(event_id) AS upto FROM held GROUP BY ALL)
    SELECT p.peer AS peer, h.replica, event_id AS op, event_type AS field FROM (SELECT DISTINCT event_id, replica, event_type FROM held) h CROSS JOIN p LEFT JOIN v ON v.peer = p.peer AND v.replica = h.replica WHERE upto IS NULL OR event_id > upto
""")
def peer_exchange(spark, sf_dir):
    """Four peers with different parts of five replicas' logs, and one with nothing, get what they lack from each other."""
    e = adapters.table(spark, sf_dir, "events")
    most = e.agg(F.max("event_id")).first()[0] or 0
    rows = e.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("peer"), (F.col("user_id") % 5).alias("replica"), F.col("event_id").alias("time"), F.col("event_type").alias("field"))
    held = rows.where(F.col("time") * 100 <= most * ((F.col("peer") * 37 + F.col("replica") * 53) % 101))
    return exchange.lacking(held, spark.range(5).toDF("peer")).withColumnRenamed("time", "op").withColumnRenamed("to", "peer")


@query("""
    SELECT event_id, event_id AS op, user_id AS ref, event_type AS said, event_id * 64 AS after, (event_id + 1) % 1048576 * 1099511627776 + user_id * 77 AS name, event_id & 1152921504606846975 AS low FROM events
""")
def open_op_pieces(spark, sf_dir):
    """Open ops written one by one and read, ids after the id before them, values of file names, and the low sixty bits of longer numbers."""
    none = lambda t: F.lit(None).cast(t)
    u = lambda c: types.uuid(0, c, 0, 2, 5)
    atom = F.struct(F.lit("string").alias("tag"), none("bigint").alias("i"), none("double").alias("f"), F.col("event_type").alias("s"), none(types.UUID).alias("u"))
    v = (F.col("event_id") + 1) % 1048576 * 1099511627776 + F.col("user_id") * 77
    said = F.concat(frames.op_text(u(F.col("event_id")), u(F.col("user_id")), F.array(atom)), F.lit(";"))
    x = adapters.table(spark, sf_dir, "events").select("event_id", said.alias("said"), u(F.col("event_id")).alias("before"), ids.uuid_text(u(F.col("event_id") * 64)).alias("after"), ids.encode60_base32(v).alias("name"))
    x = x.select("event_id", parsing.parse_open_op(F.col("said")).alias("o"), parsing.parse_uuid_atom(F.col("before"), F.col("after")).alias("a"), ids.decode60_base32(F.col("name")).alias("name"), ids.least_significant60(F.col("event_id").bitwiseOR(F.lit(5 << 60))).alias("low"))
    return x.select("event_id", F.col("o.op_id.value").alias("op"), F.col("o.ref_id.value").alias("ref"), F.col("o.payload")[0]["s"].alias("said"), F.col("a.value").alias("after"), "name", "low")


@query("""
    WITH e AS (SELECT user_id AS object, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS op, event_type FROM events)
    SELECT object, 1000000 + row_number() OVER (PARTITION BY object ORDER BY op) AS op, op AS parent FROM e WHERE event_type = 'error'
""")
def tree_removals(spark, sf_dir):
    """Every error is removed from its user's tree by an empty child of its own."""
    tree = adapters.events_tree(spark, sf_dir)
    return edits.tree_removed(tree, F.col("event_type") == "error", F.lit(1_000_000).cast("long"), ["object"]).select("object", "op", "parent")


@query("SELECT user_id AS object, event_id AS op, value FROM events")
def typed_rows(spark, sf_dir):
    """Rows tagged with a type and read as that type; one of another would fail the job."""
    rows = reduction.as_type(adapters.events_log(spark, sf_dir).where("op_index >= 0").drop("type_id"), "lww")
    return reduction.typed(rows, "lww").select(F.col("object_id.value").alias("object"), F.col("op_id.value").alias("op"), F.get("payload", F.lit(0))["f"].alias("value"))
