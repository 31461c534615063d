"""Registered queries over the driver tables, with the same results in SQL.

Every query reads its whole tables and returns plain columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids, times
from tidelog.operators import documents, edits, lists, reducers, schema, sequences, stores, views
from tidelog.shared import shared_dir
from tidelog.sources import adapters, binary, frames, text
from tidelog.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, and its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KINDS = ("click", "error", "purchase", "signup", "view")
_ADDS = "SELECT a.user_id, a.event_id, a.event_type, a.props, a.value, max(e.event_id) AS gone FROM events a LEFT JOIN events e ON e.event_type = 'error' AND e.user_id = a.user_id AND e.props = a.props AND e.event_id > a.event_id WHERE a.event_type <> 'error' GROUP BY ALL"
_ALIVE = f"SELECT * FROM ({_ADDS}) WHERE gone IS NULL"


@query("SELECT user_id AS object, event_type AS field, max(event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def lww_reduce(spark, sf_dir):
    return reducers.lww(adapters.events_lww(spark, sf_dir), ["object", "field"], "op", ["value"])


@query("SELECT user_id AS object, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def lww_struct_view(spark, sf_dir):
    return views.struct_view(adapters.events_lww(spark, sf_dir), "object", "field", "value", "op", dict.fromkeys(KINDS, "lww"))


@query("SELECT user_id AS object, min(event_id) AS patch_ref, count(DISTINCT event_type) AS fields FROM events GROUP BY user_id")
def lww_patch_ref(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir)
    fields = reducers.lww(log, ["object", "field"], "op", []).groupBy("object").agg(F.count("*").alias("fields"))
    return log.groupBy("object").agg(F.min("op").alias("patch_ref")).join(fields, "object")


@query("""
    SELECT object, field, op, value, CASE WHEN has_state THEN 'state' ELSE 'patch' END AS kind, CASE WHEN has_state THEN 0 ELSE first END AS patch_ref FROM
        (SELECT user_id AS object, event_type AS field, max(event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY ALL) f
        JOIN (SELECT user_id, bool_or(event_id % 90 = 0) AS has_state, min(event_id) AS first FROM events GROUP BY user_id) k ON f.object = k.user_id
""")
def wire_parts(spark, sf_dir):
    part = F.when(F.col("op") % 90 == 0, "state").when(F.col("op") % 3 == 1, "patch").otherwise("op")
    return reducers.wire_parts(adapters.events_lww(spark, sf_dir).withColumn("part", part), ["object"], "part", "field", "op", ["value"])


@query("""
    WITH a AS (SELECT user_id, event_type, max(event_id) AS op, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
         b AS (SELECT user_id, event_type, max(event_id) AS op, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT coalesce(a.user_id, b.user_id) AS object, coalesce(a.event_type, b.event_type) AS field, greatest(coalesce(a.op, -1), coalesce(b.op, -1)) AS op,
           CASE WHEN coalesce(a.op, -1) > coalesce(b.op, -1) THEN a.value ELSE b.value END AS value
    FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""")
def frame_merge(spark, sf_dir):
    reduce = lambda x: reducers.lww(x, ["object", "field"], "op", ["value"])
    log = adapters.events_lww(spark, sf_dir)
    return reducers.merge([reduce(log.where(F.col("op") % 2 == k)) for k in (0, 1)], reduce)


@query("""
    SELECT event_type AS type, user_id AS object, event_id AS op, value FROM events WHERE event_type = 'error' UNION ALL
    SELECT event_type, user_id, max(event_id), arg_max(value, event_id) FROM events WHERE event_type <> 'error' GROUP BY ALL
""")
def type_passthrough(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir).selectExpr("field AS type", "object", "op", "value")
    reduce = lambda x: reducers.lww(x, ["type", "object"], "op", ["value"])
    return reducers.reduce_frame(log, "type", {k: reduce for k in KINDS if k != "error"})


@query(f"SELECT user_id AS object, event_id AS item, coalesce(gone, event_id) AS op, CASE WHEN gone IS NULL THEN 0 ELSE event_id END AS ref, field, props, value FROM (SELECT *, event_type AS field FROM ({_ADDS}))")
def orset_reduce(spark, sf_dir):
    return reducers.orset(adapters.events_set(spark, sf_dir), ["object"], "op", "ref", ["field", "props", "value"])


def _alive(spark, sf_dir):
    return reducers.alive(orset_reduce(spark, sf_dir), "ref")


@query(f"SELECT user_id AS object, event_id AS item, event_type AS field, props, value FROM ({_ALIVE})")
def orset_alive(spark, sf_dir):
    return _alive(spark, sf_dir).select("object", "item", "field", "props", "value")


@query(f"SELECT user_id AS object, min(event_id) AS item FROM ({_ALIVE}) GROUP BY user_id")
def orset_any_alive(spark, sf_dir):
    return _alive(spark, sf_dir).groupBy("object").agg(F.min("item").alias("item"))


@query(f"SELECT user_id AS object, CAST(1000000000 AS BIGINT) AS op, event_id AS ref FROM ({_ALIVE}) WHERE value > 100")
def remove_values(spark, sf_dir):
    """Tombstones for every observed alive value over 100."""
    state = orset_reduce(spark, sf_dir)
    return edits.removed(state, F.col("value") > 100, F.lit(1_000_000_000).cast("long"), ["object"])


@query(f"""
    SELECT user_id AS object, event_type AS field, CAST(1000000000 AS BIGINT) AS op, CAST(0 AS BIGINT) AS ref, max(value) AS value FROM ({_ALIVE}) WHERE event_type = 'view' GROUP BY ALL UNION ALL
    SELECT user_id, event_type, CAST(1000000001 AS BIGINT), event_id, value FROM ({_ALIVE}) WHERE event_type = 'view'
""")
def assign_field(spark, sf_dir):
    """Every object's view field is assigned its greatest value: one add, and tombstones for what was observed."""
    state = orset_reduce(spark, sf_dir)
    views_only = state.where("field = 'view'")
    new = reducers.alive(views_only, "ref").groupBy("object", "field").agg(F.max("value").alias("value"))
    return edits.assigned(views_only, new, F.lit(1_000_000_000).cast("long"), ["object", "field"])


@query("SELECT o_orderkey AS object, u.field AS field, o_orderkey AS op, u.value AS value FROM orders, LATERAL (SELECT unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value) u")
def new_structs(spark, sf_dir):
    """Every order becomes a new object of two fields with one event."""
    rows = adapters.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS object", "o_orderkey AS op", "o_orderstatus AS status", "o_orderpriority AS priority")
    return edits.new_struct(rows, "object", ["status", "priority"], "op")


@query("""
    SELECT conv_id AS object, 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS op,
           CASE WHEN turn = 0 THEN 0 ELSE 99 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS ref, text FROM conversations
""")
def insert_run(spark, sf_dir):
    """A conversation's texts inserted as one run at the start of a list."""
    items = adapters.conversation_chain(spark, sf_dir).selectExpr("object", "op AS turn", "text", "CAST(0 AS BIGINT) AS at")
    return edits.inserted(items, ["object"], "at", "turn", F.lit(100).cast("long")).select("object", "op", "ref", "text")


def _field(name: str, how: str, sql: str):
    @query(f"SELECT user_id AS object, event_type AS field, {sql} AS value FROM ({_ALIVE}) GROUP BY ALL")
    def field(spark, sf_dir):
        value = views.strategy(how, "value", "op")
        out = _alive(spark, sf_dir).groupBy("object", "field").agg(value.alias("value"))
        return out.withColumn("value", F.array_join(F.transform("value", lambda v: F.format_string("%.2f", v)), ",")) if how == "set" else out

    field.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("field"), ORACLE_SQL.pop("field")


_field("field_lww", "lww", "arg_max(value, event_id)")
_field("field_max", "max", "max(value)")
_field("field_min", "min", "min(value)")
_field("field_set", "set", "string_agg(printf('%.2f', value), ',' ORDER BY event_id)")


@query("""
    SELECT c_custkey AS object, min(o_orderkey) AS root, count(o_orderkey) AS merged, arg_max(o_orderstatus, o_orderkey) AS status
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def field_merge(spark, sf_dir):
    """Every order is an object that its customer refers to: all are merged into the one with the smallest id."""
    refs = adapters.table(spark, sf_dir, "orders").selectExpr("o_custkey AS object", "o_orderkey AS op", "o_orderstatus AS status")
    known = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey AS object")
    return refs.join(known, "object").groupBy("object").agg(F.min("op").alias("root"), F.count("*").alias("merged"), views.strategy("lww", "status", "op").alias("status"))


def _vectors(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir).withColumn("replica", F.col("op") % 3)
    return log, reducers.version_vector(log, ["object"], "replica", "op")


@query("SELECT user_id % 7 AS replica, max(ts) AS ts FROM events GROUP BY 1")
def vv_reduce(spark, sf_dir):
    return reducers.version_vector(adapters.events_lww(spark, sf_dir).withColumn("replica", F.col("object") % 7), [], "replica", "ts")


@query("""
    WITH v AS (SELECT user_id AS o, event_id % 3 AS r, max(event_id) AS t FROM events GROUP BY ALL)
    SELECT a.o AS a, a.o + 1 AS b, bool_and(coalesce(a.t <= b.t, false)) AS leq FROM v a LEFT JOIN v b ON b.o = a.o + 1 AND b.r = a.r GROUP BY a.o
""")
def vv_leq(spark, sf_dir):
    _, vectors = _vectors(spark, sf_dir)
    pairs = vectors.select("object").distinct().selectExpr("object AS a", "object + 1 AS b")
    return reducers.precedes(pairs, vectors, "a", "b", "object", "replica", "op")


_HALF = "WITH v AS (SELECT user_id AS o, event_id % 3 AS r, max(event_id) AS t FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) SELECT user_id AS object, event_id AS op, event_id % 3 AS replica FROM events LEFT JOIN v ON user_id = o AND event_id % 3 = r"


def _half(spark, sf_dir):
    log, _ = _vectors(spark, sf_dir)
    log = log.select("object", "op", "replica", "ts")
    seen = reducers.version_vector(log.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), ["object"], "replica", "op")
    return log.drop("ts"), seen


@query(f"{_HALF} WHERE t IS NULL OR event_id > t")
def vv_newer(spark, sf_dir):
    log, seen = _half(spark, sf_dir)
    return reducers.newer(log, seen, ["object"], "replica", "op")


@query(f"{_HALF} WHERE event_id <= t")
def vv_covered(spark, sf_dir):
    log, seen = _half(spark, sf_dir)
    return reducers.covered(log, seen, ["object"], "replica", "op")


@query(f"SELECT user_id AS object, event_id AS op, coalesce(gone, 0) AS ref FROM ({_ADDS})")
def rga_tombstones(spark, sf_dir):
    log = adapters.events_set(spark, sf_dir)
    removals = log.where("ref <> 0").selectExpr("object", "ref AS target", "op AS gone")
    return sequences.marked(log.where("ref = 0").select("object", "op"), removals, ["object"], "op", "target", "gone")


@query("SELECT user_id AS object, event_id AS op, event_type AS field, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def rga_desc_merge(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir).select("object", "op", "field")
    return sequences.descending_merge([log.where("op % 2 = 0"), log.where("op % 3 = 0")], ["object"], "op", "field").withColumn("pos", F.col("pos").cast("long"))


_NEWEST_FIRST = "SELECT user_id AS object, event_id AS op, event_type AS field, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos FROM events"
#: Two replicas that overlap and together hold every event.
_REPLICAS = ("op % 3 <> 0", "op % 2 = 0 OR op % 3 = 0")


@query(_NEWEST_FIRST)
def rga_desc_merge_all(spark, sf_dir):
    """As rga_desc_merge, over replicas whose union is every event."""
    log = adapters.events_lww(spark, sf_dir).select("object", "op", "field")
    return sequences.descending_merge([log.where(r) for r in _REPLICAS], ["object"], "op", "field").withColumn("pos", F.col("pos").cast("long"))


_TREE = "e AS (SELECT user_id AS object, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS op, event_type FROM events)"


@query(f"""
    WITH RECURSIVE {_TREE},
    t AS (SELECT object, op, [-op] AS path FROM e WHERE op = 1 UNION ALL SELECT e.object, e.op, list_append(t.path, -e.op) FROM e JOIN t ON e.object = t.object AND e.op // 2 = t.op)
    SELECT object, op, row_number() OVER (PARTITION BY object ORDER BY path) - 1 AS pos FROM t
""")
def ct_order(spark, sf_dir):
    return sequences.tree_order(adapters.events_tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT object, op, event_type, event_type = 'error' OR EXISTS (SELECT 1 FROM e c WHERE c.object = e.object AND c.op // 2 = e.op AND c.event_type = 'error') AS deleted FROM e")
def ct_deleted(spark, sf_dir):
    return sequences.tree_deleted(adapters.events_tree(spark, sf_dir), "object", "op", "parent", F.col("event_type") == "error").select("object", "op", "event_type", "deleted")


@query("SELECT conv_id AS object, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ct_chain(spark, sf_dir):
    chain = adapters.conversation_chain(spark, sf_dir)
    rows = chain.join(sequences.tree_order(chain), ["object", "op"]).withColumn("said", F.concat("role", F.lit(": "), "text"))
    return sequences.text_of(rows, ["object"], "pos", "said", "\n")


@query(f"WITH {_TREE} SELECT object, op, CAST(floor(log2(op)) AS BIGINT) + 1 AS depth FROM e")
def gtree_depth(spark, sf_dir):
    return sequences.depths(adapters.events_tree(spark, sf_dir), "object", "op", "parent")


@query("SELECT doc_id AS object, text FROM documents")
def rga_text(spark, sf_dir):
    """Every document becomes a replicated list of its lines, and is read back from the list's order."""
    lines = adapters.table(spark, sf_dir, "documents").selectExpr("doc_id AS object", "posexplode(split(text, '\n')) AS (i, line)")
    made = sequences.chained(lines, ["object"], "i")
    rows = made.join(sequences.list_order(made.select("object", "op", "ref")), ["object", "op"])
    return sequences.text_of(rows, ["object"], "pos", "line", "\n")


@query("""
    WITH x AS (SELECT *, coalesce(lag(o_orderstatus) OVER (ORDER BY o_orderkey) <> o_orderstatus, true) AS starts FROM orders),
         y AS (SELECT *, sum(CAST(starts AS INT)) OVER (ORDER BY o_orderkey) AS run FROM x)
    SELECT min(o_orderkey) AS first_op, max(o_orderkey) AS last_op, any_value(o_orderstatus) AS object, count(*) AS n_ops, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM y GROUP BY run
""")
def patch_runs(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return stores.patch_runs(orders, "o_orderstatus", "o_orderkey", "cents")


@query("SELECT event_id AS op, user_id AS object, event_type AS field, value FROM events")
def append_dedup(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir).select("op", "object", "field", "value")
    return stores.appended(log.where("op % 3 <> 0"), log.where("op % 2 = 0 OR op % 3 = 0"), "op")


@query("SELECT DISTINCT user_id AS object FROM events")
def list_objects(spark, sf_dir):
    return stores.objects(adapters.events_lww(spark, sf_dir), "object")


@query(f"SELECT * FROM ({_HALF} WHERE t IS NULL OR event_id > t) WHERE object = 7")
def load_since(spark, sf_dir):
    """One object's ops beyond a vector: the object's filter reaches the scan."""
    log, seen = _half(spark, sf_dir)
    return reducers.newer(log.where("object = 7"), seen.where("object = 7"), ["object"], "replica", "op")


@query("SELECT user_id AS object, event_id AS op, props AS rest FROM events WHERE event_type = 'purchase'")
def sub_object_log(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir).selectExpr("object", "op", "array(field, props) AS payload")
    return views.under_path(log, "payload", ["purchase"]).select("object", "op", F.array_join("payload", ",").alias("rest"))


@query("SELECT user_id AS object, props AS key, arg_max(value, event_id) AS latest, string_agg(printf('%.2f', value), ',' ORDER BY event_id) AS every FROM events GROUP BY ALL")
def map_lookup(spark, sf_dir):
    log = adapters.events_lww(spark, sf_dir)
    out = log.groupBy("object", F.col("props").alias("key")).agg(views.strategy("lww", "value", "op").alias("latest"), views.strategy("set", "value", "op").alias("every"))
    return out.withColumn("every", F.array_join(F.transform("every", lambda v: F.format_string("%.2f", v)), ","))


@query("SELECT c.conv_id AS message, min(turn) AS posted, arg_max(role, turn) AS username, arg_max(text, turn) AS text FROM conversations c GROUP BY c.conv_id")
def chat_view(spark, sf_dir):
    """A room's set of message references joined to the messages' logs, the latest value of each field, in one join."""
    log = adapters.conversation_chain(spark, sf_dir)
    room = log.selectExpr("object AS message").distinct()
    fields = log.selectExpr("object AS message", "op", "stack(2, 'username', role, 'text', text) AS (field, value)")
    view = views.struct_view(fields.join(room, "message"), "message", "field", "value", "op", {"username": "lww", "text": "lww"})
    return view.join(log.groupBy(F.col("object").alias("message")).agg((F.min("op") - 1).alias("posted")), "message")


def _sql_letters(v: str, alphabet: str, bits: int, count: int) -> str:
    return " || ".join(f"substr('{alphabet}', CAST((({v} {'>>' if 60 >= bits * (i + 1) else '<<'} {abs(60 - bits * (i + 1))}) & {(1 << bits) - 1}) AS INT) + 1, 1)" for i in range(count))


_SQL60 = _sql_letters("v", ids.BASE64, 6, 10)


@query(f"""
    SELECT event_id, {_SQL60} AS letters, coalesce(nullif(rtrim({_SQL60}, '0'), ''), '0') AS short, coalesce(nullif(rtrim({_sql_letters("v", ids.BASE32, 5, 12)}, '0'), ''), '0') AS name, v AS back
    FROM (SELECT event_id, (event_id + 1) % 1048576 * 1099511627776 + user_id * 77 AS v FROM events)
""")
def base64_60(spark, sf_dir):
    """Values of sixty bits in letters and back; their upper twenty bits are the event's, so that they fit whatever its id."""
    v = (F.col("event_id") + 1) % 1048576 * 1099511627776 + F.col("user_id") * 77
    x = adapters.table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return x.select("event_id", ids.encode60(F.col("v")).alias("letters"), ids.encode60_short(F.col("v")).alias("short"), ids.encode60_base32(F.col("v")).alias("name")).withColumn("back", ids.decode60(F.col("short")))


@query(f"""
    SELECT event_id, 'B/' || coalesce(nullif(rtrim({_SQL60}, '0'), ''), '0') || '+' || coalesce(nullif(rtrim({_sql_letters("o", ids.BASE64, 6, 10)}, '0'), ''), '0') AS id, 'B' || {_SQL60} || '2' || {_sql_letters("o", ids.BASE64, 6, 10)} AS sortable
    FROM (SELECT event_id, event_id * 4096 AS v, user_id AS o FROM events)
""")
def uuid_text(spark, sf_dir):
    u = types.uuid(11, F.col("event_id") * 4096, 0, 2, F.col("user_id"))
    return adapters.table(spark, sf_dir, "events").select("event_id", ids.uuid_text(u).alias("id"), ids.sortable(u).alias("sortable"))


@query("SELECT event_id, epoch_us(ts) * 10 + 122192928000000000 AS encoded, ts AS decoded FROM events")
def epoch_time(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "events").select("event_id", times.epoch_encode(F.col("ts")).alias("encoded"))
    return x.withColumn("decoded", times.epoch_decode(F.col("encoded")).cast("timestamp_ntz"))


@query("""
    SELECT event_id, (CAST((year(ts) - 2010) * 12 + month(ts) - 1 AS BIGINT) << 48) + (CAST(day(ts) - 1 AS BIGINT) << 42) + (CAST(hour(ts) AS BIGINT) << 36) + (CAST(minute(ts) AS BIGINT) << 30)
           + (CAST(second(ts) AS BIGINT) << 24) + (epoch_us(ts) % 1000000) * 10 AS encoded, ts AS decoded FROM events
""")
def calendar_time(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "events").select("event_id", times.calendar_encode(F.col("ts")).alias("encoded"))
    return x.withColumn("decoded", times.calendar_decode(F.col("encoded")).cast("timestamp_ntz"))


@query("""
    SELECT o_orderkey, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS encoded, v AS decoded, least(o_orderkey + 1, 1152921504606846975) AS succ
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS v FROM orders)
""")
def zigzag(spark, sf_dir):
    v = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END")
    x = adapters.table(spark, sf_dir, "orders").select("o_orderkey", ids.zigzag_encode(v).alias("encoded"))
    return x.select("o_orderkey", "encoded", ids.zigzag_decode(F.col("encoded")).alias("decoded"), ids.succ_value(F.col("o_orderkey")).alias("succ"))


@query("""
    SELECT event_id, CASE WHEN a = 0 AND b = 2 THEN 'annotation' WHEN a = 0 AND b = 3 THEN 'annotation_derived' WHEN a = 2 AND b = 0 THEN 'create' WHEN a = 2 AND b = 2 THEN 'regular'
        WHEN a = 2 AND b = 3 THEN 'ack' WHEN a = 3 AND b = 2 THEN 'delete' WHEN a = 3 AND b = 3 THEN 'undelete' END AS pattern, user_id % 360 AS hue
    FROM (SELECT event_id, user_id, event_id % 4 AS a, (event_id // 4) % 4 AS b FROM events)
""")
def op_pattern(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "events")
    return x.select("event_id", ids.op_pattern(F.col("event_id") % 4, F.expr("(event_id div 4) % 4")).alias("pattern"), ids.hue(F.col("user_id")).alias("hue"))


@query("SELECT user_id AS object, count(*) AS ops, count(*) FILTER (event_id < first) AS early FROM events JOIN (SELECT user_id AS u, min(event_id) AS first FROM events GROUP BY 1) ON u = user_id GROUP BY user_id")
def causality_check(spark, sf_dir):
    """Ops older than their object, whose id is its creation's: none in a sound log."""
    log = adapters.events_lww(spark, sf_dir)
    made = log.groupBy("object").agg(F.min("op").alias("first"))
    return log.join(made, "object").groupBy("object").agg(F.count("*").alias("ops"), F.sum((F.col("op") < F.col("first")).cast("long")).alias("early"))


@query(ORACLE_SQL["lww_reduce"])
def stream_lww(spark, sf_dir):
    stream = live.source(spark, sf_dir, "events", adapters.table(spark, sf_dir, "events").schema).selectExpr("user_id AS object", "event_type AS field", "event_id AS op", "value")
    return live.reduced(stream, lambda x: reducers.lww(x, ["object", "field"], "op", ["value"]))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    stream = live.source(spark, sf_dir, "events", adapters.table(spark, sf_dir, "events").schema).select("event_id", "user_id", "event_type")
    return live.appended(stream.union(stream), "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS object, string_agg(event_type, ',' ORDER BY event_id) AS log FROM events GROUP BY user_id")
def peer_messages(spark, sf_dir):
    patches = sequences.text_of(adapters.events_lww(spark, sf_dir), ["object"], "op", "field", ",")
    return live.received(live.messages(patches, "object", "text"))


@query("SELECT user_id AS object, event_id AS op, event_type AS field, value FROM events")
def text_round_trip(spark, sf_dir):
    """The log written as one text frame an object and parsed again."""
    log = adapters.events_lww(spark, sf_dir)
    frames = text.serialized(log.selectExpr("object", "op", "field", "value"))
    frames = frames.repartition(spark.sparkContext.defaultParallelism)  # reading is Python work: as many tasks as cores, however few bytes
    return text.parsed(frames).selectExpr("object", "op", "field", "value")


def _told(rows: DataFrame) -> DataFrame:
    """(object, op, field, value) of parsed log rows."""
    return rows.where("op_index >= 0").select(F.col("object_id.value").alias("object"), F.col("op_id.value").alias("op"), ids.encode60_short(F.col("ref_id.value")).alias("field"), F.col("payload")[0]["f"].alias("value"))


@query(ORACLE_SQL["text_round_trip"])
def delta_round_trip(spark, sf_dir):
    """The log as delta-coded text frames, parsed again."""
    made = frames.delta_coded(adapters.events_log(spark, sf_dir), ["frame_no"])
    return _told(text.parsed_log(made.repartition(spark.sparkContext.defaultParallelism)))


@query(ORACLE_SQL["text_round_trip"])
def binary_round_trip(spark, sf_dir):
    """The log as binary frames, parsed again."""
    made = binary.serialized(adapters.events_log(spark, sf_dir), ["frame_no"])
    return _told(binary.parsed_log(made.repartition(spark.sparkContext.defaultParallelism)))


@query("SELECT doc_id AS object, replace(text, 'an', 'AN') AS text FROM documents")
def rga_edit(spark, sf_dir):
    """Every document, a list of its lines, is edited by differences into another text; the ops are applied and read back."""
    docs = adapters.table(spark, sf_dir, "documents")
    lines = lambda t: docs.selectExpr("doc_id AS object", f"posexplode(split({t}, '\n')) AS (pos, value)")
    current = lines("text").withColumn("op", F.col("pos").cast("long") + 1)
    ops = lists.edited(current, lines("replace(text, 'an', 'AN')"), F.lit(1_000_000_000).cast("long"))
    zero = F.lit(0).cast("long")
    states = current.select("object", zero.alias("chunk"), zero.alias("ref"), F.col("pos").cast("long").alias("pos"), "op", zero.alias("gone"), F.col("value").alias("payload"))
    runs = ops.where("value IS NOT NULL").select("object", F.col("op").alias("chunk"), "ref", zero.alias("pos"), "op", zero.alias("gone"), F.col("value").alias("payload"))
    rows, _ = lists.reduced(states.unionByName(runs), ops.where("value IS NULL").selectExpr("object", "ref AS target", "op AS tombstone"), 0)
    return sequences.text_of(rows.where("gone = 0"), ["object"], "pos", "payload", "\n")


def _merged_states(spark, sf_dir, replicas):
    zero = F.lit(0).cast("long")
    log = adapters.events_lww(spark, sf_dir)
    made = [log.where(r).select("object", F.lit(n).cast("long").alias("chunk"), zero.alias("ref"), (-F.col("op")).alias("pos"), "op", zero.alias("gone"), F.col("field").alias("payload")) for n, r in enumerate(replicas, 2)]
    rows, _ = lists.reduced(made[0].unionByName(made[1]), log.where("false").selectExpr("object", "op AS target", "op AS tombstone"), 0)
    return rows.select("object", "op", F.col("payload").alias("field"), F.col("pos").cast("long").alias("pos"))


@query("SELECT user_id AS object, event_id AS op, event_type AS field, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def rga_states(spark, sf_dir):
    """Two replicas' lists, each newest first, merged to a fix-point."""
    return _merged_states(spark, sf_dir, ("op % 2 = 0", "op % 3 = 0"))


@query(_NEWEST_FIRST)
def rga_states_all(spark, sf_dir):
    """As rga_states, over replicas whose union is every event."""
    return _merged_states(spark, sf_dir, _REPLICAS)


@query("SELECT user_id AS document, event_type AS field, max(event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def document_compaction(spark, sf_dir):
    """Every user's log is a document that three replicas save versions of; the versions are compacted and read."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    reduce = lambda x: reducers.lww(x, ["document", "field"], "op", ["value"])
    log = adapters.events_lww(spark, sf_dir).selectExpr("object AS document", "op % 3 AS version", "field", "op", "value")
    documents.save(log, path)
    documents.compact(spark, path, reduce)
    return documents.loaded(spark, path, reduce)


_EVENTS = schema.Struct(
    "Visit", "set", (schema.Field("click", "Float", "max"), schema.Field("error", "Float", "min"), schema.Field("purchase", "Float"), schema.Field("signup", "String"), schema.Field("view", "Float", "set")), prefix="user", title=True
)


@query("""
    SELECT user_id AS object, max(value) FILTER (event_type = 'click') AS "userClick", min(value) FILTER (event_type = 'error') AS "userError", arg_max(value, event_id) FILTER (event_type = 'purchase') AS "userPurchase",
           count(*) FILTER (event_type = 'view') AS "userView" FROM events GROUP BY user_id
""")
def schema_view(spark, sf_dir):
    """Every user's events as a typed object, a merge strategy a field."""
    log = adapters.events_lww(spark, sf_dir).withColumn("value", F.col("value").cast("string"))
    x = schema.view(log, _EVENTS)
    return x.withColumn("userView", F.size("userView").cast("long")).drop("userSignup")


from tidelog.plans import codecs_catalog, lists_catalog, nested_catalog  # noqa: E402,F401  these register their queries here
