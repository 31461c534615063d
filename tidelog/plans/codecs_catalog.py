"""Further registered queries: ids, events and clocks as columns, pieces of text, open and state frames, folders, whole-frame reduction, producers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids, parsing, times
from tidelog.operators import edits, frames as reduction, lists, reducers, sequences, views
from tidelog.plans.catalog import _sql_letters, query
from tidelog.shared import shared_dir
from tidelog.sources import adapters, binary, folders, frames, text

#: SQL: an id of all fields from an event, of whose value the upper twenty bits are the event's low ones, and its 64-bit halves as unsigned numbers.
_FIELDS = "SELECT event_id, event_id % 16 AS a, (event_id + 1) % 1048576 * 1099511627776 + user_id AS v, event_id % 4 AS b, (event_id // 4) % 4 AS c, user_id * 1048576 + event_id AS o FROM events"
_HALVES = f"SELECT *, CAST(a AS HUGEINT) * 1152921504606846976 + v AS x, CAST(b * 4 + c AS HUGEINT) * 1152921504606846976 + o AS y FROM ({_FIELDS})"


def _signed(v: str) -> str:
    return f"CAST(CASE WHEN {v} >= 9223372036854775808 THEN {v} - 18446744073709551616 ELSE {v} END AS BIGINT)"


def _fields(spark, sf_dir):
    x = adapters.table(spark, sf_dir, "events")
    u = types.uuid(F.col("event_id") % 16, (F.col("event_id") + 1) % 1048576 * 1099511627776 + F.col("user_id"), F.col("event_id") % 4, F.expr("(event_id div 4) % 4"), F.col("user_id") * 1048576 + F.col("event_id"))
    return x.select("*", u.alias("u"))


@query(f"SELECT event_id, {_signed('x')} AS x, {_signed('y')} AS y, v AS value, o AS origin, a AS variety, b AS variant, c AS version, least(v + 1, 1152921504606846975) AS following, CASE WHEN x < 1152921504606846976 THEN {_signed('x')} END AS word60, event_id & 16777215 AS low24 FROM ({_HALVES})")
def id_halves(spark, sf_dir):
    """Every event's id as two 64-bit halves and back."""
    x = _fields(spark, sf_dir).select("event_id", ids.words64(F.col("u")).alias("w"))
    x = x.select("event_id", F.col("w.x").alias("x"), F.col("w.y").alias("y"), ids.from_words64(F.col("w.x"), F.col("w.y")).alias("u"))
    whole = [F.col(f"u.{c}").cast("long").alias(c) for c in ("variety", "value", "variant", "version", "origin")]
    return x.select("event_id", "x", "y", *whole, ids.succ(F.col("u"))["value"].alias("following"), ids.to_word60(F.col("x")).alias("word60"), ids.least_significant24(F.col("event_id")).alias("low24"))


def _sql_name(x: str) -> str:
    first = f"substr('{ids.BASE32}', CAST({x} // 1152921504606846976 AS INT) + 1, 1)"
    return f"coalesce(nullif(rtrim({first} || {_sql_letters(f'CAST({x} % 1152921504606846976 AS BIGINT)', ids.BASE32, 5, 12)}, '0'), ''), '0')"


@query(f"SELECT event_id, {_sql_name('x')} || '-' || {_sql_name('y')} AS name, v AS value, o AS origin, true AS valid, substr('{ids.BASE64}', CAST(a AS INT) + 1, 1) || {_sql_letters('v', ids.BASE64, 6, 10)} AS letters, {_signed('x')} AS x FROM ({_HALVES})")
def id_file_names(spark, sf_dir):
    """Ids as file names and back from lower case, and their first halves in fixed letters and back."""
    x = _fields(spark, sf_dir).select("event_id", ids.file_name(F.col("u")).alias("name"), ids.words64(F.col("u"))["x"].alias("first"))
    x = x.select("event_id", "name", ids.from_file_name(F.lower("name")).alias("back"), ids.is_file_name(F.col("name")).alias("valid"), ids.encode64(F.col("first")).alias("letters"))
    return x.select("event_id", "name", "back.value", "back.origin", "valid", "letters", ids.decode64(F.col("letters")).alias("x"))


@query("SELECT event_id, event_type AS scope, 'u' || (user_id % 9 + 1) AS name, event_type || '' AS plain, CASE WHEN event_id % 2 = 0 THEN 'too_long_name_x' END AS refused FROM events")
def id_names(spark, sf_dir):
    """Scoped and global names as ids and back; a name of over ten letters is none."""
    x = adapters.table(spark, sf_dir, "events").withColumn("local", F.concat(F.lit("u"), F.col("user_id") % 9 + 1))
    named, plain = ids.name_of(ids.scoped_name(F.col("event_type"), F.col("local"))), ids.name_of(ids.global_name(F.col("event_type")))
    long = F.lit("too_long_name_x")
    return x.select("event_id", named["scope"].alias("scope"), named["name"].alias("name"), F.concat(plain["scope"], plain["name"]).alias("plain"), F.when((F.col("event_id") % 2 == 0) & ids.global_name(long).isNull(), long).alias("refused"))


@query(f"SELECT event_id, translate(rtrim(base64(encode(props)), '='), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', '{ids.BASE64}') AS letters, props AS back FROM events")
def blob_letters(spark, sf_dir):
    """Blobs in this Base64 and back."""
    x = adapters.table(spark, sf_dir, "events").select("event_id", ids.encode_bytes(F.encode("props", "UTF-8")).alias("letters"))
    return x.withColumn("back", F.decode(ids.decode_bytes(F.col("letters")), "UTF-8"))


_DATES = "SELECT event_id, 2005 + event_id % 12 AS y, event_id % 14 AS m, event_id % 33 AS d, event_id % 26 AS h, event_id % 61 AS n, event_id % 63 AS s, (event_id * 7919) % 10000019 AS f FROM events"


@query(f"""
    SELECT event_id, CASE WHEN y >= 2010 AND TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AND h < 24 AND n < 60 AND s < 61 AND f < 10000000
        THEN (CAST((y - 2010) * 12 + m - 1 AS BIGINT) << 48) + (CAST(d - 1 AS BIGINT) << 42) + (CAST(h AS BIGINT) << 36) + (CAST(n AS BIGINT) << 30) + (CAST(s AS BIGINT) << 24) + f END AS full_value,
        CASE WHEN y >= 2010 AND TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL THEN (CAST((y - 2010) * 12 + m - 1 AS BIGINT) << 48) + (CAST(d - 1 AS BIGINT) << 42) END AS day_value
    FROM ({_DATES})
""")
def calendar_values(spark, sf_dir):
    """Calendar times of dates and day times, of which many do not exist."""
    e = adapters.table(spark, sf_dir, "events").selectExpr("event_id", "2005 + event_id % 12 AS y", "event_id % 14 AS m", "event_id % 33 AS d", "event_id % 26 AS h", "event_id % 61 AS n", "event_id % 63 AS s", "(event_id * 7919) % 10000019 AS f")
    c = F.col
    return e.select("event_id", times.calendar_value(c("y"), c("m"), c("d"), c("h"), c("n"), c("s"), c("f")).alias("full_value"), times.calendar_value(c("y"), c("m"), c("d")).alias("day_value"))


@query("""
    SELECT event_id, (event_id % 3) * 4 + user_id % 4 AS variety, event_id * 1000 AS value, user_id AS origin, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS time_variety, CASE WHEN event_id % 5 <> 0 THEN event_id * 1000 END AS time,
           CASE WHEN event_id % 5 <> 0 THEN user_id % 4 END AS origin_variety FROM events
""")
def event_ids(spark, sf_dir):
    """Events as ids and back; every fifth id is made a name's, which is no event."""
    x = adapters.table(spark, sf_dir, "events")
    u = times.event(times.time(F.col("event_id") % 3, F.col("event_id") * 1000), times.replica(F.col("user_id") % 4, F.col("user_id")))
    x = x.select("event_id", u.alias("u")).withColumn("e", times.decode_event(F.col("u").withField("version", F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.col("u.version")).cast("tinyint"))))
    whole = [F.col("u.variety").cast("long").alias("variety"), "u.value", "u.origin"]
    return x.select("event_id", *whole, F.col("e.time.variety").cast("long").alias("time_variety"), F.col("e.time.value").alias("time"), F.col("e.replica.variety").cast("long").alias("origin_variety"))


@query("""
    WITH s AS (SELECT user_id, max(event_id) AS seen FROM events GROUP BY 1)
    SELECT conv_id AS object, turn, greatest(5000, coalesce(seen + 1, 5000)) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS value FROM conversations LEFT JOIN s ON user_id = conv_id
""")
def clock_events(spark, sf_dir):
    """A clock that has seen the events of a log gives successive values to a conversation's turns."""
    clock = times.seen(adapters.events_log(spark, sf_dir), ["frame_no"]).selectExpr("frame_no AS object", "seen")
    rows = adapters.table(spark, sf_dir, "conversations").selectExpr("conv_id AS object", "turn")
    return times.issued(rows, ["object"], ["turn"], clock, F.lit(5000).cast("long")).select("object", "turn", "value")


@query("SELECT event_id, year(ts) || ' ' || month(ts) || ' ' || day(ts) AS said, CAST(ts AS DATE) AS day, last_day(CAST(ts AS DATE)) AS clipped FROM events")
def day_payloads(spark, sf_dir):
    """Days as three integers and back; a day that a month lacks is its last."""
    x = adapters.table(spark, sf_dir, "events").select("event_id", times.day_payload(F.to_date("ts")).alias("p"))
    beyond = F.transform("p", lambda a, i: F.when(i == 2, a.withField("i", F.lit(99).cast("long"))).otherwise(a))
    return x.select("event_id", F.array_join(F.transform("p", lambda a: a["i"].cast("string")), " ").alias("said"), times.payload_day(F.col("p")).alias("day"), times.payload_day(beyond).alias("clipped"))


@query("SELECT event_id, event_id AS whole, value AS real, event_type || '''s \"x\"' AS said, user_id AS origin, event_id * 64 AS id_value, 3 AS atoms, event_id AS op, user_id AS ref, CAST(NULL AS BIGINT) AS none FROM events")
def parsed_pieces(spark, sf_dir):
    """Ids, atoms, strings, payloads and ops read from their texts."""
    x = adapters.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(spark.sparkContext.defaultParallelism)  # a file has few splits for so much parsing
    u = types.uuid(11, F.col("event_id") * 64, 0, 2, F.col("user_id"))
    said = text.quoted(F.concat("event_type", F.lit("'s \"x\"")))
    whole, real = F.concat(F.lit("="), F.col("event_id").cast("string")), F.concat(F.lit("^"), F.col("value").cast("string"))
    named = lambda c: ids.uuid_text(types.uuid(0, F.col(c), 0, 2, 0))
    op = F.concat(F.lit("*lww#x@"), named("event_id"), F.lit(":"), named("user_id"), F.lit(" 1;"))
    x = x.select("event_id", ids.uuid_text(u).alias("u"), whole.alias("w"), real.alias("r"), said.alias("s"), F.concat_ws(" ", whole, real, said).alias("p"), op.alias("op"), F.concat(ids.uuid_text(u), F.lit("]]")).alias("bad"))
    x = x.select("event_id", parsing.parse_uuid(F.col("u")).alias("u"), parsing.parse_atom(F.col("w")).alias("w"), parsing.parse_atom(F.col("r")).alias("r"), parsing.parse_string(F.col("s")).alias("said"), parsing.parse_payload(F.col("p")).alias("p"), parsing.parse_op(F.col("op")).alias("op"), parsing.parse_uuid(F.col("bad"))["value"].alias("none"))
    return x.select("event_id", F.col("w.i").alias("whole"), F.col("r.f").alias("real"), "said", F.col("u.origin").alias("origin"), F.col("u.value").alias("id_value"), F.size("p").alias("atoms"), F.col("op.op_id.value").alias("op"), F.col("op.ref_id.value").alias("ref"), "none")


def _event_ops(spark, sf_dir):
    """Every user's events as open ops: ids by event, every third refers to the one before, the others to the user."""
    none = lambda t: F.lit(None).cast(t)
    atom = lambda tag, **f: F.struct(F.lit(tag).alias("tag"), *[f.get(k, none(t)).alias(k) for k, t in (("i", "bigint"), ("f", "double"), ("s", "string"), ("u", types.UUID))])
    user, own = types.uuid(0, F.col("object"), 0, 2, 7), types.uuid(0, F.col("op"), 0, 2, F.col("object"))
    before = F.expr("lag(op) OVER (PARTITION BY object ORDER BY op)")
    x = adapters.events_lww(spark, sf_dir).withColumn("before", before).withColumn("n", F.expr("row_number() OVER (PARTITION BY object ORDER BY op)"))
    ref = F.when((F.col("n") % 3 == 0) & F.col("before").isNotNull(), types.uuid(0, F.col("before"), 0, 2, F.col("object"))).otherwise(user)
    payload = F.array(atom("string", s=F.col("field")), atom("integer", i=F.col("op")), atom("float", f=F.col("value")), atom("uuid", u=own), atom("uuid", u=user))
    return x.select("object", (F.col("n") - 1).cast("int").alias("op_index"), own.alias("op_id"), ref.alias("ref_id"), payload.alias("payload"))


_OPS = """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id AS object, event_id AS op, CASE WHEN n % 3 = 0 THEN before ELSE user_id END AS ref, event_type AS field, event_id AS whole, value AS real, event_id AS own, 7 AS origin FROM e"""


def _told(ops):
    p = lambda k: F.col("payload")[k]
    return ops.select("object", F.col("op_id.value").alias("op"), F.col("ref_id.value").alias("ref"), p(0)["s"].alias("field"), p(1)["i"].alias("whole"), p(2)["f"].alias("real"), p(3)["u"]["value"].alias("own"), p(4)["u"]["origin"].alias("origin"))


@query(_OPS)
def open_round_trip(spark, sf_dir):
    """Every user's ops of all kinds of atoms as an open frame, parsed again."""
    return _told(text.parsed_open(frames.open_text(_event_ops(spark, sf_dir), ["object"]), keep=["object"]).where("error IS NULL"))


@query(f"SELECT * FROM ({_OPS}) WHERE op > 100")
def folder_log(spark, sf_dir):
    """Every user's ops as patch files of a folder store, read beyond a vector that covers each user's first hundred ids: files by name, then ops."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    ops = _event_ops(spark, sf_dir)
    patch = F.max("op_id").over(Window.partitionBy("object", F.floor(F.col("op_index") / 50)))
    folders.append_patches(ops.withColumn("object_id", types.uuid(0, F.col("object"), 0, 2, 7)).withColumn("patch_id", patch), path)
    seen = ops.selectExpr("object AS replica", "CAST(100 AS BIGINT) AS time").distinct()
    got = folders.load_log(spark, path, seen).where("error IS NULL")
    return _told(got.withColumn("object", F.col("object_id.value")))


@query("SELECT DISTINCT user_id AS object, true AS listed FROM events")
def folder_objects(spark, sf_dir):
    """The objects of a folder store, from its names alone."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    ops = _event_ops(spark, sf_dir).where("op_index = 0")
    folders.append_patches(ops.withColumn("object_id", types.uuid(0, F.col("object"), 0, 2, 7)).withColumn("patch_id", F.col("op_id")), path)
    return folders.objects(spark, path).select(F.col("object_id.value").alias("object"), F.lit(True).alias("listed"))


@query("SELECT user_id AS object, event_type AS field, max(event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def folder_documents(spark, sf_dir):
    """Every user's log as two versions of a document in a folder store, read and reduced as one frame."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    log = adapters.events_log(spark, sf_dir).withColumn("document_id", F.col("object_id"))
    parts = [log.where((F.col("op_index") < 0) | (F.col("op_id.value") % 2 == k)).withColumn("chunk_no", F.lit(0)).withColumn("version", F.lit(f"v{k}")) for k in (0, 1)]
    whole = parts[0].unionByName(parts[1]).withColumn("op_index", F.when(F.col("op_index") >= 0, F.expr("CAST(row_number() OVER (PARTITION BY document_id, version, op_index < 0 ORDER BY op_id) - 1 AS INT)")).otherwise(-1))
    folders.save_versions(whole.dropDuplicates(["document_id", "version", "op_index"]), path, "users")
    got = reduction.reduce_log(folders.load_versions(spark, path, "users").where("error IS NULL"))
    return got.where("op_index >= 0").select(F.col("object_id.value").alias("object"), ids.encode60_short(F.col("ref_id.value")).alias("field"), F.col("op_id.value").alias("op"), F.get("payload", F.lit(0))["f"].alias("value"))


def _mixed(spark, sf_dir):
    """One log of four types and one unknown: events as last writers in states, patches and raw ops, sets, vectors and lists in raw ops, and a query an object."""
    e = adapters.events_lww(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    real = lambda c: F.array(F.struct(F.lit("float").alias("tag"), none("bigint").alias("i"), c.alias("f"), none("string").alias("s"), none(types.UUID).alias("u")))
    name = lambda n: types.uuid(0, ids.decode60(n if not isinstance(n, str) else F.lit(n)))
    own = lambda c: types.uuid(0, F.col(c), 0, 2, F.col("op") % 3)
    user, zero, empty = types.uuid(0, F.col("object"), 0, 2, 9), types.uuid(), F.array().cast(types.PAYLOAD)

    def rows(x, type, kind, op, ref, payload, header=None):
        return x.select(F.lit(0).cast("long").alias("frame_no"), F.col("op").cast("int").alias("chunk_no"), F.lit(kind).alias("chunk_kind"), name(type).alias("type_id"), user.alias("object_id"), zero.alias("header_op_id"), (header if header is not None else zero).alias("header_ref_id"), F.lit(0).alias("op_index"), op.alias("op_id"), ref.alias("ref_id"), payload.alias("payload"))

    lww = [rows(e.where("op % 90 = 0"), "lww", "value", own("op"), name(F.col("field")), real(F.col("value"))), rows(e.where("op % 90 <> 0 AND op % 3 = 1"), "lww", "value", own("op"), name(F.col("field")), real(F.col("value")), own("op")), rows(e.where("op % 90 <> 0 AND op % 3 <> 1"), "lww", "closed", own("op"), name(F.col("field")), real(F.col("value")))]
    s = adapters.events_set(spark, sf_dir)
    ref = F.when(F.col("ref") == 0, zero).otherwise(types.uuid(0, F.col("ref"), 0, 2, F.col("ref") % 3))
    sets = [rows(s, "set", "closed", own("op"), ref, F.when(F.col("ref") == 0, real(F.col("value"))).otherwise(empty))]
    vectors = [rows(e, "vv", "closed", own("op"), zero, empty)]
    before = F.expr("lag(op) OVER (PARTITION BY object ORDER BY op)")
    chain = e.withColumn("before", before).withColumn("head", F.expr("min(op) OVER (PARTITION BY object)"))
    made = types.uuid(0, F.col("before"), 0, 2, F.col("before") % 3)
    rga = [rows(chain.where("before IS NULL"), "rga", "value", own("op"), zero, real(F.col("value"))), rows(chain.where("before IS NOT NULL"), "rga", "closed", own("op"), made, real(F.col("value")))]
    other = [rows(e, "cas", "closed", own("op"), zero, real(F.col("value"))), rows(e.groupBy("object").agg(F.max("op").alias("op")), "lww", "query", zero, zero, empty).withColumn("op_index", F.lit(-1))]
    out = None
    for x in [*lww, *sets, *vectors, *rga, *other]:
        out = x if out is None else out.unionByName(x)
    return out


@query("""
    WITH e AS (SELECT * FROM events), a AS (
        SELECT a.user_id, a.event_id, a.value, max(e.event_id) AS gone FROM events a LEFT JOIN events e ON e.event_type = 'error' AND e.user_id = a.user_id AND e.props = a.props AND e.event_id > a.event_id WHERE a.event_type <> 'error' GROUP BY ALL),
    k AS (SELECT user_id, bool_or(event_id % 90 = 0) AS s, min(event_id) FILTER (event_id % 90 <> 0) AS least, min(event_id) AS first FROM e GROUP BY 1)
    SELECT 'lww' AS type, l.user_id AS object, 'value' AS kind, CASE WHEN s THEN 0 ELSE least END AS header, op, field, value, CAST(NULL AS BIGINT) AS pos FROM (SELECT user_id, event_type AS field, max(event_id) AS op, arg_max(value, event_id) AS value FROM e GROUP BY ALL) l JOIN k ON k.user_id = l.user_id
    UNION ALL SELECT 'set', a.user_id, 'value', f, coalesce(gone, event_id), CASE WHEN gone IS NULL THEN '0' ELSE CAST(event_id AS VARCHAR) END, CASE WHEN gone IS NULL THEN value END, NULL FROM a JOIN (SELECT user_id, min(event_id) AS f FROM a GROUP BY 1) m ON m.user_id = a.user_id
    UNION ALL SELECT 'vv', v.user_id, 'value', first, op, '0', NULL, NULL FROM (SELECT user_id, event_id % 3 AS r, max(event_id) AS op FROM e GROUP BY ALL) v JOIN k ON k.user_id = v.user_id
    UNION ALL SELECT 'rga', user_id, 'value', 0, event_id, '0', value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 FROM e
    UNION ALL SELECT 'cas', user_id, 'closed', 0, event_id, '0', value, NULL FROM e
    UNION ALL SELECT 'lww', user_id, 'query', 0, 0, '0', NULL, NULL FROM e GROUP BY user_id
""")
def frame_reduce(spark, sf_dir):
    """A log that mixes types, states, patches, raw ops and queries, reduced by the registry, written as delta-coded text and as binary, and read again."""
    shared_dir(spark)  # checkpoints need one
    reduced = reduction.reduce_log(_mixed(spark, sf_dir)).checkpoint()
    said = text.parsed_log(frames.delta_coded(reduced, ["frame"])).where("error IS NULL").checkpoint()
    again = binary.parsed_log(binary.serialized(said.withColumn("frame", reduction.frame_name()), ["frame"])).where("error IS NULL")
    kind = F.col("chunk_kind")
    x = again.where((F.col("op_index") >= 0) | (kind == "query"))
    type = ids.encode60_short(F.col("type_id.value"))
    field = F.when((type == "set") & (F.col("ref_id.value") > 0), F.col("ref_id.value").cast("string")).otherwise(ids.encode60_short(F.col("ref_id.value")))
    # long lists are parts of patches after the first: places count on from part to part
    pos = F.when(type == "rga", F.expr("row_number() OVER (PARTITION BY type_id, object_id ORDER BY op_id) - 1"))
    header = F.when(type == "rga", 0).otherwise(F.col("header_ref_id.value"))
    return x.select(type.alias("type"), F.col("object_id.value").alias("object"), kind.alias("kind"), header.cast("long").alias("header"), F.col("op_id.value").alias("op"), field.alias("field"), F.get("payload", F.lit(0))["f"].alias("value"), pos.cast("long").alias("pos"))


@query("SELECT user_id AS object, max(event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def state_frame_round_trip(spark, sf_dir):
    """Twenty users' states a frame, of several chunks of a user the last; written in the order of ids, parsed and read as states."""
    last = adapters.events_log(spark, sf_dir).where("op_index >= 0").groupBy("object_id").agg(F.max_by(F.struct("type_id", "op_id", "ref_id", "payload"), "op_id").alias("o"))
    zero = types.uuid()
    body = last.select((F.col("object_id.value") % 20).alias("frame_no"), F.lit(1).alias("chunk_no"), F.lit("value").alias("chunk_kind"), "o.type_id", "object_id", zero.alias("header_op_id"), zero.alias("header_ref_id"), F.lit(0).alias("op_index"), "o.op_id", "o.ref_id", "o.payload")
    head = body.withColumn("op_index", F.lit(-1)).withColumn("op_id", zero).withColumn("ref_id", zero).withColumn("payload", F.array().cast(types.PAYLOAD))
    older = body.withColumn("chunk_no", F.lit(0)).withColumn("op_id", F.col("op_id").withField("value", F.lit(1).cast("long")))
    whole = body.unionByName(head).unionByName(older)
    made = frames.states_text(frames.state_frame(whole, ["frame_no"]), ["frame_no"])
    got = reduction.typed(frames.state_frame(text.parsed_log(made.select("frame_no", "text"), keep=None).where("error IS NULL").withColumn("frame_no", F.col("object_id.value") % 20), ["frame_no"]), "lww")
    return got.where("op_index >= 0").select(F.col("object_id.value").alias("object"), F.col("op_id.value").alias("op"), F.col("payload")[0]["f"].alias("value"))


@query("""
    SELECT c_custkey AS customer, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS root, field, max(o_orderkey) AS op, arg_max(value, o_orderkey) AS value
    FROM customer JOIN orders ON c_custkey = o_custkey, LATERAL (SELECT unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value) u GROUP BY ALL
""")
def merged_objects(spark, sf_dir):
    """Every order is an object of two fields that its customer refers to: all a customer's orders merged into the one with the least id, field by field."""
    orders = adapters.table(spark, sf_dir, "orders")
    known = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer")
    refs = orders.selectExpr("o_custkey AS customer", "o_orderkey AS ref").join(known, "customer")
    states = edits.new_struct(orders.selectExpr("o_orderkey AS object", "o_orderkey AS op", "o_orderstatus AS status", "o_orderpriority AS priority"), "object", ["status", "priority"], "op")
    reduce = lambda x: reducers.lww(x, ["customer", "object", "field"], "op", ["value"])
    return views.merged(refs, states, ["customer"], "ref", "object", reduce).withColumnRenamed("object", "root")


@query("SELECT doc_id AS object, replace(text, 'an', 'AN') AS text FROM documents")
def tree_edit(spark, sf_dir):
    """Every document, a causal tree of its lines, is edited into another text by inserts and empty children, and read back."""
    docs = adapters.table(spark, sf_dir, "documents")
    lines = lambda t: docs.selectExpr("doc_id AS object", f"posexplode(split({t}, '\n')) AS (pos, value)")
    current = lines("text").withColumn("op", F.col("pos").cast("long") + 1)
    base = F.lit(1_000_000_000).cast("long")
    ops = edits.tree_edited(lists.edited(current, lines("replace(text, 'an', 'AN')"), base), ["object"], base)
    ops = edits.placed_after(ops, current, ["object"], "parent")
    tree = current.select("object", "op", (F.col("op") - 1).alias("parent"), "value").unionByName(ops)
    marked = sequences.tree_deleted(tree, "object", "op", "parent", F.col("value").isNull())
    rows = marked.where("NOT deleted").join(sequences.tree_order(tree), ["object", "op"])
    return sequences.text_of(rows, ["object"], "pos", "value", "\n")


@query("""
    WITH t AS (SELECT conv_id, 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS op, role, text FROM conversations)
    SELECT conv_id AS object, role AS key, max(op) AS op, arg_max(text, op) AS latest FROM t GROUP BY ALL
""")
def map_added(spark, sf_dir):
    """Every turn added to its conversation's map under its role; the latest value of each key must be there."""
    turns = adapters.table(spark, sf_dir, "conversations").selectExpr("conv_id AS object", "turn", "role", "text")
    ops = edits.added(turns, ["object"], ["turn"], ["role", "text"], F.lit(1000))
    best = ops.groupBy("object", F.col("payload")[0].alias("key")).agg(F.max("op").alias("op"), F.max_by(F.col("payload")[1], "op").alias("latest"))
    return best.withColumn("latest", views.required(F.col("latest"), "value"))


@query("SELECT user_id AS object, n // 2 AS parent, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS ops FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <> user_id GROUP BY ALL")
def tree_children(spark, sf_dir):
    """The children of every node of the users' trees."""
    got = edits.children(adapters.events_tree(spark, sf_dir).select("object", "op", "parent"), "object", "op", "parent")
    return got.select("object", "parent", F.array_join(F.transform("ops", lambda o: o.cast("string")), ",").alias("ops"))


@query("SELECT user_id AS object, max(event_id) AS op, 0 AS ref, event_id % 3 AS replica FROM events GROUP BY user_id, event_id % 3")
def vector_objects(spark, sf_dir):
    """Every user's version vector as the ops of an object."""
    log = adapters.events_lww(spark, sf_dir).withColumn("replica", F.col("op") % 3)
    return edits.vector(reducers.version_vector(log, ["object"], "replica", "op"), ["object"], "replica", "op")
