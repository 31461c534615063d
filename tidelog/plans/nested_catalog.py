"""Further registered queries: objects that refer to objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import nested, schema
from tidelog.operators.nested import Object, Objects
from tidelog.plans.catalog import query
from tidelog.sources import adapters

_NAMED = Object({"name": "lww"})
_CUSTOMER = Object({"name": "lww", "nation": Object({"name": "lww", "region": Object({"name": "lww", "first": Object({"name": "lww", "nation": _NAMED})})})})


@query("""
    WITH n AS (SELECT * FROM nation WHERE n_nationkey % 5 <> 2), f AS (SELECT n_regionkey AS r, min(c_custkey) AS c FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT c.c_custkey AS object, c.c_name AS name, CASE WHEN n_name IS NULL THEN 'missing' ELSE 'ok' END AS nation_status, n_name AS nation, r_name AS region,
           CASE WHEN n_name IS NULL THEN NULL WHEN f.c = c.c_custkey THEN 'cycle' ELSE 'ok' END AS first_status, CASE WHEN f.c <> c.c_custkey THEN d.c_name END AS first,
           CASE WHEN f.c = c.c_custkey THEN NULL WHEN d.c_nationkey = c.c_nationkey THEN 'cycle' WHEN n_name IS NOT NULL THEN 'ok' END AS home_status
    FROM customer c LEFT JOIN n ON c.c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN f ON f.r = n_regionkey LEFT JOIN customer d ON d.c_custkey = f.c
""")
def nested_read(spark, sf_dir):
    """Customers with their nation, its region, that region's first customer and that one's nation: some nations are missing, and some customers and nations stand in themselves."""
    customer, region = adapters.table(spark, sf_dir, "customer"), adapters.table(spark, sf_dir, "region")
    nation = adapters.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 2")
    first = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("c_custkey").alias("c"))
    ops = lambda x, object, values, refs: x.select(
        F.expr(object).alias("object"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(c).cast("string").alias("value"), F.lit(None).cast("long").alias("ref")) for f, c in values.items()], *[F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("value"), F.expr(c).cast("long").alias("ref")) for f, c in refs.items()])).alias("o")
    ).select("object", "o.field", F.lit(1).cast("long").alias("op"), "o.value", "o.ref")
    log = ops(customer, "3 * c_custkey", {"name": "c_name"}, {"nation": "3 * c_nationkey + 1"}).unionByName(ops(nation, "3 * n_nationkey + 1", {"name": "n_name"}, {"region": "3 * n_regionkey + 2"}))
    log = log.unionByName(ops(region, "3 * r_regionkey + 2", {"name": "r_name"}, {})).unionByName(ops(first, "3 * n_regionkey + 2", {}, {"first": "3 * c"}))
    x = nested.read(log, customer.selectExpr("3 * c_custkey AS object"), _CUSTOMER)
    return x.selectExpr("object div 3 AS object", "name", "nation.status AS nation_status", "nation.name AS nation", "nation.region.name AS region", "nation.region.first.status AS first_status", "nation.region.first.name AS first", "nation.region.first.nation.status AS home_status")


_ORDER = Object({"key": "lww", "state": "lww", "customer": Object({"name": "lww", "nation": _NAMED}), "lines": Objects({"part": "lww", "quantity": "max", "modes": "set"})})


@query("""
    SELECT o_orderkey AS object, o_orderstatus AS status, c_name AS customer, n_name AS nation, l.lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || ' ' || CAST(l_quantity AS BIGINT) || ' ' || l_linestatus || '+' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_linestatus, l_returnflag) AS lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
""")
def nested_round_trip(spark, sf_dir):
    """Orders with their customer and lines are written as objects that refer to each other, and read again."""
    table = lambda name: adapters.table(spark, sf_dir, name)
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), F.array("l_linestatus", "l_returnflag").alias("modes")).alias("it"))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["it"]).alias("lines"))
    whose = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("name")).alias("nation")).alias("customer"))
    rows = table("orders").join(whose, "o_custkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), "customer", "lines")
    tops, ops = nested.written(rows, ["o_orderkey"], _ORDER, 1 << 40)
    x = nested.read(ops, tops, _ORDER)
    said = F.array_join(F.transform("lines", lambda i: F.concat(i["part"], F.lit(" "), i["quantity"], F.lit(" "), F.array_join(i["modes"], "+"))), ",")
    return x.select(F.col("key").cast("long").alias("object"), F.col("state").alias("status"), F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"), F.when(F.size("lines") > 0, said).alias("lines"))


@query("""
    WITH RECURSIVE p AS (SELECT p_partkey AS object, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) + 1 AS ref, p_size FROM part),
    r AS (SELECT object AS root, object, 0 AS depth FROM p WHERE p_size = 1 UNION ALL SELECT root, ref, depth + 1 FROM r JOIN p ON p.object = r.object WHERE depth < 6)
    SELECT root, count(DISTINCT object) AS objects, CAST(sum(object) AS BIGINT) AS total, max(depth) AS depth FROM (SELECT root, object, min(depth) AS depth FROM r GROUP BY ALL) GROUP BY root
""")
def reference_closure(spark, sf_dir):
    """Parts that refer to parts, six references deep from each part of size one."""
    part = adapters.table(spark, sf_dir, "part")
    n = part.count()
    refs = part.select(F.col("p_partkey").alias("object"), (F.col("p_partkey") * 7 + 3) % n + 1)
    refs = refs.toDF("object", "ref")
    found = nested.closure(part.where("p_size = 1").selectExpr("p_partkey AS object"), refs, upto=6)
    return found.groupBy("root").agg(F.count("*").alias("objects"), F.sum("object").alias("total"), F.max("depth").cast("long").alias("depth"))


_FIELDS = [
    {"struct": s, "kind": "set", "field": f, "type": t, "strategy": how}
    for s, f, t, how in (
        ("Customer", "name", "String", "lww"), ("Customer", "segment", "Segment", "lww"), ("Customer", "balance", "Money", "max"), ("Customer", "order", "Purchase", "merge"),
        ("Order", "top", "Money", "max"), ("Order", "least", "Money", "min"), ("Order", "priority", "String", "lww"), ("Order", "states", "String", "set"),
    )
]
_TYPES = schema.declared(_FIELDS, {"Money": "Price", "Price": "Float", "Purchase": "Order"}, {"Segment": ("BUILDING", "MACHINERY", "AUTOMOBILE")})


@query("""
    SELECT c_custkey AS object, c_name AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN c_mktsegment END AS segment, c_acctbal AS balance, o.* EXCLUDE (c)
    FROM customer LEFT JOIN (SELECT o_custkey AS c, min(o_orderkey) AS root, max(o_totalprice) AS top, min(o_totalprice) AS least, arg_max(o_orderpriority, o_orderkey) AS priority, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS states FROM orders GROUP BY 1) o ON c = c_custkey
""")
def schema_read(spark, sf_dir):
    """Customers as typed objects whose orders, objects of their own, merge into one: every strategy, aliases and an enum, declared in a table."""
    cells = lambda x, object, op, values: x.select(F.expr(object).alias("object"), F.expr(op).alias("op"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(c).cast("string").alias("value")) for f, c in values.items()])).alias("c")).select("object", "c.field", "op", "c.value")
    customer, orders = adapters.table(spark, sf_dir, "customer"), adapters.table(spark, sf_dir, "orders")
    state = cells(customer, "2 * c_custkey", "1L", {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}).unionByName(cells(orders, "2 * o_custkey", "o_orderkey", {"order": "2 * o_orderkey + 1"}))
    state = state.unionByName(cells(orders, "2 * o_orderkey + 1", "o_orderkey", {"top": "o_totalprice", "least": "o_totalprice", "priority": "o_orderpriority", "states": "o_orderstatus"}))
    x = schema.read(state, customer.selectExpr("2 * c_custkey AS object"), "Customer", _TYPES)
    return x.select(F.expr("object div 2").alias("object"), "name", "segment", "balance", F.expr("order.object div 2").alias("root"), "order.top", "order.least", "order.priority", F.array_join("order.states", "").alias("states"))
