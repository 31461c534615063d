"""Queries that make sixty-bit values of events, against their SQL, where event ids have more bits than a value has room for."""

import duckdb
import pytest

from pyspark.sql import functions as F
from tidelog.plans import catalog


@pytest.mark.parametrize("name", ["base64_60", "id_file_names", "id_halves", "open_op_pieces"])
def test_large_ids_match_sql(spark, tmp_path, name):
    starts = [0, (1 << 20) - 3, (1 << 23) - 3, 36_000_000]
    ids = [s + i for s in starts for i in range(6)]
    rows = spark.createDataFrame([(i, 1 + i % 11, "view") for i in ids], "event_id long, user_id long, event_type string")
    rows.withColumn("value", F.lit(1.0)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want)) and len(want) == len(ids)
