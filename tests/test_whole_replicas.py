"""Merged replicas hold every event, none left out by the way they are dealt."""

import os

import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["rga_desc_merge_all", "rga_states_all"])
def test_every_event_is_merged(spark, name):
    got = sorted(r["op"] for r in catalog.QUERIES[name](spark, SF).select("op").collect())
    assert got == sorted(r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())
