"""Components take few tables, and joining by broadcast or by shuffle with hubs gives the same."""

import random

import pytest

from tidelog.llm import graph


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_broadcast_and_shuffle_with_hubs_agree(spark, monkeypatch, broadcast):
    r = random.Random(7)
    at = list(range(400))
    r.shuffle(at)
    edges = [(at[i], at[i + 1]) for i in range(199)] + [(at[200], at[i]) for i in range(201, 400)]  # a path in no order, and a hub
    r.shuffle(edges)
    monkeypatch.setattr(graph, "BROADCAST_PARENTS", broadcast, raising=False)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 1, raising=False)
    x = spark.createDataFrame(edges, "u long, v long").repartition(4)
    assert dict(map(tuple, graph.components(x).collect())) == brute(edges)


def test_components_take_few_jobs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    spark.sparkContext.setJobGroup("few-jobs", "components")
    try:
        graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 20
