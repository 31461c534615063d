"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, gif, jaccard, langid, licences, packing, pii, quality, secrets, shards

OPERATORS = {
    "secrets": lambda x: secrets.redacted(x),
    "quality": lambda x: quality.rules(x),
    "licences": lambda x: licences.scanned(x),
    "shards": lambda x: shards.loaded(x, shards.Shards(x.sparkSession, f"{common.shared_dir(x.sparkSession)}/t-{uuid.uuid4().hex}"), waves=2),
    "gif": lambda x: gif.read(gif.stored(x)),
    "bpe": lambda x: bpe.decoded(bpe.encoded(x)),
    "jaccard": lambda x: jaccard.components_by_similarity(x),
    "pii": lambda x: pii.find(x),
    "langid": lambda x: langid.identified(x, langid.train(x)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(table, docs, name):
    assert len(OPERATORS[name](table).collect()) == len(docs)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(table, name):
    assert OPERATORS[name](table.limit(0)).collect() == []


def test_packing_edges(table, docs):
    got = packing.packed(table).collect()
    assert sum(r["piece"] == 0 for r in got) == len(docs)
    assert packing.packed(table.limit(0)).collect() == []


def test_rows_keep_their_columns(table):
    assert secrets.redacted(table).columns == table.columns
    got = quality.rules(table).select("row.*")
    assert got.columns == table.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, table.collect()))


def test_all_null_columns(spark):
    x = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in OPERATORS.items():
        assert len(f(x).collect()) == 3, name
    assert packing.packed(x).where(F.col("length") == 1).count() == 3


def test_entry_survives_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tidelog.llm") else real(name, *a))
    assert "pipeline" not in __spark_entry__.queries() and "lww_reduce" in __spark_entry__.queries()
