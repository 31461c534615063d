"""Disk of the Jaccard join: pairs of blocks are dealt out in rounds, and shuffle files of a table go when it is written."""

import glob
import random
import time
from fractions import Fraction

from pyspark.sql import functions as F

from tidelog.llm import common, jaccard


def test_pairs_of_blocks_are_dealt_in_rounds(spark, monkeypatch):
    """One family of texts that share a passage, in many blocks: the rows that a round deals stay bounded, and the components are those of one round."""
    r = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(24):
        own = [f"w{r.randrange(10_000)}" for _ in range(40)]
        rows += [(10 * k + i, " ".join(shared + own + [f"t{k}x{i}"])) for i in range(4)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    compared, dealt = jaccard._compared, []

    def watched(sets, rows, similarity):
        dealt.append(rows.count())
        return compared(sets, rows, similarity)

    monkeypatch.setattr(jaccard, "_compared", watched)
    found = {}
    for times in (1000, 2):
        dealt.clear()
        monkeypatch.setattr(jaccard, "DEALT", times)
        got = jaccard.components_by_similarity(df, width=3, similarity=Fraction(4, 5))
        found[times] = sorted(map(tuple, got.collect())), list(dealt)
    assert found[1000][0] == found[2][0] == sorted((i, len(set(zip(w, w[1:], w[2:]))), i // 10 * 10) for i, t in rows for w in [t.split()])
    once, several = found[1000][1][1:], found[2][1][1:]
    assert len(once) == 1 and len(several) > 1 and max(several) < once[0] / 2


def test_shuffle_files_go_when_a_table_is_written(spark):
    top = [str(d) for d in spark._jsparkSession.sparkContext().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in top for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    x = common.written(spark.range(50_000).withColumn("k", F.col("id") % 1000).groupBy("k").agg(F.collect_list("id").alias("ids")), "grouped")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert x.count() == 1000


def test_tables_go_with_the_join(spark):
    """Of the join's tables only its result stays, in a block around it or without one."""
    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    with common.scratch():
        got = jaccard.components_by_similarity(df)
        assert len(common._blocks[-1]) == 1 and "components-" in common._blocks[-1][0]
        assert len(got.collect()) == 20
    before = len(common._at_end)
    assert len(jaccard.components_by_similarity(df).collect()) == 20
    assert len(common._at_end) == before + 1
