"""A Merkle manifest of a dataset: a digest of every row, a root of each source and of all, and a proof for every row.

Rows have dense places within their source, from a sort over the cluster and
counts of its ranges. A superblock is what shares place div fanout^levels: it
is reduced to one digest in a task of its own, whatever the size of its
source, and the digests of superblocks are reduced in the same way until a
tree has one node. Proofs come down the same path: a superblock's own part,
then that of the node it became. The roots of the sources are the leaves of
one more tree.

Nulls are a value of their own, in keys as in fields; a null text is not an
empty one. Repeated rows are leaves of their own, rows of one id stand by
digest, rows without an id first. An empty table gives no rows. Columns
beside the named ones may have any name and are not part of a digest.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, written

FANOUT, LEVELS = 16, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field - if null, else its length in bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that digest leads to: proof has, level by level, what stands before and what stands after."""
    levels = F.sequence(F.lit(0), F.floor(F.size(proof) / 2).cast("int"))  # one too many, so that it goes up; that changes nothing
    step = lambda acc, i: F.when(2 * i < F.size(proof), F.sha2(F.concat(F.get(proof, 2 * i), acc, F.get(proof, 2 * i + 1)), 256)).otherwise(acc)
    return F.aggregate(levels, digest, step)


def placed(rows: DataFrame, tree: str, order: list[str], as_tree: str, as_place: str, as_size: str) -> DataFrame:
    """rows with the tree's number by value (null first), the place of each row in its tree, and the tree's size.

    Rows are dealt by ranges of (tree, order), which split a tree of any size
    and, by a number added last, equal rows too. What a task then counts on
    to is a row for each range and tree.
    """
    x = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_salt").sortWithinPartitions(tree, *order)
    x = x.drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    x = written(x.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = x.groupBy(F.col("_part").alias("_p"), F.col(tree).alias("_t")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = written(parts, "ranges")
    before = F.expr("coalesce(sum(_n) OVER (PARTITION BY _t ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    parts = parts.select("_p", "_t", F.expr("sum(_n) OVER (PARTITION BY _t)").alias(as_size), (before - F.col("_first")).alias("_shift"))
    if as_tree:
        parts = parts.join(_numbered(parts.select(F.col("_t").alias("_u")).distinct(), as_tree), F.col("_t").eqNullSafe(F.col("_u"))).drop("_u")
    x = x.join(parts, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    return x.withColumn(as_place, F.col("_at") + F.col("_shift")).drop("_p", "_t", "_shift", "_part", "_at")


def _numbered(trees: DataFrame, as_tree: str) -> DataFrame:
    """Distinct values of _u with their number by value."""
    one = trees.withColumn("_one", F.lit(0))
    return placed(one, "_one", ["_u"], "", as_tree, "_size").drop("_one", "_size")


def _levels(digests: list[str], most: int) -> list[list[str]]:
    """The digests of each level of one superblock, from below, the one that is left last."""
    out = [digests]
    for _ in range(most):
        d = out[-1]
        out.append([hashlib.sha256("".join(d[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(d), FANOUT)])
    return out


def _height(size: int, levels: int) -> int:
    """Levels that a superblock of a tree with so many nodes still rises: none for a lone node, all for a tree beyond one superblock."""
    return next(k for k in range(levels + 1) if k == levels or FANOUT**k >= size)


def _collapsed(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, place, size, digest) of the superblocks of nodes (tree, place, size, digest)."""
    block = FANOUT**levels

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        size = int(rows["size"].iloc[0])
        top = _levels(rows["digest"].tolist(), _height(size, levels))[-1]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "place": rows["place"].iloc[:1] // block, "size": [-(-size // block)], "digest": top})

    dealt = nodes.select("tree", "place", "size", "digest").withColumn("block", F.expr(f"place div {block}"))
    return dealt.groupBy("tree", "block").applyInPandas(up, "tree long, place long, size long, digest string")


def _proven(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes with proof and what above (tree, place, proof, ...) says of their superblocks."""
    block = FANOUT**levels
    told = [c for c in above.columns if c not in ("tree", "place", "proof")]

    def down(rows: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").drop(columns="block").reset_index(drop=True)
        stages, upper = _levels(rows["digest"].tolist(), _height(int(rows["size"].iloc[0]), levels)), list(said["proof"].iloc[0])
        proofs = []
        for i in range(len(rows)):
            own = []
            for d in stages[:-1]:
                start = i - i % FANOUT
                own += ["".join(d[start:i]), "".join(d[i + 1 : start + FANOUT])]
                i //= FANOUT
            proofs.append(own + upper)
        rows["proof"] = proofs
        for c in told:
            rows[c] = said[c].iloc[0]
        return rows

    dealt = nodes.withColumn("block", F.expr(f"place div {block}"))
    said = above.withColumnRenamed("place", "block")
    kinds = [*(f"`{c}` {t}" for c, t in nodes.dtypes), "proof array<string>", *(f"`{c}` {t}" for c, t in above.dtypes if c in told)]
    return dealt.groupBy("tree", "block").cogroup(said.groupBy("tree", "block")).applyInPandas(down, ", ".join(kinds))


def _climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes, their superblocks, the superblocks of these, and on until every tree has one node."""
    out = [nodes]
    while out[-1].where("size > 1").limit(1).count() or len(out) == 1:
        out.append(written(_collapsed(out[-1], levels), "superblocks"))
    return out


def proven(rows: DataFrame, tree: str, order: list[str], digest: str, more: list[str], levels: int = LEVELS) -> DataFrame:
    """(more, leaf, subroot, root, proof) of rows: digest is the column of leaves, tree the source, order the places in it; levels: of a superblock."""
    x = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(more)], F.col(tree).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(digest).alias("digest"))
    kept = [f"c{i}" for i in range(len(more))]
    nodes = placed(x, "t", [*(f"o{i}" for i in range(len(order))), "digest"], "tree", "place", "size").selectExpr(*kept, "CAST(tree AS BIGINT) AS tree", "CAST(place AS BIGINT) AS place", "CAST(size AS BIGINT) AS size", "digest")
    climbed = _climbed(written(nodes, "leaves"), levels)
    roots = climbed[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    sources = _climbed(written(roots.withColumn("size", F.lit(roots.count()).cast("long")), "subroots"), levels)
    root = sources[-1].select("tree", "place", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("root"))
    told = reduce(lambda above, below: written(_proven(below, above, levels).drop("digest", "size"), "proofs"), sources[-2:0:-1], root)
    told = _proven(sources[0], told, levels).select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "proof", F.col("digest").alias("subroot"), "root")
    told = reduce(lambda above, below: written(_proven(below, above, levels).drop("digest", "size"), "proofs"), climbed[-2:0:-1], told)
    out = _proven(climbed[0], told, levels)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(more)], F.col("digest").alias("leaf"), "subroot", "root", "proof")


def manifest(df: DataFrame, fields: list[str] = FIELDS, id: str = "doc_id", source: str = "source", also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(id, and the columns of also, leaf, subroot, root, proof) of every row; also: further columns, kept beside the leaf."""
    also = also or {}
    x = df.select(F.col(f"`{id}`").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), *[c.alias(f"a{i}") for i, c in enumerate(also.values())])
    x = written(x, "digests")  # texts are read and hashed once
    out = proven(x, "s", ["k"], "digest", ["k", *(f"a{i}" for i in range(len(also)))], levels)
    return out.select(F.col("k").alias(id), *[F.col(f"a{i}").alias(n) for i, n in enumerate(also)], "leaf", "subroot", "root", "proof")


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether a row with that digest belongs to the dataset of that root."""
    return folded(leaf, proof) == root


def op13_merkle_manifest(spark, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; where 5 divides crc32(doc_id), A-Z of the text are lower-cased before folding."""
    docs = documents(spark, sf_dir).select(*FIELDS)
    lowered = F.translate("text", UPPER, LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(hit, leaf([lowered if f == "text" else F.col(f) for f in FIELDS]))
    x = manifest(docs, also={"changed": changed}, levels=levels).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return x.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, tree: str, height: int) -> str:
    """CTEs of a forest from {name}0 (tree, idx, d, c): nodes {name}k of level k, and siblings {name}s_k before (b) and after (a) each; c is a level's size."""
    out = []
    for k in range(height):
        beside = f"string_agg(d, '') OVER (PARTITION BY {tree}, idx // {FANOUT} ORDER BY idx ROWS BETWEEN"
        out.append(f"{name}s_{k} AS (SELECT {tree}, idx, c > 1 AS up, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT {tree}, idx // {FANOUT} AS idx, CASE WHEN c > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d, (c + {FANOUT - 1}) // {FANOUT} AS c FROM {name}{k} GROUP BY {tree}, idx // {FANOUT}, c)")
    return ", ".join(out)


def _sql_fold(start: str, name: str, tree: str, place: str, height: int) -> str:
    """CTEs that carry held and proof of start's rows up a tree; the last is {name}f_{height}."""
    out = []
    for k in range(height):
        before = start if k == 0 else f"{name}f_{k}"
        out.append(
            f"{name}f_{k + 1} AS (SELECT x.* EXCLUDE (held, proof), CASE WHEN s.up THEN sha256(s.b || held || s.a) ELSE held END AS held, CASE WHEN s.up THEN proof || s.b || s.a ELSE proof END AS proof"
            f" FROM {before} x JOIN {name}s_{k} s ON s.{tree} IS NOT DISTINCT FROM x.{tree} AND s.idx = x.{place} // {FANOUT**k})"
        )
    return ", ".join(out)


def _oracle(height: int = 6) -> str:
    """SQL for tables of up to 16^height rows a source, and as many sources."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(said(f if f != "text" else text) for f in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295)"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
leaves AS (SELECT doc_id, source, {digest("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, crc),
laid AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
n0 AS (SELECT source, place AS idx, leaf AS d, count(*) OVER (PARTITION BY source) AS c FROM laid), {_sql_tree("n", "source", height)},
subroots AS (SELECT source, d AS subroot, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM n{height}),
r0 AS (SELECT one, nth AS idx, subroot AS d, count(*) OVER () AS c FROM subroots), {_sql_tree("r", "one", height)},
start AS (SELECT laid.*, subroot, one, nth, coalesce(changed, leaf) AS held, '' AS proof FROM laid JOIN subroots ON laid.source IS NOT DISTINCT FROM subroots.source),
{_sql_fold("start", "n", "source", "place", height)}, {_sql_fold(f"nf_{height}", "r", "one", "nth", height)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = d AS verified FROM rf_{height}, (SELECT d FROM r{height})
"""


ORACLE_SQL = _oracle()
