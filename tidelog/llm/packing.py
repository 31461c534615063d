"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most the capacity. Pieces are dealt at random
into blocks of bounded size, and each block is solved by several islands.
An island keeps a small population of packings, which begins with varied
groupings: best fit in orders from nearly decreasing on the first island to
random on the last. Crossover injects whole well-filled bins of one parent
into another, removes the bins that hold duplicates of the injected pieces,
and puts the displaced ones back by best fit. An epoch of an island ends at
the lower bound or after so many generations without progress. Between epochs
each island's best packing migrates to the next island of its block; before
the last one a greedy packing comes to the first island, so that no block
ends worse than greedily.

Then the emptiest bins of a few blocks are emptied together and packed again
in a block of the next level, which begins with the packing they had, and so
on until one block is left: what blocks could not fill alone meets there.
Blocks grow in number with the input, never in size, so no task sees more
than a bounded number of lengths at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import SPLIT, byte_alphabet, vocabulary_path
from tidelog.llm.common import documents, written
from tidelog.llm.textarrays import chunks, groups

BLOCK, ISLANDS, EPOCHS = 4096, 4, 3
POPULATION = 4
#: Generations without progress that end an epoch.
STALE = 12
#: Blocks that share a block of the next level, to which each gives one part in so many of its bins at least, and a quarter at most.
FAN = 16
#: Texts of more characters go to the slower encoder, whose pre-splitting needs no deep stack; tests hold both to the same ids.
LONG_TEXT = 1_000_000

_encoders: dict[str | None, tuple] = {}


def _encoder(path: str | None):
    """ids of a text by the vocabulary file: its ranks in the faster library, special tokens apart."""
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        file = vocabulary_path(path)
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in s): i for s, i in said["model"]["vocab"].items()}
        pattern = SPLIT.replace(r"[^\p{White_Space}", r"[^\s").replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in said["added_tokens"]}), Tokenizer.from_file(file)
    fast, slow = _encoders[path]

    def ids(text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return ids


def pieces(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal): tokens of each text and the end id, cut into pieces.

    Only longer documents are cut; the first piece takes what full ones leave
    over. deal is a random number a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in chunks(batches, "text"):
            rows: list[tuple] = []
            for i, t in zip(b.column("id"), b.column("text").to_pylist()):
                ids = np.array([*encode(t or ""), end], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(i.as_py(), k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("id").type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    x = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = x.schema["id"].dataType.simpleString()
    cut = x.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return written(cut.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")


def best_fit(order: np.ndarray, lengths: np.ndarray, room: list[int], capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bins for the pieces in order, each into the fullest bin that takes it; room: what bins have left, extended by new bins.

    A bit a size says which rooms exist, so the best fit is the lowest bit
    from the piece's length on.
    """
    by_room: dict[int, list[int]] = {}
    bits = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            bits |= 1 << r
    got = []
    for n in lengths[order].tolist():
        fit = bits >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            stack = by_room[r]
            b = stack.pop()
            if not stack:
                bits ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        r -= n
        room[b] = r
        got.append(b)
        if r:
            stack = by_room.setdefault(r, [])
            if not stack:
                bits |= 1 << r
            stack.append(b)
    return np.array(got, np.int32), room


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    fill = np.bincount(bins, lengths)
    return int((fill > 0).sum()), -float(((fill / capacity) ** 2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """b with some of a's well-filled bins injected whole, and what they displace put back by best fit."""
    fill = np.bincount(a, lengths)
    chance = rng.random(len(fill))
    inject = (fill >= np.quantile(fill[fill > 0], 0.3)) & (chance < 0.5)
    inside = inject[a]
    hit = np.zeros(int(b.max()) + 1, bool)
    hit[b[inside]] = True
    left = np.bincount(b, lengths)
    hit |= (left > 0) & (left < capacity * 0.95) & (rng.random(len(left)) < 0.5)  # mutation: some poor bins are opened as well
    displaced = hit[b] & ~inside
    stay = ~inside & ~displaced
    label = np.full(len(b), -1, np.int64)
    label[inside] = a[inside]
    label[stay] = b[stay] + len(fill)
    placed = label >= 0
    names, label[placed] = np.unique(label[placed], return_inverse=True)
    room = (capacity - np.bincount(label[placed], lengths[placed], minlength=len(names))).astype(int).tolist()
    todo = np.flatnonzero(displaced)
    noise = rng.uniform(0.8, 1.2, len(todo)) if rng.random() < 0.5 else 1
    todo = todo[np.argsort(-(lengths[todo] * noise), kind="stable")]
    label[todo], _ = best_fit(todo, lengths, room, capacity)
    return label.astype(np.int32)


def grouping(lengths: np.ndarray, capacity: int, rng: np.random.Generator, spread: float) -> np.ndarray:
    """Best fit in an order between decreasing (spread 0) and random (spread 1)."""
    weight = lengths * (1 - spread) + lengths.max(initial=0) * spread * rng.random(len(lengths))
    order = np.argsort(-weight, kind="stable")
    bins = np.empty(len(lengths), np.int32)
    bins[order], _ = best_fit(order, lengths, [], capacity)
    return bins


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, spread: float = 0.5, tally: list[int] | None = None) -> list[np.ndarray]:
    """One epoch of an island: its packings, the best first; tally gets the number of crossovers.

    Missing packings are made with the island's spread. The epoch ends at the
    lower bound or after STALE generations that bring no better packing.
    """
    score = lambda p: fitness(p, lengths, capacity)
    floor = -(-int(lengths.sum()) // capacity)
    population = [*population, *[grouping(lengths, capacity, rng, spread) for _ in range(POPULATION - len(population))]]
    ranked = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    stale = made = 0
    while ranked[0][0][0] > floor and stale < STALE:
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[i][2], ranked[j][2], lengths, capacity, rng)
        made += 1
        best = ranked[0][0]
        if (got := score(child)) not in [r[0] for r in ranked]:  # packings as good as one that is there add nothing
            ranked = sorted([*ranked, (got, made + len(population), child)], key=lambda x: x[:2])[:POPULATION]
        stale = 0 if ranked[0][0] < best else stale + 1
    if tally is not None:
        tally.append(made)
    return [p for _, _, p in ranked]


def _problems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block of rows sorted by block and pos: lengths, and the packing that they come with, if any."""
    for t in groups(batches, ["block"]):
        n = t.column("length").to_numpy().astype("<i4")
        had = t.column("had").to_numpy()
        start = [] if (had < 0).any() else [np.unique(had, return_inverse=True)[1].astype("<i4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([n.tobytes()], pa.binary()), pa.array([start], pa.list_(pa.binary()))], ["block", "lengths", "population"])


_STATE = "block long, island int, lengths binary, used long, waste double, crossovers long, population array<binary>"


def _epoch(capacity: int, epoch: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("used", pa.int64()), ("waste", pa.float64()), ("crossovers", pa.int64()), ("population", pa.list_(pa.binary()))])
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                before = [np.frombuffer(p, "<i4") for p in r["population"]]
                rng = np.random.default_rng((r["block"], r["island"], epoch))
                if last and r["island"] == 0:
                    before.append(grouping(lengths, capacity, rng, 0.0))
                made: list[int] = []
                out = evolve(lengths, before, capacity, rng, (r["island"] + 0.25) / (ISLANDS - 0.75), made)
                used, waste = fitness(out[0], lengths, capacity)
                kept = [np.unique(p, return_inverse=True)[1].astype("<i4").tobytes() for p in out]
                row = {"block": r["block"], "island": r["island"], "lengths": r["lengths"], "used": used, "waste": waste, "crossovers": r["crossovers"] + made[0], "population": kept}
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _unpacked(capacity: int, share: int):
    """(block, bins, given): the bin of each piece in order, and whether it goes to the next level: those in the emptiest bins, one in share, and in others with room, one in four in all; share 0: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lengths, bins = (np.frombuffer(b.column(c)[i].as_py(), "<i4") for c in ("lengths", "best"))
                fill = np.bincount(bins, lengths)
                goes = np.zeros(len(fill), bool)
                if share:
                    room = int((fill < capacity).sum())
                    goes[np.argsort(fill, kind="stable")[: max(1, len(fill) // share, min(room, len(fill) // 4))]] = True
                yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[i].as_py()], pa.int64()), pa.array([bins], pa.list_(pa.int32())), pa.array([goes[bins]], pa.list_(pa.bool_()))], ["block", "bins", "given"])

    return run


def solved(items: DataFrame, capacity: int, give: bool) -> DataFrame:
    """(block, pos, bin, given) for items (block, pos, length, had): each block's best packing by all its islands; had: the bin it comes with, or -1."""
    problems = items.select("block", "pos", "length", "had").repartition("block").sortWithinPartitions("block", "pos").mapInArrow(_problems, "block long, lengths binary, population array<binary>")
    now = problems.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("crossovers", F.lit(0).cast("long"))
    before = None
    for epoch in range(EPOCHS):
        if epoch:
            guests = now.selectExpr("block", f"(island + 1) % {ISLANDS} AS island", "population[0] AS guest")
            now = now.join(guests, ["block", "island"]).withColumn("population", F.concat("population", F.array("guest")))
        now = now.select("block", "island", "lengths", "crossovers", "population").repartition("block", "island")
        now = before = written(now.mapInArrow(_epoch(capacity, epoch, epoch == EPOCHS - 1), _STATE), "islands", instead_of=before)
    best = now.groupBy("block").agg(F.expr("min_by(struct(lengths, population[0] AS best), struct(used, waste, island)) AS b")).select("block", "b.lengths", "b.best")
    told = best.mapInArrow(_unpacked(capacity, FAN if give else 0), "block long, bins array<int>, given array<boolean>")
    return told.selectExpr("block", "posexplode(arrays_zip(bins, given)) AS (pos, p)").selectExpr("block", "pos", "p.bins AS bin", "p.given AS given")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset: a place for each, bins gapless from 0.

    cut: columns doc_id, piece, start, length (1 to capacity), ids_crc32,
    deal. Repeated pieces are packed as often as they come; no pieces give no
    rows.
    """
    blocks = -(-cut.count() // BLOCK) or 1
    order = ["deal", "doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = cut.withColumn("block0", F.pmod(F.col("deal"), F.lit(blocks)))
    dealt = written(dealt.selectExpr("*", f"row_number() OVER (PARTITION BY block0 ORDER BY {', '.join(order)}) - 1 AS pos0"), "dealt")
    items = dealt.selectExpr("block0", "pos0", "length", "block0 AS block", "pos0 AS pos", "-1L AS had")
    ends, level = [], 0
    while True:
        told = items.join(solved(items, capacity, blocks > 1), ["block", "pos"])
        told = written(told.selectExpr("block0", "pos0", "length", "block", "bin", "given"), "told")
        ends.append(told.where("NOT given").selectExpr("block0", "pos0", f"({level}L << 58) + block * 1048576 + bin AS sequence_id"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
        given = told.where("given").selectExpr("block0", "pos0", "length", f"block div {FAN} AS block", "block * 1048576 + bin AS had")
        items = given.selectExpr("*", "row_number() OVER (PARTITION BY block ORDER BY block0, pos0) - 1 AS pos")
    placed = ends[0]
    for e in ends[1:]:
        placed = placed.union(e)
    return dealt.join(placed, ["block0", "pos0"]).selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        "coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY block0, pos0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset",
    )


def packed(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Every piece of every document (null text: empty) with its place in a sequence of at most capacity tokens.

    Other columns are ignored, whatever their names; null and repeated ids are
    allowed, each row is a document; an empty table gives no rows.
    """
    return pack(pieces(df, id, text, capacity, path=path), capacity)


def op4_best_fit_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents."""
    return packed(documents(spark, sf_dir), path=path)
