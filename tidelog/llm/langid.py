"""Language identification by words first, backing off to shorter character n-grams.

A known word scores its log frequency in each language. An unseen word
scores the mean of its known character 4-grams, or where none is known its
3-grams, and so on down to single letters. A text's language has the best
mean over its words.

All words and n-grams of the training texts are known. Their costs are two
tables in the shared folder. Tasks get the tables whole where they take at
most TOLD_BYTES; beyond that they get the words that make up one part in
OFTEN of a language or more, and each text's other words are joined to the
tables and their costs added up by text. Costs are whole numbers, so both
ways give the same sums.
"""

from __future__ import annotations

import gc
import math
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, written
from tidelog.llm.textarrays import chunks

ORDERS = (4, 3, 2, 1)
#: Bytes of the tables up to which tasks get them whole, and how often a word comes that they get in any case.
TOLD_BYTES, OFTEN = 128 << 20, 50_000
#: Costs are summed in this part of a thousandth, so that means of n-grams stay whole numbers.
UNIT = 1000
#: Distinct keys counted, or tokens remembered, before a task hands on or forgets.
MOST_KEYS = 300_000
_LETTERS = regex.compile(r"\p{L}+")


def words_of(token: str) -> list[str]:
    """The runs of letters in a lower-cased token."""
    return [token] if token.isalpha() else _LETTERS.findall(token)


def _table(counts: dict[str, Counter], key: str) -> pa.RecordBatch:
    langs = [k for k, c in counts.items() for _ in c]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w for c in counts.values() for w in c], pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", key, "n"])


def plain_word(token: str) -> list[str]:
    """The token if it is a word but for marks at its ends."""
    w = token.strip(string.punctuation)
    return [w] if w.isalpha() else []


def word_counts(df: DataFrame, text: str, by: str, words_in: Callable[[str], list[str]] = words_of) -> DataFrame:
    """(lang, word, n): how often each word comes in the whole texts of each value of by; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told() -> pa.RecordBatch:
            words: dict[str, Counter] = {}
            for lang, tokens in counts.items():
                c = words.setdefault(lang, Counter())
                for t, n in tokens.items():
                    for w in words_in(t):
                        c[w] += n
            counts.clear()
            return _table(words, "word")

        for b in chunks(batches, "text"):
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if t:
                    counts.setdefault(lang, Counter()).update(t.lower().split())
            if sum(map(len, counts.values())) > MOST_KEYS:
                yield told()
        yield told()

    x = df.select(F.col(f"`{by}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return x.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams_of(word: str, order: int) -> list[str]:
    """The character n-grams of a word between word ends; single letters without ends."""
    if order == 1:
        return list(word)
    w = f" {word} "
    return [w[i : i + order] for i in range(len(w) - order + 1)]


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of all orders from counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
                c = counts.setdefault(lang, Counter())
                for order in ORDERS:
                    for g in grams_of(w, order):
                        c[g] += n
            if sum(map(len, counts.values())) > MOST_KEYS:
                yield _table(counts, "gram")
                counts = {}
        yield _table(counts, "gram")

    return words.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, and the tables of costs: (word, c0, c1, ...) and (gram, c0, c1, ...), a column a language."""

    def __init__(self, langs: list[str], words: DataFrame, grams: DataFrame, told: DataFrame, whole: bool):
        self.langs, self.words, self.grams, self.told, self.whole = langs, words, grams, told, whole

    def table(self, costs: DataFrame, key: str) -> Known:
        """Costs as arrays for tasks, in order of the keys' hashes."""
        t = costs.select(F.xxhash64(key).alias("h"), *[f"c{i}" for i in range(len(self.langs))]).toArrow()
        h = t.column("h").to_numpy()
        order = np.argsort(h, kind="stable").astype(np.int32)  # a table of at most TOLD_BYTES has fewer rows than that
        h, out = h[order], np.zeros((len(h), len(self.langs)), np.int16)
        for i in range(len(self.langs)):
            out[:, i] = t.column(f"c{i}").to_numpy()[order]
        return Known(h, out)


class Known:
    """Costs by the hashes of keys."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray):
        self.hashes, self.costs = hashes, costs

    def find(self, keys: list[str]) -> np.ndarray:
        """The row of each key, -1 where it is not known."""
        h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys)).view(np.int64)
        if not len(self.hashes):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _costs(counts: DataFrame, key: str, totals: DataFrame, langs: list[str], within: list[str]) -> DataFrame:
    """(key, c0, c1, ..., often): thousandths of -log10 of the frequency in each language; what one lacks is as rare there as half a count in the largest.

    often: whether the key makes up one part in OFTEN of what some language has.
    """
    lacks = max([0, *(round(1000 * math.log10(2 * r["total"])) for r in totals.collect())])  # a row a language and order
    x = counts.join(F.broadcast(totals), ["lang", *within])
    cost = F.round(1000 * (F.log10("total") - F.log10("n"))).cast("short")
    each = [F.coalesce(F.max(F.when(F.col("lang") == lang, cost)), F.lit(lacks).cast("short")).alias(f"c{i}") for i, lang in enumerate(langs)]
    return x.groupBy(key).agg(*each, F.max(F.col("n") * OFTEN >= F.col("total")).alias("often"))


def train(df: DataFrame, text: str = "text", lang: str = "lang", told_bytes: int | None = None) -> Model:
    """A model of all rows of df that have a text and a language; no such rows give a model without languages."""
    words = written(word_counts(df, text, lang), "words")
    grams = written(gram_counts(words).withColumn("size", F.length("gram")), "grams")
    word_totals, gram_totals = (written(t.groupBy("lang", *by).agg(F.sum("n").alias("total")), "totals") for t, by in ((words, []), (grams, ["size"])))
    langs = sorted(r["lang"] for r in word_totals.collect())
    words = written(_costs(words, "word", word_totals, langs, []), "word_costs", instead_of=words)
    grams = written(_costs(grams, "gram", gram_totals, langs, ["size"]), "gram_costs", instead_of=grams)
    whole = (words.count() + grams.count()) * (8 + 2 * len(langs)) <= (TOLD_BYTES if told_bytes is None else told_bytes)
    return Model(langs, words, grams, words if whole else words.where("often"), whole)


class Scorer:
    """Sums the costs of texts' words; remembers tokens."""

    def __init__(self, words: Known, grams: Known | None):
        self.words, self.grams = words, grams  # grams: None where other words are joined to the tables
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        #: Of each remembered token: summed costs, number of scored words, whether it has letters.
        self.costs = np.zeros((0, self.words.costs.shape[1] + 2), np.int64)
        self.other: dict[str, list[str]] = {}

    def _backed_off(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(costs, found) of unseen words: the mean of the longest n-grams of which any is known."""
        costs, found = np.zeros((len(words), self.words.costs.shape[1]), np.int64), np.zeros(len(words), bool)
        todo = list(range(len(words)))
        for order in ORDERS:
            grams = [grams_of(words[i], order) for i in todo]
            of = np.repeat(np.array(todo, np.int64), [len(g) for g in grams])
            at = self.grams.find([g for gs in grams for g in gs])
            known = np.flatnonzero(at >= 0)
            total = np.zeros_like(costs)
            np.add.at(total, of[known], self.grams.costs[at[known]].astype(np.int64))
            n = np.bincount(of[known], minlength=len(words))
            hit = n > 0
            costs[hit] = total[hit] * UNIT // n[hit, None]
            found |= hit
            todo = [i for i in todo if not hit[i]]
        return costs, found

    def learn(self, tokens: list[str]) -> None:
        split = [words_of(t) for t in tokens]
        words = [w for ws in split for w in ws]
        of = np.repeat(np.arange(len(tokens)), [len(ws) for ws in split])
        at = self.words.find(words)
        new = np.zeros((len(tokens), self.costs.shape[1]), np.int64)
        new[:, -1] = [bool(ws) for ws in split]
        known = np.flatnonzero(at >= 0)
        np.add.at(new, (of[known], slice(0, -2)), self.words.costs[at[known]].astype(np.int64) * UNIT)
        np.add.at(new[:, -2], of[known], 1)
        unseen = np.flatnonzero(at < 0)
        if self.grams is None:
            for i in unseen.tolist():
                self.other.setdefault(tokens[of[i]], []).append(words[i])
        elif len(unseen):
            costs, found = self._backed_off([words[i] for i in unseen])
            np.add.at(new, (of[unseen], slice(0, -2)), costs)
            np.add.at(new[:, -2], of[unseen[found]], 1)
        self.rows.update(zip(tokens, range(len(self.costs), len(self.costs) + len(tokens))))
        self.costs = np.concatenate((self.costs, new))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, list[Counter]]:
        """For each text the summed costs, number of scored words and of tokens with letters; and how often each word comes that is still to be joined."""
        split = [(t or "").lower().split() for t in texts]
        if len(self.rows) > MOST_KEYS:
            self.clear()
        self.learn([t for t in {t for s in split for t in s} if t not in self.rows])
        out, other = np.zeros((len(texts), self.costs.shape[1]), np.int64), []
        for i, tokens in enumerate(split):
            out[i] = self.costs[np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))].sum(0)
            other.append(Counter(w for t in tokens if t in self.other for w in self.other[t]) if self.other else Counter())
        return out, other


def _joined(summed: DataFrame, model: Model) -> DataFrame:
    """summed with the costs of other words added: those of known words, else of n-grams, by joins."""
    langs = range(len(model.langs))
    pairs = summed.select("at", F.explode("other").alias("o")).select("at", "o.word", "o.k")
    pairs = written(pairs, "pairs")
    words = pairs.select("word").distinct()
    known = words.join(model.words, "word").select("word", *[(F.col(f"c{i}").cast("long") * UNIT).alias(f"c{i}") for i in langs])
    unseen = words.join(model.words.select("word"), "word", "left_anti")
    grams_sql = [f"transform(sequence(1, length(word) + 3 - {o}), i -> substr(concat(' ', word, ' '), i, {o}))" if o > 1 else "transform(sequence(1, length(word)), i -> substr(word, i, 1))" for o in ORDERS]
    each = unseen.where("length(word) > 0").select("word", F.explode(F.array(*[F.struct(F.lit(o).alias("size"), F.expr(f"if(length(word) + 3 > {o}, {g}, CAST(array() AS ARRAY<STRING>))").alias("grams")) for o, g in zip(ORDERS, grams_sql)])).alias("g"))
    each = each.select("word", "g.size", F.explode("g.grams").alias("gram"))
    sums = each.join(model.grams, "gram").groupBy("word", "size").agg(F.count("*").alias("n"), *[F.sum(F.col(f"c{i}").cast("long")).alias(f"c{i}") for i in langs])
    best = sums.groupBy("word").agg(F.expr(f"max_by(struct(n, {', '.join(f'c{i}' for i in langs) or '0 AS none'}), size)").alias("b"))
    off = best.select("word", *[F.expr(f"(b.c{i} * {UNIT}) div b.n").alias(f"c{i}") for i in langs])
    added = pairs.join(known.unionByName(off), "word").groupBy("at").agg(F.sum("k").alias("more"), *[F.sum(F.col("k") * F.col(f"c{i}")).alias(f"m{i}") for i in langs])
    x = summed.join(added, "at", "left")
    sums = F.array(*[F.col("sums")[i] + F.coalesce(f"m{i}", F.lit(0)) for i in langs]).cast("array<long>")
    return x.select("row", sums.alias("sums"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "letters")


def identified(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): kept columns (all if None) and the language of each whole text.

    The score is the best language's share of the mean word's likelihood. und
    with score 0 where the text is null or has no letter. Letters that no
    training text had leave the languages tied; ties go to the first by name.
    Rows are treated one by one.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.table(model.told, "word"), model.table(model.grams, "gram") if model.whole else None))
    gc.collect()  # the driver keeps no copy of the tables
    pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in chunks(batches, "text"):
            sums, other = scorer.sums(b.column("text").to_pylist())
            width = sums.shape[1] - 2
            costs = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(sums[:, :width]).ravel()))
            left = pa.array([[{"word": w, "k": k} for w, k in c.items()] for c in other], pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("row"), costs, pa.array(sums[:, -2]), pa.array(sums[:, -1] > 0), left], ["row", "sums", "n", "letters", "other"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    x = x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, sums array<long>, n long, letters boolean, other array<struct<word: string, k: long>>")
    if not model.whole:
        x = _joined(written(x.withColumn("at", F.monotonically_increasing_id()), "summed"), model)
    if not model.langs:
        return x.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = F.array(*[F.lit(lang) for lang in model.langs])
    least = F.array_min("sums")
    share = F.aggregate("sums", F.lit(0.0), lambda a, c: a + F.pow(F.lit(10.0), (least - c) / (F.greatest("n", F.lit(1)) * (1000.0 * UNIT))))
    best = F.element_at(names, F.array_position("sums", least).cast("int"))
    return x.select("row", F.when(F.col("letters"), best).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), 1 / share).otherwise(0.0).alias("score"))


HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 4 = 2, false)"


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from those not held out; a null doc_id is not held out, and not learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(f"doc_id IS NOT NULL AND NOT {HELD_OUT}"))
    return identified(docs, model, keep=["doc_id"]).selectExpr("row.doc_id AS doc_id", "lang_pred", "score").selectExpr("doc_id", f"{HELD_OUT} AS held_out", "lang_pred", "score")
