"""Secret scans with a random forest that removes false positives.

Candidates are long runs of token characters, and values assigned to names
that promise a secret. A forest trained on labelled findings judges each by
its length, its character transitions, how much of it dictionary words cover,
the path, and the neighbouring words.

A dictionary word is a word of letters only, marks at its ends aside, that
comes at least twice and makes up at least one part in DICTIONARY of all such
words of all texts: that is what the word means here, at every size, and it
keeps the dictionary to DICTIONARY words, as large as a printed one. What is
inside longer tokens counts for nothing, so secrets do not make words. The
labelled findings are FINDINGS made cases, half of them real: a documented
bound.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, written
from tidelog.llm.langid import plain_word, word_counts
from tidelog.llm.textarrays import chunks

DICTIONARY = 200_000
FINDINGS = 6_000
TREES, DEPTH = 40, 8

#: Words near a finding that promise a secret, or something harmless: fixed values.
CUES = "token secret key apikey api_key password passwd pwd auth bearer credential credentials private access".split()
HARMLESS = "example sample test dummy placeholder sha sha1 sha256 md5 checksum hash commit revision digest uuid id version file image".split()
PLAIN_PATHS = "test tests example examples doc docs sample fixture mock".split()

#: A run ends where '=' assigns; '=' at its end is padding.
_RUN = re.compile(r"[A-Za-z0-9+/_\-.]{16,}={0,2}(?![A-Za-z0-9+/_\-.])|={16,}|[A-Za-z0-9+/_\-.]{16,}")
#: The value ends before the next field of a query string.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|(?:api|access|private|secret|auth)[_-]?key|passw(?:or)?d|pwd|credential)s?[\"']?\s*+[:=]\s*+[\"']?((?:(?!&[\w.\-]+=)[^\s\"']){6,})")
_NAME = frozenset(string.ascii_letters + string.digits + "_-.")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PART = re.compile(r"[a-z]{3,}")
FEATURES = ("length", "changes", "digits", "upper", "symbols", "hex", "entropy", "distinct", "covered", "slashes", "dots", "dashes", "quoted", "assigned", "cue", "harmless", "plain_path")


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Spans to judge, in order and apart: assigned values, and what these and their names leave of token runs that are no plain word."""
    found, taken = list(_ASSIGNED.finditer(text)), []
    for m in found:
        at, least = m.start(), taken[-1][1] if taken else 0
        while at > least and text[at - 1] in _NAME:
            at -= 1
        taken.append((at, m.end(1)))
    out, k = [m.span(1) for m in found], 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        for a, b in [*takewhile(lambda t: t[0] < e, taken[k:]), (e, e)] if k < len(taken) else [(e, e)]:
            if a - s >= 16 and not text[s:a].strip(".-_/").isalpha():
                out.append((s, a))
            s = max(s, b)
    return sorted(out)


class Dictionary:
    """Words of three letters or more, and the lengths that they have, longest first."""

    def __init__(self, words):
        self.words = frozenset(words)
        self.lengths = sorted({len(w) for w in self.words}, reverse=True)


def covered(value: str, words: Dictionary) -> float:
    """The share of characters inside dictionary words, longest first."""
    found = 0
    for part in _PART.findall(value.lower()):
        i = 0
        lengths = [n for n in words.lengths if n <= len(part)]
        while i + 3 <= len(part):
            n = next((k for k in lengths if i + k <= len(part) and part[i : i + k] in words.words), 0)
            found += n
            i += n or 1
    return found / max(1, len(value))


class Surroundings:
    """Where the words of a text are, for the neighbours of its candidates."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def words(self, start: int, end: int) -> list[str]:
        """The four words before a span and the two after it, however far."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return [self.text[self.starts[k] : self.ends[k]] for k in [*range(max(0, i - 4), i), *range(j, min(j + 2, len(self.starts)))]]

    def assigned(self, start: int) -> bool:
        """Whether : or = stands before a place, a quotation mark and white space aside."""
        at = start - (self.text[start - 1 : start] in ("'", '"') and start > 0)
        while at > 0 and self.text[at - 1].isspace():
            at -= 1
        return at > 0 and self.text[at - 1] in ":="


def features(value: str, before: str, after: str, path: str, words) -> list[float]:
    """FEATURES, in order, of a value between the text before and after it; words: a Dictionary, or any words."""
    return span_features(Surroundings(before + value + after), len(before), len(before) + len(value), path, words if isinstance(words, Dictionary) else Dictionary(words))


def span_features(around: Surroundings, start: int, end: int, path: str, words: Dictionary) -> list[float]:
    """FEATURES of the candidate at a span of a text."""
    value = around.text[start:end]
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = list(Counter(value).values())
    near = [p.lower() for w in around.words(start, end) for p in (w, *_HUMP.split(w))]
    quoted = start > 0 and around.text[start - 1] in "\"'" and around.text[end : end + 1] in ("'", '"')
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n,
        sum(c in string.hexdigits for c in value) / n, -sum(k / n * math.log2(k / n) for k in counts), len(counts) / n, covered(value, words),
        float(value.count("/")), float(value.count(".")), float(value.count("-")), float(quoted),
        float(around.assigned(start)), float(any(w in CUES for w in near)), float(any(w in HARMLESS for w in near)), float(any(p in PLAIN_PATHS for p in re.split(r"[^a-z]+", path.lower()))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): made findings of usual shapes, real ones and false ones by turns.

    Each is a candidate of its text, cut as candidate_spans cuts it; a shape
    that is no candidate, or a real value that is cut otherwise, is made anew.
    """
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 6)))
    out = []
    while len(out) < n:
        real = len(out) % 2
        quote = r.choice(['"', '"', "'", ""])
        mark = r.choice([" = ", "=", ": "])
        if real:
            value = r.choice([of(hexes, 40), of(hexes, 40), of(hexes, 32), of(mixed, r.randint(20, 64)), "AKIA" + of(string.ascii_uppercase + string.digits, 16), "ghp_" + of(mixed, 36), "sk_live_" + of(mixed, 24), of(mixed + "+/", 43) + "="])
            cue = r.choice([c for c in CUES if c not in ("auth", "private")])
            if r.random() < 0.3:
                cue = f"{word()}_{cue}"
            before, path = f"{r.choice([word() + ' ', word() + ' ', 'export ', '?', word() + '&'])}{cue}{mark}{quote}", r.choice(["src", "config", "src0", "deploy/app"])
            if r.random() < 0.3:
                value = value.upper()
                before = before.upper()
        else:
            kind = r.randrange(7)
            cue = r.choice(HARMLESS)
            if kind == 0:
                value, before = of(hexes, r.choice([32, 40, 64])), f"{word()} {cue}{mark}{quote}"
            elif kind == 1:
                value, before = "-".join(of(hexes, k) for k in (8, 4, 4, 4, 12)), f"{word()} {r.choice(['uuid', 'id', word()])}{mark}{quote}"
            elif kind == 2:
                value, before = "/".join(word() for _ in range(r.randint(2, 6))) + r.choice(["", ".py", ".html", "2"]), f"{word()} {quote}"
            elif kind == 3:
                value, before = r.choice(["your_token_here_123", "xxxxxxxxxxxxxxxx0", "changeme123", "example-key-0000", "password123", "0" * 20]), f"{word()} {r.choice(CUES)}{mark}{quote}"
            elif kind == 4:
                value, before, quote = "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), f"{word()} ", ""
            elif kind == 5:
                value, before, quote = r.choice(["=", "-", ".", "_"]) * r.randint(16, 60), f"{word()} ", ""
            else:
                value, before, quote = r.choice([f"{word()}.{r.randint(1, 99)}", f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}", word() + "." + word() + "." + word() + ".com", of(string.digits, 20)]), f"{word()} ", ""
            path = r.choice(["src", "docs/example", "tests", "src0", "sample"])
        after = f"{quote} {word()}"
        text, at = before + value + after, len(before)
        spans = [(s, e) for s, e in candidate_spans(text) if s < at + len(value) and e > at]
        if spans and (not real or spans == [(at, at + len(value))]):
            s, e = spans[0]
            out.append((text[s:e], text[:s], text[e:], path, real))
    return out


def dictionary(df: DataFrame, text: str = "text") -> Dictionary:
    """Words that come twice or more and make up at least one part in DICTIONARY of the plain words of the texts."""
    plain = word_counts(df.select(F.lit("").alias("lang"), F.col(f"`{text}`").alias("text")), "text", "lang", plain_word)
    counts = written(plain.select("word", "n"), "dictionary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return Dictionary(r[0] for r in counts.where((F.col("n") > 1) & (F.col("n") * DICTIONARY >= total) & (F.length("word") >= 3)).select("word").collect())


def forest(spark, words) -> RandomForestClassificationModel:
    rows = [(DenseVector(features(v, b, a, p, words)), float(y)) for v, b, a, p, y in labelled_findings()]
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3).fit(spark.createDataFrame(rows, ["features", "label"]))


def candidates(df: DataFrame, words: Dictionary, text: str, path: str | None, keep: list[str]) -> DataFrame:
    """(row, start, end, value, features) for each candidate in the whole texts."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in chunks(batches, "text"):
            at, rows = [], []
            for i, (t, p) in enumerate(zip(b.column("text").to_pylist(), b.column("path").to_pylist())):
                if spans := candidate_spans(t or ""):
                    around = Surroundings(t)
                    at += [i] * len(spans)
                    rows += [(s, e, t[s:e], span_features(around, s, e, p or "", known)) for s, e in spans]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.float64()))], ["row", "start", "end", "value", "features"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), (F.col(f"`{path}`").cast("string") if path else F.lit("")).alias("path"))
    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, start long, end long, value string, features array<double>")


def findings(df: DataFrame, text: str = "text", path: str | None = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, start, end, value, probability, secret): every candidate and the forest's verdict.

    Offsets are in code points, end exclusive. Null and empty texts have no
    candidates, nor has an empty table; a null path says nothing; repeated
    rows are judged alike; secret is true from probability 0.5 on, ties
    included. keep: columns carried in row (all if None).
    """
    words = dictionary(df, text)
    found = candidates(df, words, text, path, df.columns if keep is None else keep)
    judged = forest(df.sparkSession, words).transform(found.withColumn("features", array_to_vector("features")))
    return judged.select("row", "start", "end", "value", vector_to_array("probability")[1].alias("probability")).withColumn("secret", F.col("probability") >= 0.5)


def redacted(df: DataFrame, text: str = "text", path: str | None = "source", mask: str = "[secret]") -> DataFrame:
    """df with each secret found in text replaced by mask; all rows and columns stay.

    Findings depend on text and path alone, so they meet their rows by both,
    with nulls alike; repeated rows share them.
    """
    told = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.sha2(F.concat(told(F.col(f"`{text}`")), F.lit("\x00"), told(F.col(f"`{path}`")) if path else F.lit("")), 256)
    x = df.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"), (F.col(f"`{path}`") if path else F.lit("")).alias("path"), key.alias("key"))
    found = findings(x, "text", "path", ["key"]).where("secret").select(F.col("row.key").alias("key"), "start", "end").distinct()
    spans = written(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "secrets")
    step = "(acc, s) -> named_struct('at', s.end, 'out', concat(acc.out, substr(text, CAST(acc.at + 1 AS INT), CAST(s.start - acc.at AS INT)), '" + mask + "'))"
    clean = f"if(spans IS NULL, text, aggregate(spans, named_struct('at', 0L, 'out', ''), {step}, acc -> concat(acc.out, substr(text, CAST(acc.at + 1 AS INT)))))"
    y = x.join(spans, "key", "left").withColumn("clean", F.expr(clean))
    return y.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, end, value_sha256, probability, secret for every candidate finding in every document.

    Null and empty texts and an empty table have none; a repeated row has its
    findings again; a null source says nothing; other columns are ignored.
    """
    x = findings(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"])
    return x.select("row.doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "secret")
