"""Periodic runs against plain search, byte-level BPE against its library, manifests against plain hashing."""

import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, merkle, registry, repeats, textarrays


@pytest.fixture(scope="session")
def rows(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# periodic runs


def plain_runs(s, shortest=2, exponent=2):
    out = []
    for p in range(1, len(s) // exponent + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j + p - i
            if n >= max(shortest, exponent * p) and not any(s[i : i + n - q] == s[i + q : i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_short_strings():
    r = random.Random(1)
    for _ in range(1500):
        k, n = r.choice([1, 2, 2, 2, 3, 4]), r.randint(0, 50)
        s = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 6)
            s = s[:a] + [s[a + (i - a) % min(p, n - a)] for i in range(a, n)]
        got = zip(*(x.tolist() for x in repeats.runs(np.array([*s, k]))))
        assert sorted(got, key=lambda x: (x[0], x[2])) == plain_runs(s), s


def test_runs_of_words_that_share_a_tree():
    r = random.Random(2)
    texts = []
    for _ in range(150):
        w = [str(r.randrange(r.choice([2, 6, 50]))) for _ in range(r.randint(1, 150))]
        a = r.randrange(len(w))
        p = r.randint(1, len(w) - a)
        texts.append(" \n".join(w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]).encode())
    for shortest, exponent in ((24, 3), (5, 2), (2, 2), (9, 5)):
        got = repeats._found(texts + texts[:20], shortest, exponent)
        assert got == [plain_runs(t.split(), shortest, exponent) for t in texts + texts[:20]]


def test_runs_do_not_depend_on_how_stretches_share_trees(monkeypatch):
    texts = [b"a b c " * 30, b"x " * 40 + b"y z " * 20, b" ".join(b"%d" % (i % 90) for i in range(500))]
    want = repeats._found(texts, 24, 3)
    monkeypatch.setattr(repeats, "TOGETHER", 10)
    assert repeats._found(texts, 24, 3) == want and want[2] == [(0, 500, 90)]


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 24, 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
    said = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(said), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


OP11 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_against_plain_search(spark, sf, rows):
    got = registry.QUERIES["op11_periodic_runs"](spark, sf)
    assert got.columns == OP11 and all(t == "bigint" for c, t in got.dtypes if not c.endswith("256"))
    want = [plain_op11(r["doc_id"], r["text"]) for r in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want, key=str) or sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 5


def test_op11_edges(spark, table, docs, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    small = [d for d in docs if len(d[1] or "") < 20_000]
    want = [str(plain_op11(d[0], d[1])) for d in small]
    have = [str(tuple(r)) for r in got]
    assert len(got) == len(docs) and not set(want) - set(have)


# byte-level BPE


@pytest.fixture(scope="session")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 20_000):
        hashes = textarrays.spans_hashed([b"%d" % i for i in range(n)])
        assert sorted(byte_bpe.PerfectHash(hashes)(hashes).tolist()) == list(range(n))


def test_vocabulary_takes_no_other_word(library):
    c = byte_bpe.codec()
    tokens = list(c.ranks)
    assert c.vocabulary(tokens).tolist() == list(c.ranks.values())
    r = random.Random(3)
    other = [bytes(r.choice(b"abcdefgh \xf0\x9f") for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    assert c.vocabulary(other).tolist() == [c.ranks.get(w, -1) for w in other]


def test_spans_hashed_in_pieces(monkeypatch):
    words = [b"", b"a", b"ab" * 300, b"", b"xyz", b"a"]
    whole = textarrays.spans_hashed(words)
    monkeypatch.setattr(textarrays, "PIECE", 4)
    assert (textarrays.spans_hashed(words) == whole).all() and whole[1] == whole[5] and len(set(whole.tolist())) == 4


def test_merges_are_the_literal_ones():
    r = random.Random(4)
    for _ in range(300):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        for _ in range(r.randint(0, 25)):
            a, b = (r.choice(list(ranks)) for _ in range(2))
            ranks.setdefault(a + b, len(ranks))
        word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 40)))
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merged(word, ranks) == [ranks[p] for p in parts]


def test_every_character_as_in_the_library(library):
    c = byte_bpe.codec()
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(chars), 65_536):
        for glue in ("", " a", " ", " 1\n"):
            text = glue.join(chars[k : k + 65_536])
            assert c.encode([text])[0] == library.encode_ordinary(text)


def test_long_words(library):
    for text in ("x" * 50_000, "ab" * 20_000, "<|endoftext|> a<|endoftext|>", " " * 5000, "🙂" * 3000, ""):
        ids = byte_bpe.codec().encode([text])[0]
        assert ids == library.encode_ordinary(text) and byte_bpe.codec().decode(ids) == text.encode()


def test_words_are_forgotten_without_effect(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 3)
    c = byte_bpe.Codec()
    for text in ("qwzx vbkq qqzz", "vbkq zzqj kkwv", "qwzx qqzz kkwv"):
        assert c.encode([text, text]) == [library.encode_ordinary(text)] * 2


def test_op12_as_the_library(spark, sf, rows, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op12_byte_bpe"](spark, sf).collect()}
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode_bytes(ids)))


# manifests


def plain_tree(digests):
    """(root, proof of each) by the rule, level by level."""
    proofs, places, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, at in enumerate(places):
            start = at - at % 16
            proofs[i] += ["".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])]
            places[i] = at // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def plain_leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    source = lambda r: (r["source"] is not None, (r["source"] or "").encode())
    order = sorted(rows, key=lambda r: (source(r), first(r["doc_id"]), plain_leaf(r, r["text"])))
    trees = [list(g) for _, g in groupby(order, source)]
    made = [plain_tree([plain_leaf(r, r["text"]) for r in t]) for t in trees]
    root, above = plain_tree([m[0] for m in made]) if made else (None, [])
    out = []
    for t, (subroot, proofs), up in zip(trees, made, above):
        for r, own in zip(t, proofs):
            proof, leaf = own + up, plain_leaf(r, r["text"])
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            at = plain_leaf(r, text)
            for b, a in zip(proof[::2], proof[1::2]):
                at = sha(b + at + a)
            out.append((r["doc_id"], leaf, subroot, root, sha("".join(proof)), at, at == root))
    return sorted(map(str, out))


OP13 = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(spark, path, **options):
    got = registry.QUERIES["op13_merkle_manifest"](spark, str(path), **options)
    assert got.columns == OP13
    return sorted(str(tuple(r)) for r in got.collect())


def test_op13_against_plain_hashing(spark, sf, rows):
    got = manifest_of(spark, sf)
    assert got == plain_manifest(rows)
    assert sum(r.endswith("False)") for r in got) > 10


def test_op13_edges(spark, table, docs, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert manifest_of(spark, tmp_path) == plain_manifest([dict(zip(names, d)) for d in docs])
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert manifest_of(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_superblocks_of_any_height(spark, tmp_path, levels):
    """One source with most rows, many with one: as many stages as it takes, the same roots."""
    rows = [{"doc_id": i * 7 % 4999, "source": None if i % 50 == 0 else "big" if i % 3 else f"s{i % 299}", "lang": None, "n_chars": i, "text": f"Text {i}"} for i in range(4500)]
    rows += [rows[7]] * 40
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_of(spark, tmp_path, levels=levels) == plain_manifest(rows)


def test_manifest_keeps_named_columns_and_verifies(spark, docs, table):
    got = merkle.manifest(table, also={"size": F.lit(1)})
    assert got.columns == ["doc_id", "size", "leaf", "subroot", "root", "proof"]
    x = got.select(merkle.verified(F.col("leaf"), F.col("proof"), F.col("root")).alias("yes"), merkle.verified(F.sha2("leaf", 256), F.col("proof"), F.col("root")).alias("no"))
    assert [tuple(r) for r in x.distinct().collect()] == [(True, False)]
