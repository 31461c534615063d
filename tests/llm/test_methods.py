"""Methods against plain versions of them: packing, shards, media, tokens, joins, spans, languages, findings, the pipeline's keeping of rows."""

import hashlib
import itertools
import json
import math
import random
import re
import threading
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import bpe, common, gif, jaccard, langid, packing, pii, registry, secrets, shards, textarrays

# intermediate tables and session settings


def test_scratch_and_settings(spark, tmp_path):
    set_now = lambda: {r["key"]: r["value"] for r in spark.sql("SET").collect() if r["key"].startswith("spark.sql.")}
    before = set_now()
    with common.scratch():
        path = common._paths[common.written(spark.range(3).toDF("x"), "t")]
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ZeroDivisionError), common.scratch():
        path = common._paths[common.written(spark.range(3).toDF("x"), "t")]
        raise ZeroDivisionError
    assert spark.read.parquet(path).count() == 3  # kept for recovery
    x = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")
    packing.packed(x).collect(), jaccard.components_by_similarity(x).collect()
    assert before == set_now()


# the pipeline


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a"), "x"), (1, text("b"), "x"), (2, text("c"), "x"), (3, text("c"), "y"), (None, text("d"), "x"), (None, text("d") + " tail", "x"), (None, None, "x"), (4, "", "x"), (4, "", "x"), (5, text("e"), "x"), (5, text("e"), "x"), (6, text("b") + " tail", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "'k' AS KEY_OF_ROW", "1 AS n_shingles", "2 AS component_id")
    got = p.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((str(r["doc_id"]), str(r["text"])) for r in got.collect()))
    d = {x for x in kept if x[1].startswith("d")}
    assert len(d) == 1 and [x for x in kept if x not in d] == sorted([("1", text("a")), ("1", text("b")), ("2", text("c")), ("None", "None"), ("4", ""), ("4", ""), ("5", text("e"))])


# packing


def triplets(n, rng, capacity=1000):
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 491))
        b = int(rng.integers(250, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return out


def greedy(lengths, capacity):
    return len(set(packing.grouping(np.array(lengths, np.int64), capacity, np.random.default_rng(0), 0.0).tolist()))


def bins_of(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("n", [40, 120])
def test_islands_beat_best_fit_on_triplets(spark, n):
    lengths = triplets(n, np.random.default_rng(n))
    cut = spark.createDataFrame([(i, 0, 0, k, i, i) for i, k in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")
    assert bins_of(packing.pack(cut, 1000).collect(), 1000) < greedy(lengths, 1000)


def test_crossovers_make_the_result():
    lengths = np.array(triplets(60, np.random.default_rng(2)), np.int64)
    tally = []
    first = packing.grouping(lengths, 1000, np.random.default_rng(1), 1.0)
    out = packing.evolve(lengths, [first], 1000, np.random.default_rng(1), 1.0, tally)
    assert tally[0] > 0 and packing.fitness(out[0], lengths, 1000)[0] < packing.fitness(first, lengths, 1000)[0]


def test_levels_win_back_what_blocks_lose(spark, monkeypatch):
    """Blocks so small that each alone wastes half a bin; what is left over the lower bound is one bin at most."""
    monkeypatch.setattr(packing, "BLOCK", 150)
    monkeypatch.setattr(packing, "FAN", 4)
    r = random.Random(7)
    lengths = [min(2048, int(r.lognormvariate(5.9, 0.9)) + 1) for _ in range(2500)]
    rows = [(i, 0, 0, n, i, r.getrandbits(62)) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(2500))
    blocks = -(-2500 // 150)
    apart = sum(greedy([x[3] for x in rows if x[5] % blocks == b], 2048) for b in range(blocks))
    assert bins_of(got, 2048) < apart and bins_of(got, 2048) <= -(-sum(lengths) // 2048) + 1


def test_real_lengths_take_no_more_than_best_fit(spark):
    cut = packing.pieces(common.documents(spark, "/root/testdata/sf0.1"))
    lengths = [r["length"] for r in cut.select("length").collect()]
    assert packing.pack(cut).select("sequence_id").distinct().count() <= greedy(lengths, 2048)


RUNS = {"letters": "ab", "one letter": "a", "spaces": " ", "lines": "\n", "digits": "12", "marks": "=-", "words": "the word ", "wide": "中", "mixed space": " \n\t"}


@pytest.mark.parametrize("kind", RUNS)
def test_both_encoders_agree_around_their_border(kind):
    run = RUNS[kind]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder(None)
    for n in (packing.LONG_TEXT - 1, packing.LONG_TEXT + 1) if kind == "words" else (20_000,):
        text = (run * (n // len(run) + 1))[:n]
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


# shards


def runs_of(store, x, n):
    return [store.append(x.where(f"doc_id % {n} = {k}")) for k in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return shards.Shards(spark, f"file://{tmp_path}/s", target=60_000, fan_in=3)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 512) AS text")


def test_a_version_that_appears_after_the_check_is_not_replaced(spark, store, rows):
    store.append(rows)
    other = store.runs()
    publish = store.publish
    def late(ready, target):  # another writer takes the number just before the last step
        shards.Shards(spark, store.path).commit([{**other[0], "run": "theirs"}], 1)
        return publish(ready, target)
    store.publish = late
    with pytest.raises(FileExistsError):
        store.commit(other, 1)
    store.publish = publish
    assert [r["run"] for r in store.runs(2)] == ["theirs"] and store.versions() == [1, 2]


def test_hadoop_rename_refuses_a_target(spark, tmp_path, store):
    """The step that other file systems take."""
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    jvm, path = spark._jvm, lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/{n}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path("a").toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    with pytest.raises(Exception, match="FileAlreadyExists"):
        context.rename(path("a"), path("b"), none)
    context.rename(path("a"), path("c"), none)
    assert (tmp_path / "b").read_text() == "b" and (tmp_path / "c").read_text() == "a"


def test_racing_writers_lose_nothing(spark, store, rows):
    def work(k):
        shards.Shards(spark, store.path, 60_000, 3).append(rows.where(f"doc_id % 6 = {k}"))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.versions() == list(range(1, 7))
    assert store.read(rows.schema).count() == 3000 and store.read(rows.schema).exceptAll(rows).isEmpty()


def test_vacuum_leaves_work_in_hand_and_kept_versions(spark, store, rows):
    runs_of(store, rows, 6)
    in_hand = store.written(rows.where("doc_id < 5"))[0]
    store.compact(rows.schema)
    old = store.versions()[-2]
    assert store.vacuum() == []
    assert store.read(rows.schema, old).count() == 3000
    store.adopt(in_hand)
    assert store.read(rows.schema).count() == 3005
    gone = store.vacuum(keep_versions=1, keep_seconds=0)
    assert len(gone) >= 6 and store.read(rows.schema).count() == 3005
    with pytest.raises(KeyError, match="vacuumed"):
        store.read(rows.schema, old)


def test_a_merge_that_comes_too_late_is_given_up(spark, store, rows):
    runs_of(store, rows, 3)
    rival, commit = shards.Shards(spark, store.path, 60_000, 3), store.commit
    def late(runs, after):
        store.commit = commit
        rival.compact(rows.schema)
        return commit(runs, after)
    store.commit = late
    assert store.compact(rows.schema) == 0
    assert store.read(rows.schema).count() == 3000


def test_shards_are_as_large_as_stated(spark, store, rows):
    x = shards.loaded(rows, store, waves=9)
    assert x.count() == 3000 and x.exceptAll(rows).isEmpty()
    merged = [r for r in store.runs() if r["tier"] > 0]
    assert merged and all(r["bytes"] / r["files"] < 3 * store.target for r in merged)
    tiers = Counter(r["tier"] for r in store.runs())
    assert max(tiers.values()) < store.fan_in


# media


def plain_gif(payload):
    """The stored form by a plain encoder: codes in a dictionary, bits one by one."""
    out = b"GIF89a" + bytes([24, 0, 24, 0, 0xF7, 0, 0]) + bytes(v for i in range(256) for v in (i, i, i)) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    for at in range(0, len(payload), 576):
        known = {bytes([i]): i for i in range(256)}
        bits, width, w = [], 9, b""
        put = lambda code: bits.extend(code >> k & 1 for k in range(width))  # noqa: E731, B023
        put(256)
        following = 258
        for c in payload[at : at + 576]:
            if w + bytes([c]) in known:
                w += bytes([c])
                continue
            put(known[w])
            known[w + bytes([c])] = following
            width = max(9, min(12, following.bit_length()))
            following += 1
            w = bytes([c])
        put(known[w])
        width = max(9, min(12, following.bit_length()))
        put(257)
        data = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
        blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
        out += b"\x21\xf9\x04\x04\x04\x00\x00\x00\x2c" + bytes([0, 0, 0, 0, 24, 0, 24, 0, 0]) + b"\x08" + blocks + b"\x00"
    return out + b"\x3b"


def test_media_columns_by_a_plain_encoder(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["op6_gif_media"](spark, sf).collect():
        p = gif.padded(texts[r["doc_id"]].encode())
        media = plain_gif(p)
        bars = Counter(b >> 5 for b in p)
        feature = f"frames={len(p) // 576} ms={40 * (len(p) // 576)} grey={','.join(str(bars[i]) for i in range(8))}"
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"], r["feature"]) == (len(texts[r["doc_id"]].encode()), len(media), hashlib.sha256(media).hexdigest(), feature)


def test_malformed_files_never_fail_the_job(spark):
    r = random.Random(9)
    good = gif.write_gifs([gif.padded(b"some text " * 40), gif.padded(bytes(range(256)) * 5)])
    no_palette = good[0][:10] + b"\x00" + good[0][11:13] + good[0][13 + 768 :]
    short = good[0][:10] + b"\xf0" + good[0][11:13] + good[0][13 : 13 + 6] + good[0][13 + 768 :]
    bomb = b"GIF89a\xff\xff\xff\xff\x00\x00\x00\x2c\x00\x00\x00\x00\xff\xff\xff\xff\x00\x08\x03\x00\x01\x02\x00\x3b"
    canvas = b"GIF89a\xff\xff\xff\xff" + good[0][10:]
    files = [no_palette, short, bomb, canvas, *[good[0].replace(b"\x00\x18\x00\x00\x08", b"\x00\x18\x00\x00" + bytes([k])) for k in (0, 1, 9, 12, 200)]]
    for _ in range(2500):
        b = bytearray(r.choice(good))
        for _ in range(r.randint(1, 4)):
            b[r.randrange(6, len(b))] = r.randrange(256)
        files.append(bytes(b[: r.choice([len(b), len(b), r.randrange(len(b))])]))
    rows = gif.read(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "i long, media binary").repartition(4)).select("i", "failed", F.size("frames").alias("n")).collect()
    assert len(rows) == len(files)
    told = {x["i"]: x["failed"] for x in rows}
    assert all(told[i] for i in range(4))


# tokens


def test_automaton_is_that_of_literal_gadgets(tmp_path):
    said = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    merges, alphabet = said["model"]["merges"][:260], list(bpe.byte_alphabet())
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in merges]
    pairs += [("a", "a"), ("aa", "a"), ("aa", "aa"), ("b", "aa")]
    names = list(dict.fromkeys([*alphabet, *(a + b for a, b in pairs)]))
    vocab = {t: i for i, t in enumerate(names)}
    said["model"] |= {"vocab": vocab, "merges": [" ".join(p) for p in pairs]}
    said["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    made = bpe.Automaton(str(path))
    after = {x: set(alphabet) for x in alphabet}  # tokens that may follow each token
    for a, b in pairs:
        after[a + b] = set(after[b])
        after[a].discard(b)
        for follow in after.values():
            if a in follow:
                follow.add(a + b)
    for x, y in itertools.product(after, after):
        assert made.arc(vocab[x], vocab[y]) == (y in after[x]), (x, y)


# the Jaccard join


def test_shared_templates_are_no_links(spark, monkeypatch):
    """Texts that share half their words, of several sizes, with near copies among them, in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    r = random.Random(12)
    head = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(150):
        own = head + [f"w{r.randrange(9000)}" for _ in range(r.choice([40, 60, 90]))]
        rows.append((len(rows), " ".join(own)))
        if k % 5 == 0:
            own[-1] = "changed"
            rows.append((len(rows), " ".join(own)))
    got = {x["id"]: x["component_id"] for x in jaccard.components_by_similarity(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    sets = [(i, {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)}) for i, t in rows]
    for i, s in sets:
        want[i] = next((want[j] for j, o in sets if j < i and 10 * len(s & o) >= 9 * len(s | o)), i)
    assert got == want


def test_tree_pairs_keep_every_pair_that_can_link(spark):
    rng, s = np.random.default_rng(4), Fraction(9, 10)
    leaves, members = [], {}
    for b in range(60):
        n = int(rng.integers(20, 400))
        points = rng.multinomial(n, np.ones(32) / 32, 3)
        block = ((b % 3) << 32) + b
        members[block] = points
        leaves.append((7, block, int(points.sum(1).min()), int(points.sum(1).max()), points.max(0).tolist(), block, block))
    df = spark.createDataFrame(leaves, "family long, block long, low long, high long, corner array<int>, a long, b long")
    got = {(x["i"], x["j"]) for x in jaccard.tree_pairs(df, s).collect()}
    can = {(i, j) for i, j in itertools.combinations(sorted(members), 2) if any(19 * np.minimum(p, q).sum() >= 9 * (p.sum() + q.sum()) for p in members[i] for q in members[j])}
    assert can <= got and len(got) < 60 * 59 / 2 / 2


def test_keys_are_combined_before_they_are_dealt_out():
    import pyarrow as pa

    key, id = np.array([5, 5, 5, 5, 6, 7, 7]), np.array([4, 2, 9, 2, 1, 8, 3])
    (out,) = jaccard._combined(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(id)], ["key", "id"])]))
    rows = list(zip(*(out.column(c).to_pylist() for c in ("key", "id", "head"))))
    assert sorted(r[:2] for r in rows if r[2] == jaccard.ALONE) == [(5, 2), (6, 1), (7, 3)]
    assert sorted(r[1:] for r in rows if r[2] != jaccard.ALONE) == [(4, 2), (8, 3), (9, 2)]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_query_by_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["op9_pii"](spark, sf).collect():
        t = texts[r["doc_id"]]
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m.group())]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert spans[: len(want)] == [tuple(map(str, x)) for x in want]
        for kind, s, e in spans[len(want) :]:
            assert kind in pii.MORE and re.fullmatch(pii.MORE[kind].replace("++", "+").replace("}+", "}").replace(r"\p{Lu}", "[^\\W\\d_a-z]").replace(r"\p{Ll}", "[^\\W\\d_A-Z]").replace(r"\p{L}", "[^\\W\\d_]"), t[int(s) : int(e)])


GOOD = ["mail {w} [at] example [dot] org please", "call me: (962) 555-2{n:03d} now", "phone 415-555-{n:04d}, after six", "my ssn 123-45-{n:04d}.", "iban DE44 5001 0517 5407 3249 {n2:02d}, the bank", "signed by Dr. {W}", "dear Maria {W}, hello"]
BAD = ["version 112 233 {n:04d}x", "build=212 333 {n:04d}", "page $100 200 {n:04d}0", "part 000-00-{n:04d}", "issue 999-00-0000"]


def test_pii_precision_and_recall(spark, sf):
    """Made spans that the training sample of documents does not hold, judged in the same run."""
    r = random.Random(4)
    rows, want = [], {}
    for i in range(280):
        good = i % 2 == 0
        form = r.choice(GOOD if good else BAD)
        w = "".join(r.choice("abcdefghij") for _ in range(6))
        rows.append((i, form.format(w=w, W=w.title(), n=r.randrange(1, 1000), n2=r.randrange(10, 99))))
        want[i] = good
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("-1 - doc_id", "text"))
    found = {x["row"]["doc_id"]: bool(x["added"]) for x in pii.find(docs, keep=["doc_id"]).where("row.doc_id >= 0").collect()}
    hit = sum(found[i] and want[i] for i in want)
    precision, recall = hit / max(1, sum(found.values())), hit / sum(want.values())
    print("precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.9


# languages


def plain_model(rows):
    words, grams = {}, {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            words.setdefault(lang, Counter())[w] += 1
            for o in langid.ORDERS:
                for g in langid.grams_of(w, o):
                    grams.setdefault((lang, o), Counter())[g] += 1
    return words, grams


def plain_predict(text, words, grams):
    langs = sorted(words)
    lack = round(1000 * math.log10(2 * max(sum(c.values()) for c in words.values())))
    gram_lack = round(1000 * math.log10(2 * max(sum(c.values()) for c in grams.values())))
    cost = lambda table, key, lacks: round(1000 * (math.log10(sum(table.values())) - math.log10(table[key]))) if key in table else lacks
    total, n, letters = dict.fromkeys(langs, 0), 0, False
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        letters = True
        if any(w in c for c in words.values()):
            for k in langs:
                total[k] += 1000 * cost(words[k], w, lack)
            n += 1
            continue
        for o in langid.ORDERS:
            known = [g for g in langid.grams_of(w, o) if any(g in grams[k, o] for k in langs)]
            if known:
                for k in langs:
                    total[k] += 1000 * sum(cost(grams[k, o], g, gram_lack) for g in known) // len(known)
                n += 1
                break
    if not letters:
        return "und", 0.0
    best = min(langs, key=lambda k: total[k])
    return best, 1 / sum(10 ** ((total[best] - total[k]) / (max(n, 1) * 1e6)) for k in langs)


def test_language_query_by_a_plain_scorer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words, grams = plain_model([(d["text"], d["lang"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2])
    texts = {d["doc_id"]: d["text"] for d in docs}
    for r in registry.QUERIES["op10_language_id"](spark, sf).collect():
        lang, score = plain_predict(texts[r["doc_id"]], words, grams)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_joined_words_give_the_same_sums(spark, table, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.unionByName(table.select("doc_id", "text", "lang")).union(spark.createDataFrame([(900, "zzqx thathe 𐐨𐐩 ünder abcd1efgh キ", "en")], docs.schema))
    half = docs.where("doc_id % 2 = 0")
    told = lambda m: sorted(map(str, langid.identified(other, m, keep=["doc_id", "text"]).collect()))
    whole = langid.train(half)
    monkeypatch.setattr(langid, "OFTEN", 300)
    joined = langid.train(half, told_bytes=0)
    assert whole.whole and not joined.whole
    assert told(whole) == told(joined)


# findings


def plain_features(text, s, e, path, words):
    value, before, after = text[s:e], text[:s], text[e:]
    n = len(value)
    kind = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"
    share = lambda f: sum(map(f, value)) / n
    low, inside, i = value.lower(), 0, 0
    while i < n:  # longest dictionary word from each place, inside runs of letters
        run = re.match(r"[a-z]*", low[i:])[0]
        k = max((k for k in range(3, len(run) + 1) if run[:k] in words), default=0)
        inside += k
        i += k or 1
    near = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", before)[-4:] + re.findall(r"[A-Za-z_][A-Za-z0-9_]*", after)[:2]
    parts = {p.lower() for w in near for p in [w, *re.split(r"_+|(?<=[a-z0-9])(?=[A-Z])", w)]}
    p = [value.count(c) / n for c in set(value)]
    return {
        "length": n, "changes": sum(kind(a) != kind(b) for a, b in zip(value, value[1:])) / n, "digits": share(str.isdigit), "upper": share(lambda c: kind(c) == "u"), "symbols": share(lambda c: kind(c) == "s"),
        "hex": share(lambda c: c in "0123456789abcdefABCDEF"), "entropy": -sum(x * math.log2(x) for x in p), "distinct": len(p) / n, "covered": inside / n, "slashes": value.count("/"), "dots": value.count("."), "dashes": value.count("-"),
        "quoted": before[-1:] in ("'", '"') and after[:1] in ("'", '"'), "assigned": bool(re.search(r"[:=]\s*[\"']?\Z", before)), "cue": bool(parts & set(secrets.CUES)), "harmless": bool(parts & set(secrets.HARMLESS)),
        "plain_path": any(x in secrets.PLAIN_PATHS for x in re.findall(r"[a-z]+", path)),
    }


def test_findings_and_features_by_a_plain_version(spark, sf):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter(w for t, _ in docs.values() for x in (t or "").lower().split() for w in [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] if w.isalpha())
    total = sum(count.values())
    words = {w for w, n in count.items() if len(w) >= 3 and n > 1 and n * secrets.DICTIONARY >= total}
    got = registry.QUERIES["op1_secret_scan"](spark, sf).collect()
    spans = {i: secrets.candidate_spans(t or "") for i, (t, _) in docs.items()}
    assert sorted((r["doc_id"], r["start"], r["end"], r["value_sha256"]) for r in got) == sorted((i, s, e, hashlib.sha256(docs[i][0][s:e].encode()).hexdigest()) for i, at in spans.items() for s, e in at)
    found = secrets.candidates(spark.read.parquet(f"{sf}/documents.parquet"), secrets.Dictionary(words), "text", "source", ["doc_id"]).collect()
    for r in found:
        t, source = docs[r["row"]["doc_id"]]
        want = plain_features(t, r["start"], r["end"], source or "", words)
        assert dict(zip(secrets.FEATURES, r["features"])) == pytest.approx({k: float(v) for k, v in want.items()})
    model = secrets.forest(spark, secrets.Dictionary(words))
    from pyspark.ml.linalg import Vectors

    at = {(r["row"]["doc_id"], r["start"]): model.predict(Vectors.dense(r["features"])) for r in found}
    assert all(bool(at[r["doc_id"], r["start"]]) == r["secret"] for r in got if r["probability"] != 0.5)


#: Text and the value in it, and whether it is a secret: shapes of public key formats and of real code, made apart from the training findings.
SHAPES = [
    ("aws_access_key_id = {A20}", 1), ("AWS_SECRET_ACCESS_KEY={B40}", 1), ('headers = {{"Authorization": "Bearer {B48}"}}', 1), ("git clone https://x-access-token:ghp_{B36}@example.org/a.git", 1),
    ("DATABASE_PASSWORD='{B18}'", 1), ("client_secret: {B32}", 1), ('"private_key": "{B64}"', 1), ("export SLACK_TOKEN=xoxb-{D12}-{B24}", 1), ("api_key={H32}&user=jo", 1), ("credential = \"{H40}\"", 1),
    ("integrity sha512-{B64}", 0), ("commit {H40} merges the branch", 0), ("checksum: {H64}", 0), ("etag md5 {H32}", 0), ("uuid = \"{H8}-{H4}-{H4}-{H4}-{H12}\"", 0), ("import org.apache.commons.lang.builder.ToStringBuilder", 0),
    ("see docs/reference/configuration/advanced/settings.html for more", 0), ("password = your_password_here_1", 0), ("token: xxxxxxxxxxxxxxxxxxxx", 0), ("----------------------------------------", 0), ("max_number_of_open_connections_per_host = 20", 0), ("image digest sha256:{H64}", 0),
]


def test_forest_on_shapes_made_apart(spark):
    r = random.Random(21)
    pools = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "B": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "H": "0123456789abcdef", "D": "0123456789"}
    rows = []
    for i in range(30):
        for form, y in SHAPES:
            rows.append((len(rows), re.sub(r"\{([ABHD])(\d+)\}", lambda m: "".join(r.choice(pools[m[1]]) for _ in range(int(m[2]))), form).replace("{{", "{").replace("}}", "}"), "src", y))
    filler = [(-1 - k, "your password here token integrity commit merges the branch import builder settings number open connections host reference configuration advanced docs more see image digest " * 3, "src", 0) for k in range(3)]
    x = spark.createDataFrame(rows + filler, "doc_id long, text string, source string, y int")
    found = {a["row"]["doc_id"] for a in secrets.findings(x, keep=["doc_id"]).where("secret").collect()}
    real = {i for i, _, _, y in rows if y}
    precision, recall = len(found & real) / max(1, len(found)), len(found & real) / len(real)
    print("precision", precision, "recall", recall, Counter(rows[i][1][:14] for i in real ^ found if i >= 0))
    assert precision >= 0.9 and recall >= 0.9
