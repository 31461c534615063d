"""Registered queries against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe, gif, graph, jaccard, langid, licences, packing, pii, quality, registry, secrets, shards, textarrays


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return c


@pytest.fixture(scope="session")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="session")
def nasty(docs):
    return [t for _, t, *_ in docs]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


# quality


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(table):
    for r in quality.rules(table).collect():
        c = r["counts"]
        want = brute_counts(r["row"]["text"])
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_labelled_documents(spark, sf, duck):
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_quality_rules"](spark, sf).collect()}
    labels = duck.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    judged = [(q, got[i]["kept"]) for i, q in labels if not got[i]["base_failed"]]
    assert np.mean([k for q, k in judged if q]) >= 0.98
    assert np.mean([k for q, k in judged if not q] or [0]) <= 0.2


# personal data

FINDERS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


PERSONAL = [
    "a@b.c d.e+f@g-h.i.j_x@y.z a@b @c.d x@y.z.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1.2.3 0.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (962) 555-2005 +49 30 1 +1234567 ++12 34 56 78 +12345678901234567",
    "🙂 mail: é@x.y jo@host.com é jo@host.com 🙂+33 1 23 45 67 89",
    "mail anna [at] example [dot] org or call (962) 555-2005, ask for Maria Lopez or Dr. House, ssn 123-45-6789",
]


def test_base_spans(spark, table, docs):
    made = spark.createDataFrame([(t,) for t in PERSONAL + [d[1] for d in docs if d[1] and len(d[1]) < 20_000]], "text string")
    for r in pii.find(made).collect():
        t = r["row"]["text"]
        want = [(k, m.start(), m.end()) for k, p in FINDERS.items() for m in re.finditer(p, t) if passes(k, m.group())]
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == want
        assert all(s["kind"] in pii.MORE for s in r["added"])
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r["added"] for b in r["base"])


def test_further_spans_are_learned(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(150).union(spark.createDataFrame([(PERSONAL[-1],)] * 20, "text string"))
    found = {s["kind"] for r in pii.find(rows).where("row.text LIKE 'mail anna%'").collect() for s in r["added"]}
    assert {"at_email", "local_phone"} <= found


def test_reliability_of_a_noisy_labeler():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.5
        v = tuple((1 if y else -1) if r.random() < p else (-1 if y else 1) for p in (0.95, 0.9, 0.55, 0.9))
        counts[v] = counts.get(v, 0) + 1
    _, odds, _ = pii.reliabilities([("phone", v, 1, n) for v, n in counts.items()])
    good = [odds[j, 1, 1] + odds[j, 0, -1] for j in range(4)]
    assert good[2] == min(good) and good[0] > 1.7


# Jaccard


def brute_components(rows, width=3, per_cent=90):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= per_cent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return sorted((str(i), len(s), str(None if i is None else top(i))) for i, s in sets)


def test_jaccard_nasty(table, docs):
    got = jaccard.components_by_similarity(table).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(docs)


@pytest.mark.parametrize("sets,shingles", [(256, 250_000), (8, 400)])
def test_jaccard_families_in_blocks(spark, monkeypatch, sets, shingles):
    """Copies with up to a tenth changed, at every size, whole families or cut into many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    r = random.Random(8)
    rows = []
    for n in (9, 10, 11, 12, 13, 20, 30, 40, 80):
        base = [f"w{r.randrange(3000)}" for _ in range(n + 2)]
        for k in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 28))):
                w[r.randrange(len(w))] = f"v{r.randrange(9999)}"
            rows.append((len(rows), " ".join(w + [f"t{k}"] * (k % 2))))
    r.shuffle(rows)
    got = jaccard.components_by_similarity(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x["id"]), x["n_shingles"], str(x["component_id"])) for x in got) == brute_components(rows)


def test_finer_counts_lose_no_link():
    r, s = np.random.default_rng(4), Fraction(4, 5)
    sets = []
    for size in (1, 5, 90, 700, 2600):
        for _ in range(4):
            whole = np.unique(r.integers(0, 1 << 62, size, dtype=np.uint64))
            sets += [whole, np.unique(np.concatenate((whole[: max(1, int(size * 0.93))], r.integers(0, 1 << 62, size // 20, dtype=np.uint64))))]
    batch = pa.RecordBatch.from_arrays([*[pa.array(range(len(sets)), pa.int64())] * 3, pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "s1", "s2", "shingles"])
    (fine,) = jaccard._fine_counts(iter([batch]))
    points = [np.frombuffer(f, "<u4") for f in fine.column("fine").to_pylist()]
    assert [int(p.sum()) for p in points] == [len(x) for x in sets]
    label, both = np.arange(len(sets)), np.full(len(sets), 2)
    links = [(i, j) for i in label for j in label if i < j and jaccard._alike(sets[i], sets[j], s)]
    assert len(links) > 10
    assert all(jaccard.partners(points, label, both, s)[list({k for pair in links for k in pair})])
    for i, j in links:
        assert all(jaccard.partners([points[i], points[j]], np.array([1, 2]), np.array([0, 1]), s))
        assert not any(jaccard.partners([points[i], points[j]], np.array([1, 1]), np.array([0, 1]), s))
        assert not any(jaccard.partners([points[i], points[j]], np.array([1, 2]), np.array([0, 0]), s))
    apart = [x for k, x in enumerate(points) if k % 2 == 0 and x.sum() > 500]  # no two share a shingle
    assert not any(jaccard.partners(apart, np.arange(len(apart)), np.full(len(apart), 2), s))



def test_overlap_bound_never_misses():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(2))
        points = [np.bincount((textarrays.mix(s, 9) % np.uint64(32)).astype(int), minlength=32) for s in (a, b)]
        assert jaccard.overlap_bound(points[0][None], points[1][None])[0, 0] >= len(np.intersect1d(a, b))


def test_size_classes_cover_pairs():
    s = Fraction(9, 10)
    last, parts = jaccard.size_classes(s, 3000)
    for n in range(1, 2500):
        for m in range(n, int(n / s) + 1):
            a, b = np.searchsorted(last, [n, m])
            assert b - a in (0, 1)
            assert parts[b] > int((n + m) * (1 - s) / (1 + s))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


# tokens


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(library, nasty, texts):
    c = bpe.Codec()
    r = random.Random(2)
    made = ["".join(r.choice("aaab theing  \n\té中한123'sré'll!?.\x1c\x85🙂 ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t in [*nasty, *list(texts.values())[:60], *made]:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert c.encode(t or "") == want
        assert c.decode(want) == library.decode(want, skip_special_tokens=False)
    ids = [r.randrange(50257) for _ in range(500)]
    assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables_may_be_emptied(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    c = bpe.Codec()
    for t in list(texts.values())[:20]:
        assert c.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_bpe_query(spark, sf, texts, library):
    for r in registry.QUERIES["op7_bpe"](spark, sf).collect():
        t = texts[r["doc_id"]]
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


# packing


def test_packing_is_whole_and_tight(spark, docs, table, library):
    got = packing.packed(table).collect()
    want = []
    for i, t, *_ in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(str(i), k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    check_bins(got, 2048)


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in rows) // capacity) + 2


def test_packing_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    r = random.Random(6)
    cut = spark.createDataFrame([(i, 0, 0, r.choice([r.randint(1, 700), 2048]), i, r.getrandbits(63)) for i in range(2000)], "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")
    check_bins(packing.pack(cut).collect(), 2048)


def test_evolution_improves_on_its_parents():
    rng = np.random.default_rng(5)
    lengths = rng.choice([201, 310, 414, 513, 622, 701, 833, 1022], 400)
    one = packing.evolve(lengths, [], 2048, np.random.default_rng(1))
    many = one
    for _ in range(10):
        many = packing.evolve(lengths, many, 2048, rng)
    scores = [packing.fitness(p[0], lengths, 2048) for p in (one, many)]
    assert scores[1] <= scores[0]
    for p in many:
        assert np.bincount(p, lengths).max() <= 2048 and len(p) == len(lengths)


# media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_gif_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (bytes(n), rng.integers(0, 256, n, dtype=np.uint8).tobytes(), (b"abcab" * n)[:n]):
        (media,) = gif.write_gifs([gif.padded(data)])
        image = gif.parse(media)
        gif.lzw_decode(image.frames)
        assert b"".join(f.indices.tobytes() for f in image.frames) == gif.padded(data)


def frame(indices, w, h, palette, **more):
    given = {"left": 0, "top": 0, "interlaced": False, "delay_ms": 0, "disposal": 1, "transparent": -1} | more
    return gif.Frame(width=w, height=h, palette=palette, min_bits=2, data=b"", indices=np.array(indices, np.uint8), **given)


def test_gif_disposal_and_transparency():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    image = gif.Image(2, 1, palette[3])
    image.frames = [frame([1, 1], 2, 1, palette), frame([2], 1, 1, palette, left=1, disposal=2), frame([0, 2], 2, 1, palette, transparent=0, disposal=3), frame([1], 1, 1, palette)]
    shown = [[tuple(p) for p in c[0].tolist()] for c in gif.compose(image)]
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert shown == [[red, red], [red, green], [red, green], [red, blue]]


def test_gif_interlace():
    palette = np.arange(24, dtype=np.uint8).reshape(8, 3)
    image = gif.Image(1, 8, palette[0], [frame([0, 4, 2, 6, 1, 3, 5, 7], 1, 8, palette, interlaced=True)])
    assert [p[0].tolist() for p in next(gif.compose(image))] == palette.tolist()


def test_lzw_with_clear_codes_and_small_alphabet():
    """2-bit pixels, clears in the middle: codes packed by hand."""
    at, out = 0, 0
    bits = [(4, 3), (1, 3), (6, 3), (4, 3), (2, 3), (3, 3), (5, 3)]  # clear 1 (1 1) clear 2 3 end
    for v, n in bits:
        out |= v << at
        at += n
    f = frame([0] * 5, 5, 1, np.zeros((4, 3), np.uint8))
    f.indices, f.data = None, out.to_bytes((at + 7) // 8, "little")
    gif.lzw_decode([f])
    assert f.indices.tolist() == [1, 1, 1, 2, 3]


def test_broken_gifs_are_told(spark):
    good = gif.write_gifs([gif.padded(b"abc")])[0]
    rows = gif.read(spark.createDataFrame([(good,), (good[:300],), (b"junk",), (None,), (good[:-200] + b"\x00\x3b",)], "media binary")).collect()
    assert [r["failed"] is None for r in rows] == [True, False, False, True, False]
    assert rows[0]["frames"][0]["delay_ms"] == 40 and sum(rows[0]["frames"][0]["reds"]) == 576


def test_gif_query(spark, sf, texts):
    for r in registry.QUERIES["op6_gif_media"](spark, sf).collect():
        p = gif.padded(texts[r["doc_id"]].encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# language


def test_language_held_out_accuracy(spark, sf, duck):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = registry.QUERIES["op10_language_id"](spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_backs_off(spark):
    train = spark.createDataFrame([("the cat that sat there", "en"), ("der hund und die katze", "de")] * 30, "text string, lang string")
    model = langid.train(train)
    rows = langid.identified(spark.createDataFrame([("thathe",), ("undder",), ("!! 12",), (None,), ("キ",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in rows] == ["en", "de", "und", "und", "de"]
    assert langid.identified(train, langid.train(train.limit(0))).where("lang_pred <> 'und'").count() == 0


# secrets, licences, shards


def test_secrets_found_and_false_ones_left(spark, sf, texts):
    got = registry.QUERIES["op1_secret_scan"](spark, sf).where("secret").collect()
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == want


def test_forest_on_unseen_findings(spark):
    words = frozenset()
    model = secrets.forest(spark, words)
    from pyspark.ml.linalg import Vectors

    cases = secrets.labelled_findings(600, seed=99)
    right = [model.predict(Vectors.dense(secrets.features(v, b, a, p, words))) == y for v, b, a, p, y in cases]
    assert np.mean(right) >= 0.95


def test_redaction(spark):
    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    x = spark.createDataFrame([(1, f'é a token = "{key}" b token = "{key[::-1]}" c', "s"), (2, f"commit {key} sha256", None), (3, None, None), (1, "plain", "s")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], str(r["text"])) for r in secrets.redacted(x).collect())
    assert got == [(1, 'plain'), (1, 'é a token = "[secret]" b token = "[secret]" c'), (2, f"commit {key} sha256"), (3, "None")]


def test_licences(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.": ["Apache-2.0"],
        "This work is licensed under the GNU General Public License, version 3; or (at your option) any later version.": ["GPL-3.0-or-later"],
        "Copyright (c) 2020 Jo.\nAll rights reserved.": ["Proprietary"],
        "Released under the MIT License. x. Licensed under CC BY-NC 4.0.": ["MIT", "CC-BY-NC"],
        "Some new licence text.": [],
        "nothing": [],
    }
    rows = licences.scanned(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r["row"]["text"]: r["licences"] for r in rows} == cases
    assert {r["row"]["text"]: r["sentences"] for r in rows}["Some new licence text."] == ["Unknown"]


def test_shards_compact_and_versions(spark, tmp_path):
    x = spark.range(4000).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 20) AS text")
    store = shards.Shards(spark, f"file://{tmp_path}/s", target=50_000, fan_in=3)
    for k in range(7):
        store.append(x.where(f"doc_id % 7 = {k}"))
        store.compact(x.schema)
    runs = store.runs()
    tiers = [r["tier"] for r in runs]
    assert max(map(tiers.count, tiers)) < 3 and sum(r["rows"] for r in runs) == 4000
    assert store.read(x.schema).exceptAll(x).isEmpty() and store.read(x.schema).count() == 4000
    old = store.versions()[0]
    assert store.read(x.schema, old).count() == len([i for i in range(4000) if i % 7 == 0])
    with pytest.raises(FileExistsError):
        store.commit(runs, old)
    store.vacuum()
    assert store.read(x.schema).count() == 4000


# the pipeline


def test_pipeline_stages(spark, sf, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert all(k.columns == docs.columns for k in kept[:-1])
    good = {r["doc_id"] for r in registry.QUERIES["op2_quality_rules"](spark, sf).where("kept").collect()}
    assert ids[1] == good
    rows = [(i, texts[i]) for i in ids[2]]
    assert ids[3] == {int(c) for _, _, c in brute_components(rows, 5, 80)}
    masked = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert masked == {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}', r"\1[secret]", texts[i]) for i in ids[3]}
    assert ids[5] == ids[4]
    check_bins(kept[5].collect(), 2048)
