"""What a reviewer found to do less than the whole job, held against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tidelog.llm import jaccard, secrets

# near-duplicates by five words and 0.8


def five_word_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: top(i) for i, _ in sets}


def near_copies():
    """Copies at every distance around the rule, of 5 to 1,500 words, some of them exact, and a text with a repeated id."""
    r = random.Random(11)
    rows = []
    for n in (5, 6, 9, 12, 20, 45, 90, 200, 200, 400, 1500):
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        for k in range(10):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 40))):
                w[r.randrange(n)] = f"v{r.randrange(99999)}"
            rows.append((len(rows), " ".join(w + [f"t{len(rows)}x{i}" for i in range(n * 15 // 100 * (k % 3 == 2))])))
        rows.append((len(rows), rows[-1][1]))
    r.shuffle(rows)
    return rows + [(10_000, ""), (10_001, None)]


def test_pipeline_near_duplicates_by_five_words(spark):
    import corpus_pipeline as p

    rows = near_copies()
    got = {r["doc_id"] for r in p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == set(five_word_components(rows).values())


def test_components_by_five_words(spark):
    rows = near_copies()
    got = jaccard.components_by_similarity(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=Fraction(4, 5)).collect()
    assert {r["id"]: r["component_id"] for r in got} == five_word_components(rows)


def test_a_text_that_is_a_copy_under_an_id_of_two_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(100)) for k in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " tail")]
    got = jaccard.components_by_similarity(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=Fraction(4, 5)).collect()
    assert [r["component_id"] for r in got] == [1] * 4


@pytest.mark.parametrize("n", [6, 10, 30, 200, 1000, 6000])
def test_pairs_at_the_rule_share_a_key_and_others_few(n):
    """At 0.8 exactly every pair meets; sets that share nothing do not, whatever stays empty."""
    rng = np.random.default_rng(n)
    s = Fraction(4, 5)
    for _ in range(20):
        new = lambda k: rng.integers(1, 1 << 62, k).astype(np.uint64)
        a = new(n)
        more = int(rng.integers(0, n // 4 + 1))  # added; the rest of the allowance is removed
        gone = next(g for g in range(n, -1, -1) if 5 * (n - g) >= 4 * (n + more))
        sets = [np.sort(a), np.sort(np.concatenate((a[gone:], new(more)))), np.sort(new(n))]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        doc, key = jaccard._pair_keys(offsets, np.concatenate(sets), s)
        keys = [set(key[doc == k].tolist()) for k in range(3)]
        assert gone + more == 0 or keys[0] & keys[1]
        assert not keys[0] & keys[2] or n < 12


# assigned secrets

KEY = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
ASSIGNED = [
    (f"word export API_KEY={KEY} more", KEY),
    ("word password=Sup3rS3cretXy9kQ27bZ more", "Sup3rS3cretXy9kQ27bZ"),
    (f"word AWS_SECRET_ACCESS_KEY={KEY} more", KEY),
    (f'word AWS_SECRET_ACCESS_KEY = "{KEY}" more', KEY),
    (f"see x.org/login?token={KEY}&user=bob more", KEY),
    (f"word MY_APP_TOKEN={KEY}", KEY),
]


@pytest.mark.parametrize("text,value", ASSIGNED)
def test_assigned_values_are_candidates_with_their_evidence(text, value):
    spans = [(s, e) for s, e in secrets.candidate_spans(text) if value in text[s:e]]
    assert [text[s:e] for s, e in spans] == [value]
    s, e = spans[0]
    told = dict(zip(secrets.FEATURES, secrets.features(value, text[max(0, s - 60) : s], text[e : e + 30], "src", frozenset())))
    assert (told["assigned"], told["cue"]) == (1, 1)


def test_assigned_values_are_masked_without_their_names(spark):
    rows = [(i, t, "src") for i, (t, _) in enumerate(ASSIGNED)]
    got = secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: t.replace(v, "[secret]") for i, (t, v) in enumerate(ASSIGNED)}


def test_what_values_leave_of_runs_is_judged():
    text = f"{'ab0/' * 6}password={KEY} {KEY[::-1]}"
    assert [text[s:e] for s, e in secrets.candidate_spans(text)] == ["ab0/" * 6, KEY, KEY[::-1]]


def test_labelled_findings_are_candidates():
    for v, b, a, _, _ in secrets.labelled_findings(300, seed=3):
        assert (len(b), len(b) + len(v)) in secrets.candidate_spans(b + v + a) or len(b) == 60
