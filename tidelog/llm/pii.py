"""Personal data by weak supervision.

Candidate spans come from one pattern a kind. Four base kinds (email, ip,
card, phone) are found exactly as stated and always stay; further kinds are
candidates that the model accepts or refuses. Labelers vote +1, 0 or -1 on
each candidate: its format (regex), its prefixes or endings (gazetteer), the
six words before it (context) and what it touches (edges). Candidates are
counted by kind, votes and the span's own features (length, share of digits,
parts, and whether a cue of any kind is among its words and neighbours), a
table of at most 9 * 81 * 4 * 4 * 4 * 2 rows whatever the corpus;
expectation-maximisation over those counts estimates how reliable each
labeler is on each kind, and a logistic span classifier is trained on the
resulting posteriors. It sees the features besides the votes, so that spans
on which labelers are silent or at odds are judged by their like. Only
DataFrame and SQL functions run on the corpus.

Offsets are in code points. Null texts count as empty; an empty table gives
no rows; overlapping further spans of one kind cannot arise, and those that
overlap a base span are dropped. A span is added where its score is above 0;
a tie at 0 is not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, written

#: Base kinds in their order. Quantifiers are possessive and starts are tied to
#: the edge of a run (or the end of the last match), which changes no match but
#: keeps the matcher linear and its stack flat on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Given names that may begin a person's name, titles, and address endings: fixed values.
NAMES = "Anna Antonio Carlos Charles Claire David Elena Elizabeth Emma Hans James Jean Johann John Jose Karl Klaus Laura Linda Luis Maria Marie Mary Michael Paul Peter Pierre Robert Sophie Susan Thomas William".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Senor Senora".split()
ENDINGS = "com org net edu gov io de fr es uk eu info".split()
#: Further kinds.
MORE = {
    "at_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?:(?:" + "|".join(TITLES) + r")\.? \p{Lu}\p{Ll}++|(?:" + "|".join(NAMES) + r") \p{Lu}\p{Ll}++)",
}
KINDS = (*BASE, *MORE)
VOTES = ("format", "gazetteer", "context", "edges")
#: The span's features and how many values each has.
OWN = {"size": 4, "digits": 4, "parts": 4, "cue": 2}
#: Words that speak for a kind shortly before it, and words that speak against any.
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "at_email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta|pay",
    "phone": r"phone|call|\btel|fax|mobil|whatsapp|nummer",
    "local_phone": r"phone|call|\btel|fax|mobil|whatsapp|nummer",
    "national_id": r"ssn|social|security|\bid\b|insurance",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "person": "name|dear|by|signed|contact|author|regards",
}
AGAINST = r"version|\bv$|build|isbn|issue|section|page|figure|[$€£#]$|[=/]$"
#: What must be in a text for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "national_id": "-"}


def _found(t: Column, kind: str, pattern: str) -> Column:
    got = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return F.when(F.contains(t, F.lit(NEEDS[kind])), got).otherwise(F.array().cast("array<string>")) if kind in NEEDS else got


def _placed(kind: str, pattern: str) -> str:
    """SQL: matches of a kind as structs of start, end, text, and what stands before and after.

    Parts and matches alternate, so starts are running sums of their lengths.
    """
    lit = "r'" + pattern.replace("'", "\\'") + "'"
    parts = f"split(t, {lit}, -1)"
    trios = f"zip_with(zip_with(slice(p, 1, size({kind})), {kind}, (b, m) -> struct(b AS b, m AS m)), slice(p, 2, size({kind})), (x, a) -> struct(length(x.b) AS n, substring_index(x.b, ' ', -6) AS b, x.m AS m, substring_index(a, ' ', 3) AS a))"
    step = "(acc, x) -> named_struct('at', acc.at + x.n + length(x.m), 'out', concat(acc.out, array(named_struct('start', acc.at + x.n, 'end', acc.at + x.n + length(x.m), 'm', x.m, 'b', x.b, 'a', x.a))))"
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, m: STRING, b: STRING, a: STRING>>)"
    walk = f"aggregate({trios.replace('slice(p,', f'slice({parts},')}, named_struct('at', 0, 'out', {empty}), {step}, acc -> acc.out)"
    return f"if(size({kind}) = 0, {empty}, {walk})"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(sequence(1, length({_DIGITS})), i -> CAST(substr({_DIGITS}, -i, 1) AS INT) * (2 - i % 2)"
    f" - if(i % 2 = 0 AND CAST(substr({_DIGITS}, -i, 1) AS INT) > 4, 9, 0)), 0, (n, k) -> n + k) % 10 = 0"
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: SQL on x, a match: what a base match must pass. A further kind's format vote uses STRICT.
PASSES = {
    "email": "true",
    "ip": rf"x.m RLIKE r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": f"if(length({_DIGITS}) BETWEEN 16 AND 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
STRICT = {
    "at_email": "x.m RLIKE r'dot'",
    "local_phone": r"x.m RLIKE r'^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([ .-]))[0-9]{3}[ .-]?[0-9]{4}$|^[(]?[2-9]'",
    "national_id": "NOT x.m RLIKE r'^(?:000|666|9)|-00-|-0000$'",
    "iban": "length(replace(x.m, ' ', '')) BETWEEN 15 AND 34",
    "person": "x.m RLIKE r'^(?:" + "|".join(TITLES) + r")\b'",
}
GAZETTEER = {
    "email": f"x.m RLIKE r'[.](?:{'|'.join(ENDINGS)})$'",
    "at_email": f"x.m RLIKE r'(?:{'|'.join(ENDINGS)})$'",
    "ip": "NOT x.m RLIKE r'^(?:0|127|255)[.]'",
    "card": "x.m RLIKE '^[3-6]'",
    "phone": r"x.m RLIKE r'^\+(?:1|33|34|44|49|[2-9])'",
    "local_phone": r"NOT x.m RLIKE r'^\(?[01]'",
    "national_id": "NOT x.m RLIKE '^(?:9|000|666)'",
    "iban": "x.m RLIKE '^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT)'",
    "person": f"x.m RLIKE r'(?:^| )(?:{'|'.join(NAMES)})\\b'",
}


def _voted(kind: str) -> str:
    """SQL: the placed matches of a kind with votes and a size class."""
    sign = lambda sql: f"if({sql}, 1, -1)"
    context = f"CASE WHEN lower(x.b) RLIKE r'{AGAINST}' THEN -1 WHEN lower(x.b) RLIKE r'{CUES[kind]}' THEN 1 ELSE 0 END"
    edges = r"CASE WHEN x.b RLIKE r'[\p{L}0-9_=/#$]$' OR x.a RLIKE r'^[\p{L}0-9_]' THEN -1 WHEN (x.b = '' OR x.b RLIKE r'[\s(:;,]$') AND (x.a = '' OR x.a RLIKE r'^[\s).,:;!?]') THEN 1 ELSE 0 END"
    votes = dict(zip(VOTES, (sign(PASSES.get(kind) or STRICT[kind]), sign(GAZETTEER[kind]), context, edges), strict=True))
    own = {
        "size": "if(length(x.m) < 10, 0, if(length(x.m) < 16, 1, if(length(x.m) < 24, 2, 3)))",
        "digits": f"CAST(floor(3.99 * length({_DIGITS}) / length(x.m)) AS INT)",
        "parts": r"least(3, size(split(x.m, r'[ .()\[\]@-]+')) div 2)",
        "cue": f"CAST(lower(concat(x.b, ' ', x.m, ' ', x.a)) RLIKE r'{'|'.join(dict.fromkeys(CUES.values()))}' AS INT)",
    }
    fields = ", ".join(f"'{k}', {v}" for k, v in {**votes, **own}.items())
    return f"transform({kind}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, {fields}))"


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, seen): kept columns, base spans in order, and all candidates with their votes."""
    carried = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    x = df.select(carried.alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    patterns = {**BASE, **MORE}
    x = x.select("row", "t", *[_found(F.col("t"), k, p).alias(k) for k, p in patterns.items()])
    x = x.selectExpr("row", *[f"{_placed(k, p)} AS {k}" for k, p in patterns.items()])
    # what fails its base check is dropped from the base, but stays a candidate that teaches the model
    x = x.selectExpr("row", *[f"{_voted(k)} AS {k}" for k in KINDS])
    base = "concat(" + ", ".join(f"filter({k}, s -> s.format = 1)" for k in BASE) + ")"
    x = x.selectExpr("row", f"transform({base}, s -> struct(s.kind, s.start, s.end)) AS base", f"concat({', '.join(KINDS)}) AS seen")
    return written(x, "pii")


def reliabilities(cells: list[tuple], rounds: int = 60) -> tuple[dict, dict, list[float]]:
    """Expectation-maximisation over counted vote patterns.

    cells: (kind, votes, own features, n). Returns each kind's share of true spans,
    P(vote | true or false) of each labeler by (kind, labeler, truth, vote)
    and, for all kinds together, by (labeler, truth, vote), and each cell's
    posterior. What a kind has few spans to say about leans on all kinds'
    spans, which count for 20 of its own.
    """
    share = {k: 0.5 for k in KINDS}
    start = {(j, y, v): p for j in range(len(VOTES)) for y, ps in ((1, (0.1, 0.3, 0.6)), (0, (0.6, 0.3, 0.1))) for v, p in zip((-1, 0, 1), ps, strict=True)}
    start |= {(VOTES.index("context"), y, -1): p for y, p in ((1, 0.02), (0, 0.68))}  # words against a span seldom stand before a true one
    odds = {(k, *key): p for k in KINDS for key, p in start.items()}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _own, _n in cells:
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for j, v in enumerate(votes):
                yes += math.log(odds[kind, j, 1, v])
                no += math.log(odds[kind, j, 0, v])
            post.append(1 / (1 + math.exp(max(-50.0, min(50.0, no - yes)))))
        total, true = dict.fromkeys(KINDS, 2.0), dict.fromkeys(KINDS, 1.0)
        seen = dict.fromkeys(odds, 0.0)
        for (kind, votes, _own, n), p in zip(cells, post, strict=True):
            total[kind] += n
            true[kind] += n * p
            for j, v in enumerate(votes):
                seen[kind, j, 1, v] += n * p
                seen[kind, j, 0, v] += n * (1 - p)
        share = {k: min(0.98, max(0.02, true[k] / total[k])) for k in KINDS}
        every = {key: 20 * start[key] + sum(seen[k, *key] for k in KINDS) for key in start}
        common = {(j, y, v): s / sum(every[j, y, u] for u in (-1, 0, 1)) for (j, y, v), s in every.items()}
        leaned = {key: s + 20 * common[key[1:]] for key, s in seen.items()}
        odds = {(k, j, y, v): s / sum(leaned[k, j, y, u] for u in (-1, 0, 1)) for (k, j, y, v), s in leaned.items()}
    return share, {**common, **odds}, post


def _marks(kind: str, votes: tuple, own: tuple) -> dict[str, float]:
    """A cell as the classifier sees it."""
    return {"one": 1.0, kind: 1.0, **{f"{name}{v}": 1.0 for name, v in zip(OWN, own, strict=True)}, **{n: float(v) for n, v in zip(VOTES, votes, strict=True)}, **{f"{kind}.{n}": float(v) for n, v in zip(VOTES, votes, strict=True)}}


def classifier(cells: list[tuple], post: list[float], rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic span classifier trained on the posteriors of the counted cells, each kind with the same say."""
    weights = {"one": 0.0, **{k: 0.0 for k in KINDS}, **{v: 0.0 for v in VOTES}, **{f"{k}.{v}": 0.0 for k in KINDS for v in VOTES}, **{f"{name}{i}": 0.0 for name, n in OWN.items() for i in range(n)}}
    of = dict.fromkeys(KINDS, 0)
    for kind, _, _, n in cells:
        of[kind] += n
    kinds = sum(n > 0 for n in of.values()) or 1
    rows = [(_marks(kind, votes, own), n / of[kind] / kinds, p) for (kind, votes, own, n), p in zip(cells, post, strict=True)]
    for _ in range(rounds):
        slope = {k: 0.0005 * w for k, w in weights.items()}
        for x, n, p in rows:
            z = sum(weights[k] * v for k, v in x.items())
            off = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for k, v in x.items():
                slope[k] += off * v
        weights = {k: w - 1.5 * slope[k] for k, w in weights.items()}
    return weights


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's rows as (row, base, added): kept columns, and arrays of (kind, start, end) structs."""
    x = candidates(df, text, keep)
    names = [*VOTES, *OWN]
    spans = x.selectExpr("explode(seen) AS s").selectExpr("s.kind AS kind", *[f"s.{v} AS {v}" for v in names])
    counted = spans.groupBy("kind", *names).agg(F.count("*").alias("n")).collect()  # at most 9 * 81 * 128 rows
    cells = sorted((r["kind"], tuple(r[v] for v in VOTES), tuple(r[v] for v in OWN), r["n"]) for r in counted)
    _share, _odds, post = reliabilities(cells)
    w = classifier(cells, post)
    pick = lambda of, names: "CASE " + of + " ".join(f" WHEN {n} THEN {w[k]!r}D" for n, k in names) + " ELSE 0D END"
    own = [pick(f"s.{name}", [(str(i), f"{name}{i}") for i in range(n)]) for name, n in OWN.items()]
    votes = [f"({w[v]!r}D + {pick('s.kind', [(repr(k), f'{k}.{v}') for k in KINDS])}) * s.{v}" for v in VOTES]
    score = " + ".join([f"{w['one']!r}D", pick("s.kind", [(f"'{k}'", k) for k in KINDS]), *own, *votes])
    more = ", ".join(f"'{k}'" for k in MORE)
    apart = "NOT exists(base, b -> b.start < s.end AND s.start < b.end)"
    return x.selectExpr("row", "base", f"transform(filter(seen, s -> s.kind IN ({more}) AND {score} > 0 AND {apart}), s -> struct(s.kind, s.start, s.end)) AS added")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: personal data in every whole text.

    A null or empty text has no spans and the digest of the empty string;
    repeated rows are judged alike; an empty table gives no rows; other
    columns are ignored.
    """
    x = find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    told = lambda a: f"array_join(transform({a}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE]
    return x.selectExpr("row.doc_id AS doc_id", *counts, f"sha2({told('base')}, 256) AS base_sha256", f"{told('concat(base, added)')} AS spans")
