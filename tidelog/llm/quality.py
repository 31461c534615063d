"""Quality rules with thresholds that adapt to each language and source.

Every document gets integer measures. For each (language, source) and
measure a quantile sketch is kept: counts by log-linear bucket, exact below
64 and within 1/32 above. Sketches merge by adding counts, so they are plain
partial aggregates and a hot source costs no more than any other. A sketch's
fence is its upper quartile plus the most of four quartile ranges, half the
upper quartile, and a floor for groups whose quartiles agree. A group's own
fence is blended with that of its language, and this with that of the corpus,
by weight: documents against WEIGHT, so that few documents lean on many and
no size is a switch. A document is kept if it passes the fixed base rule and
no measure lies beyond its group's fence.

Only DataFrame and SQL functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, written

#: Measures held against a fence, with the floor of its distance from the upper quartile.
FLOOR = {"symbols_pm": 20, "upper_pm": 30, "repeat_pm": 300, "dup_lines_pm": 350, "word_len_pc": 50}
#: How many documents the wider sketch counts for beside a group's own.
WEIGHT = 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
_SPACE = r"[\\x20\\x09-\\x0D]+"


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, counts): the whole input row as a struct, and its integer counts.

    Null counts as an empty text. No lambda refers to a column outside it, so
    that nothing is evaluated again for each element. Windows are sorted with
    their places, neighbours compared, and the places found are widened to
    the words that they cover.
    """
    x = df.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    x = x.selectExpr("row", "t", f"filter(split(t, '{_SPACE}'), w -> w != '') AS w", f"filter(split(t, '\n'), s -> regexp_replace(s, '{_SPACE}', '') != '') AS l")
    pairs = "zip_with(w, slice(w, 2, greatest(size(w), 1)), (a, b) -> concat(a, ' ', b))"
    threes = f"slice(zip_with({pairs}, slice(w, 3, greatest(size(w), 1)), (a, b) -> concat(a, ' ', b)), 1, greatest(size(w) - 2, 0))"
    x = x.selectExpr("row", "t", "l", "size(w) AS n_words", f"sort_array(transform({threes}, (x, i) -> struct(x AS x, i AS i))) AS s")
    x = x.selectExpr("row", "t", "l", "n_words", "s", "zip_with(s, slice(s, 2, greatest(size(s), 1)), (a, b) -> b IS NOT NULL AND a.x = b.x) AS same")
    found = "zip_with(zip_with(s, same, (a, e) -> struct(a.i AS i, e AS e)), concat(array(false), same), (a, p) -> if(a.e OR p, a.i, NULL))"
    x = x.selectExpr("row", "t", "l", "n_words", f"sort_array(filter({found}, i -> i IS NOT NULL)) AS p")
    counts = {
        "n_words": "n_words",
        "word_chars": f"length(regexp_replace(t, '{_SPACE}', ''))",
        "n_symbols": "length(regexp_replace(t, '[^#*$%&|<>]+', ''))",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": "aggregate(zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> if(b IS NULL, 3, least(3, b - a))), 0, (n, k) -> n + k)",
        "n_upper": r"length(regexp_replace(t, '[^\\p{Lu}]+', ''))",
        "n_lines": "size(l)",
    }
    return x.selectExpr("row", "named_struct(" + ", ".join(f"'{k}', CAST({v} AS BIGINT)" for k, v in counts.items()) + ") AS counts")


def _measures(c: str) -> dict[str, str]:
    """SQL of the measures from counts, in whole thousandths or hundredths."""
    return {
        "symbols_pm": f"({c}.n_symbols * 1000) div greatest({c}.n_words, 1)",
        "upper_pm": f"({c}.n_upper * 1000) div greatest({c}.word_chars, 1)",
        "repeat_pm": f"({c}.n_repeat_words * 1000) div greatest({c}.n_words, 1)",
        "dup_lines_pm": f"({c}.n_dup_lines * 1000) div greatest({c}.n_lines, 1)",
        "word_len_pc": f"({c}.word_chars * 100) div greatest({c}.n_words, 1)",
    }


def bucket(v: str) -> str:
    """SQL: the least value of v's bucket; 32 buckets to each power of two from 64 on."""
    return f"if({v} < 64, {v}, shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6))"


def _fences(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, docs and one fence a measure from the sketches that cells merge to."""
    merged = cells.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))
    over = ", ".join([*by, "measure"])
    ranked = merged.selectExpr("*", f"sum(n) OVER (PARTITION BY {over} ORDER BY cell) AS upto", f"sum(n) OVER (PARTITION BY {over}) AS total")
    quart = ranked.groupBy(*by, "measure").agg(
        F.expr("min(cell) FILTER (WHERE upto * 4 >= total)").alias("q1"), F.expr("min(cell) FILTER (WHERE upto * 4 >= total * 3)").alias("q3"), F.max("total").alias("docs")
    )
    fence = [F.expr(f"max(q3 + greatest(4 * (q3 - q1), q3 div 2, {floor})) FILTER (WHERE measure = '{m}')").alias(f"{m}_most") for m, floor in FLOOR.items()]
    return quart.groupBy(*by).agg(F.max("docs").alias("docs"), *fence)


def rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, weight: int = WEIGHT) -> DataFrame:
    """df's rows as (row, counts, fences, base_failed, kept).

    row holds the columns in keep (all, if None), so extra columns may have
    any name. Null languages and sources are groups of their own; null, empty
    and short texts fail the base rule; repeated rows are judged one by one,
    and all alike; an empty table gives no rows. Groups are ranked on the
    whole table. weight: how many documents a group's language, and a
    language's corpus, count for beside its own; 0 gives each group its own
    fence alone.
    """
    carried = F.struct(*[F.col(f"row.`{c}`") for c in (df.columns if keep is None else keep)])
    x = measured(df, text).select(carried.alias("row"), "counts", F.col(f"row.`{lang}`").cast("string").alias("lang"), F.col(f"row.`{source}`").cast("string").alias("source"))
    x = written(x, "quality")
    stacked = ", ".join(f"'{m}', {v}" for m, v in _measures("counts").items())
    cells = x.selectExpr("lang", "source", f"stack({len(FLOOR)}, {stacked}) AS (measure, v)").selectExpr("lang", "source", "measure", f"{bucket('v')} AS cell")
    cells = written(cells.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n")), "sketches")
    own, by_lang, whole = (_fences(cells.withColumn("one", F.lit(1)), by) for by in (["one", "lang", "source"], ["lang"], ["one"]))
    names = [f"{m}_most" for m in FLOOR]
    pick = lambda a: [F.col(f"{a}.docs").alias(f"{a}_docs"), F.struct(*[F.col(f"{a}.{n}") for n in names]).alias(a)]
    fences = own.alias("own").join(by_lang.alias("lng"), F.expr("own.lang <=> lng.lang"))
    fences = fences.select("own.lang", "own.source", "own.one", *pick("own"), *pick("lng")).join(whole.alias("all").select("one", *pick("all")), "one")
    blend = lambda n: f"(own_docs * own.{n} + {weight} * ((lng_docs * lng.{n} + {weight} * all.{n}) div (lng_docs + {weight}))) div (own_docs + {weight}) AS {n}"
    fences = fences.selectExpr("lang", "source", f"struct({', '.join(map(blend, names))}) AS fences")
    fences = written(fences, "fences")
    x = x.alias("x").join(fences.alias("f"), F.expr("x.lang <=> f.lang AND x.source <=> f.source")).select("row", "counts", "fences")
    failed = "(counts.n_words < 50 OR 100 * counts.n_repeat_words > 50 * counts.n_words)"
    within = " AND ".join(f"{v} <= fences.{m}_most" for m, v in _measures("counts").items())
    return x.selectExpr("row", "counts", "fences", f"{failed} AS base_failed", f"NOT {failed} AND {within} AS kept")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures' fences."""
    out = rules(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return out.select("row.doc_id", *[f"counts.{c}" for c in _COUNTS[:5]], "base_failed", "kept", *[f"fences.{m}_most" for m in FLOOR])


def _sql_fences(by: str) -> str:
    on = f"{by}, " if by else ""
    fences = ", ".join(f"max(q3 + greatest(4 * (q3 - q1), q3 // 2, {s})) FILTER (measure = '{m}') AS {m}_most" for m, s in FLOOR.items())
    return f"""SELECT {on}max(total) AS docs, {fences} FROM (
        SELECT {on}measure, min(cell) FILTER (upto * 4 >= total) AS q1, min(cell) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total FROM (
            SELECT {on}measure, cell, sum(n) OVER (PARTITION BY {on}measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {on}measure) AS total
            FROM (SELECT {on}measure, cell, count(*) AS n FROM cells GROUP BY ALL))
        GROUP BY ALL) GROUP BY ALL"""


_SQL_MEASURES = {k: v.replace("counts.", "").replace(" div ", " // ") for k, v in _measures("counts").items()}
_SQL_BUCKET = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"

ORACLE_SQL = f"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents),
places AS (SELECT doc_id, t, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM places),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY doc_id),
counts AS (
    SELECT words.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(len(l) AS BIGINT) AS n_lines
    FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
cells AS (
    SELECT lang, source, measure, {_SQL_BUCKET} AS cell FROM (
        {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM counts" for m, v in _SQL_MEASURES.items())})),
own AS ({_sql_fences("lang, source")}), lng AS ({_sql_fences("lang")}), whole AS ({_sql_fences("")}),
fences AS (
    SELECT own.lang, own.source, {", ".join(f"CAST((own.docs * own.{m}_most + {WEIGHT} * ((lng.docs * lng.{m}_most + {WEIGHT} * whole.{m}_most) // (lng.docs + {WEIGHT}))) // (own.docs + {WEIGHT}) AS BIGINT) AS {m}_most" for m in FLOOR)}
    FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang CROSS JOIN whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{v} <= {m}_most" for m, v in _SQL_MEASURES.items())} AS kept,
       {", ".join(f"{m}_most" for m in FLOOR)}
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts) c
JOIN fences f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""
