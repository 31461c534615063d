"""Licence scans by sentence rules.

Sentences that speak of licensing are normalised (lower case, letters and
digits only) and mapped to known licence-sentence identifiers. A text's
identifiers, in order, are then matched against ordered licence rules: each
rule names a licence and a sequence of identifiers, and takes what it matches
out of the sequence, so that a specific rule leaves nothing for a general one
after it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents

#: Identifier and normalised sentence (a pattern for the whole sentence).
SENTENCES = (
    ("ApacheUnder", r"(?:this (?:work|file|software|project|code) is )?licensed under (?:the )?apache licen[sc]e(?: version)? 2(?: 0)?(?: the licen[sc]e)?"),
    ("ApacheCompliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("ApacheObtain", r"you may obtain a copy of the licen[sc]e at .*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis .*"),
    ("ApacheSee", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("MITUnder", r"(?:this (?:work|file|software|project|code) is )?(?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?mit licen[sc]e"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("MITNotice", r"the above copyright notice and this permission notice .*shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", r"the software is provided as is without warranty of any kind .*"),
    ("BSDUnder", r"(?:this (?:work|file|software|project|code) is )?(?:released|licensed|available|distributed) under (?:the )?(?:new |simplified |[23] clause )?bsd (?:[23] clause )?licen[sc]e"),
    ("BSDGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that .*"),
    ("BSDNoEndorse", r"neither the name .*endorse or promote products derived from this software .*"),
    ("GPL3", r"(?:this (?:work|file|software|program|project) is )?licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 3(?: 0)?"),
    ("GPL2", r"(?:this (?:work|file|software|program|project) is )?licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 2(?: 0)?"),
    ("LGPL", r"(?:this (?:work|file|software|library|project) is )?licensed under (?:the )?(?:terms of the )?gnu (?:lesser|library) general public licen[sc]e.*"),
    ("AGPL", r"(?:this (?:work|file|software|program|project) is )?licensed under (?:the )?(?:terms of the )?gnu affero general public licen[sc]e.*"),
    ("OrLater", r"(?:or )?at your option any later version"),
    ("MPL2", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0|licensed under (?:the )?mozilla public licen[sc]e (?:version )?2 0"),
    ("CCBYNC", r"(?:this (?:work|file|text) is )?licensed under (?:a )?(?:cc|creative commons) (?:by nc|attribution noncommercial)(?: \d \d)?"),
    ("CCBYSA", r"(?:this (?:work|file|text) is )?licensed under (?:a )?(?:cc|creative commons) (?:by sa|attribution sharealike)(?: \d \d)?"),
    ("CCBY", r"(?:this (?:work|file|text) is )?licensed under (?:a )?(?:cc|creative commons) (?:by|attribution)(?: \d \d)?"),
    ("PublicDomain", r"(?:this (?:work|file|text|software) (?:is|has been) )?(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"(?:copyright|c) (?:c )?(?:\d{4} ?)+.*"),
)
#: Licence and the identifiers that make it, in order; a later rule sees what earlier ones left.
RULES = (
    ("Apache-2.0", ("ApacheUnder", "ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheUnder",)),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITUnder",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDNoEndorse")),
    ("BSD-2-Clause", ("BSDGrant",)),
    ("BSD", ("BSDUnder",)),
    ("AGPL", ("AGPL",)),
    ("LGPL", ("LGPL",)),
    ("GPL-3.0-or-later", ("GPL3", "OrLater")),
    ("GPL-3.0", ("GPL3",)),
    ("GPL-2.0-or-later", ("GPL2", "OrLater")),
    ("GPL-2.0", ("GPL2",)),
    ("MPL-2.0", ("MPL2",)),
    ("CC-BY-NC", ("CCBYNC",)),
    ("CC-BY-SA", ("CCBYSA",)),
    ("CC-BY", ("CCBY",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Proprietary", ("AllRights",)),
)
_TERMS = r"(?:this (?:program|library|file|software|work|project) is free software )?(?:you can|it can be) redistributed? (?:it )?and or modif(?:y|ied) (?:it )?under the terms of the gnu "
_LATER = r"(?: of the licen[sc]e)?(?: or)? at your option any later version"
_FSF = r"(?: as published by the free software foundation)?"
#: Kinds of one licence family, as its short and its long names say them, the narrowest first.
CC_KINDS = (
    ("BY-NC-SA", "by nc sa", "attribution non ?commercial share ?alike"),
    ("BY-NC-ND", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    ("BY-NC", "by nc", "attribution non ?commercial"),
    ("BY-SA", "by sa", "attribution share ?alike"),
    ("BY-ND", "by nd", "attribution no ?deriv(?:s|atives|ative works)"),
    ("BY", "by", "attribution"),
)
_CC = r"(?:.* )?(?:licensed|available|released|published|distributed) under (?:the |a )?(?:terms of the )?(?:cc|creative commons) (?:{}|{})(?: \d \d)?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?(?: cc {})?(?: \d \d)?"
#: Sentences of whole licence texts and notices, which the query's SQL does not name; looked up after SENTENCES.
TEXT_SENTENCES = (
    ("ApacheObtain", r"you may obtain a copy of the licen[sc]e at"),
    ("ApacheUrl", r"https? www apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?"),
    ("BSDSource", r"(?:[0-9a-z] )?redistributions? of source code must retain the .*"),
    ("BSDBinary", r"(?:[0-9a-z] )?redistributions? in binary form must reproduce the .*"),
    ("BSDNoEndorse", r"(?:[0-9a-z] )?(?:neither the name|the names? of) .*endorse or promote products derived from this software.*"),
    ("BSDAsIs", r"this software is provided by .*as is and any express(?:ed)? or implied warranties.*"),
    ("NoEvent", r"in no event shall .*liable for any .*"),
    ("GPL3Later", _TERMS + r"general public licen[sc]e" + _FSF + r" (?:either )?version 3(?: 0)?" + _LATER),
    ("GPL3Terms", _TERMS + r"general public licen[sc]e" + _FSF + r" version 3(?: 0)?(?: of the licen[sc]e)?(?: only)?"),
    ("GPL2Later", _TERMS + r"general public licen[sc]e" + _FSF + r" (?:either )?version 2(?: 0)?" + _LATER),
    ("GPL2Terms", _TERMS + r"general public licen[sc]e" + _FSF + r" version 2(?: 0)?(?: of the licen[sc]e)?(?: only)?"),
    ("GPLTerms", _TERMS + r"general public licen[sc]e" + _FSF),
    ("LGPLTerms", _TERMS + r"(?:lesser|library) general public licen[sc]e.*"),
    ("AGPLTerms", _TERMS + r"affero general public licen[sc]e.*"),
    ("Version3Later", r"(?:either )?version 3(?: 0)?" + _LATER),
    ("Version3", r"(?:either )?version 3(?: 0)? of the licen[sc]e(?: only)?"),
    ("Version2Later", r"(?:either )?version 2(?: 0)?" + _LATER),
    ("Version2", r"(?:either )?version 2(?: 0)? of the licen[sc]e(?: only)?"),
    ("LGPLVersion", r"(?:either )?version 2 1(?: of the licen[sc]e)?(?:" + _LATER + ")?"),
    ("GNUDetails", r"see the gnu (?:lesser |library |affero )?general public licen[sc]e for more details"),
    ("GNUCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e .*"),
    ("GNUSee", r"if not see https? www gnu org licen[sc]es"),
    ("GNUWrite", r"if not write to the free software foundation.*"),
    ("GNUPart", r"this file is part of .*"),
    ("MITUnder", r".* (?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?(?:mit|expat) licen[sc]e"),
    ("ISCGrant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCAsIs", r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software.*"),
    ("MPLForm", r"this source code form is subject to the terms of the mozilla public licen[sc]e(?: v(?:ersion)?)?(?: 2 0)?"),
    ("EPL2", r".*(?:available under|subject to) the terms of the eclipse public licen[sc]e (?:v |version |v)?2 0.*"),
    ("EPL1", r".*(?:available under|subject to) the terms of the eclipse public licen[sc]e (?:v |version |v)?1 0.*"),
    ("EPL2Title", r"eclipse public licen[sc]e (?:v |version |v)?2 0"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseLaws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("UnlicenseAct", r"we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("CC0", r"to the extent possible under law .* waived all copyright and related or neighbou?ring rights to .*"),
    ("CC0", r"(?:.* )?(?:licensed|available|released|published|distributed) under (?:the |a )?(?:cc0|creative commons (?:cc0|zero))(?: licen[sc]e)?(?: v)?(?: ?1 0)?(?: universal)?(?: public domain dedication)?(?: licen[sc]e)?"),
    *((f"CC{kind.replace('-', '')}Text", _CC.format(short, long, short)) for kind, short, long in CC_KINDS),
    ("CCView", r"to view a copy of this licen[sc]e visit .*"),
)
#: Rules on them, after RULES.
TEXT_RULES = (
    ("AGPL", ("AGPLTerms",)),
    ("LGPL", ("LGPLTerms",)),
    ("GPL-3.0-or-later", ("GPL3Later",)),
    ("GPL-3.0-or-later", ("GPLTerms", "Version3Later")),
    ("GPL-3.0", ("GPL3Terms",)),
    ("GPL-3.0", ("GPLTerms", "Version3")),
    ("GPL-2.0-or-later", ("GPL2Later",)),
    ("GPL-2.0-or-later", ("GPLTerms", "Version2Later")),
    ("GPL-2.0", ("GPL2Terms",)),
    ("GPL-2.0", ("GPLTerms", "Version2")),
    ("ISC", ("ISCGrant", "ISCAsIs")),
    ("ISC", ("ISCGrant",)),
    ("MPL-2.0", ("MPLForm",)),
    ("EPL-2.0", ("EPL2",)),
    ("EPL-2.0", ("EPL2Title",)),
    ("EPL-1.0", ("EPL1",)),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0",)),
    *((f"CC-{kind}", (f"CC{kind.replace('-', '')}Text",)) for kind, _, _ in CC_KINDS),
)
#: Identifiers that a rule passes over between its own.
FILLERS = ("ApacheUrl", "BSDSource", "BSDBinary", "BSDAsIs", "NoEvent", "GNUDetails", "GNUCopy", "GNUSee", "GNUWrite", "UnlicenseLaws", "UnlicenseAct")
#: What a sentence must hold to be looked at.
SPEAKS = r"(?i)licen[sc]e|copyright|\(c\)|all rights|permission|redistribut|provided .{0,4}as is|public domain|later version|endorse"
#: The same over line ends.
_SPEAKS_LINES = SPEAKS.replace("provided .{0,4}as is", r"provided[\s\S]{0,6}as\s+is").replace("all rights", r"all\s+rights").replace("public domain", r"public\s+domain").replace("later version", r"later\s+version")
#: A line that ends where it does: a copyright notice or a licence's title.
_TITLE = r"(?im)^([ \t#*/;%-]*(?:(?:copyright|\(c\)|©)\s[^\n]*|all rights reserved\.?|(?:the )?[\w .-]{0,40}licen[sc]e(?: \([\w .-]+\))?)[ \t]*)\n"
#: How sentences of licence texts begin, which may follow a name or an address without a full stop.
OPENINGS = ("Redistribution and use in source", "Permission is hereby granted", "Permission to use, copy", "THE SOFTWARE IS PROVIDED", "This program is free software", "This Source Code Form", "Unless required by applicable law", "To the extent possible under law")
#: Ends of sentences and of what leads up to a list, places before openings, empty lines (comment marks aside), and list marks.
_ENDS = r"(?<=[.!?;])\s+|(?<=conditions:)\s+|(?<=are met:)\s+|\s+(?=(?:" + "|".join(OPENINGS) + r"))|\s*\n(?:[ \t#*/;%-]*\n)+|\n(?=\s*(?:[-•]|\(?[0-9a-zA-Z]{1,2}[.)])\s)"
UNKNOWN = "Unknown"


def normal(sentence: str) -> str:
    """SQL: a sentence in lower case with single spaces for all but letters and digits."""
    return rf"trim(regexp_replace(lower({sentence}), r'[^\p{{L}}0-9]+', ' '))"


def scanned(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, sentences, licences): kept columns, identifiers in order, and licences in the order of their rules.

    A sentence may run over lines: it is looked up joined, from its first line
    on or from the first that speaks. Where that is unknown, or several of its
    lines are known by themselves, its lines are sentences of their own.
    A sentence that speaks of licensing but is not known is Unknown and parts
    what stands on either side. Null and empty texts have neither; rows are
    scanned one by one, whole; an empty table gives no rows.
    """
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    x = x.withColumn("t", F.expr(rf"if(t RLIKE r'{_SPEAKS_LINES}', regexp_replace(t, r'{_TITLE}', '$1\n\n'), '')"))
    known = lambda s: "CASE " + " ".join(f"WHEN {s} RLIKE r'^(?:{p})$' THEN '{i}'" for i, p in (*SENTENCES, *TEXT_SENTENCES)) + f" ELSE '{UNKNOWN}' END"
    named = lambda texts: f"transform(transform({texts}, s -> {normal('s')}), s -> {known('s')})"
    lines = rf"transform(filter(split(t, r'{_ENDS}'), p -> p RLIKE r'{_SPEAKS_LINES}'), p -> split(p, r'\s*\n\s*'))"
    tail = f"slice(q, greatest(1, array_position(transform(q, l -> l RLIKE r'{SPEAKS}'), true)), size(q))"
    x = x.selectExpr("row", f"transform({lines}, q -> named_struct('joined', if(size(q) > 1, array(array_join(q, ' '), array_join({tail}, ' ')), CAST(array() AS ARRAY<STRING>)), 'lines', filter(q, l -> l RLIKE r'{SPEAKS}'))) AS said")
    x = x.selectExpr("row", f"transform(said, p -> named_struct('joined', array_remove({named('p.joined')}, '{UNKNOWN}'), 'lines', {named('p.lines')})) AS said")
    whole = f"size(p.joined) > 0 AND size(array_remove(array_distinct(p.lines), '{UNKNOWN}')) < 2"
    x = x.selectExpr("row", f"flatten(transform(said, p -> if({whole}, slice(p.joined, 1, 1), p.lines))) AS sentences")
    between = f";(?:(?:{'|'.join(FILLERS)});)*"
    rules = ", ".join(f"struct('{name}' AS name, r'(?<=;){between.join(seq)};' AS seq)" for name, seq in (*RULES, *TEXT_RULES))
    step = "(acc, r) -> if(acc.left RLIKE r.seq, named_struct('left', regexp_replace(acc.left, r.seq, ';'), 'got', concat(acc.got, array(r.name))), acc)"
    walk = f"aggregate(array({rules}), named_struct('left', concat(';', array_join(sentences, ';'), ';'), 'got', CAST(array() AS ARRAY<STRING>)), {step}, acc -> array_distinct(acc.got))"
    return x.selectExpr("row", "sentences", f"if(size(sentences) = 0, CAST(array() AS ARRAY<STRING>), {walk}) AS licences")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, sentences and licences (comma-joined) for every document."""
    return scanned(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]).selectExpr("row.doc_id AS doc_id", "array_join(sentences, ',') AS sentences", "array_join(licences, ',') AS licences")


def _oracle() -> str:
    known = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{i}'" for i, p in SENTENCES) + f" ELSE '{UNKNOWN}' END"
    steps, before = [], "seen"
    for k, (name, seq) in enumerate(RULES):
        pattern = f";{';'.join(seq)};"
        steps.append(
            f"r{k} AS (SELECT doc_id, sentences, CASE WHEN regexp_matches(rest, '{pattern}') THEN regexp_replace(rest, '{pattern}', ';;', 'g') ELSE rest END AS rest,"
            f" CASE WHEN regexp_matches(rest, '{pattern}') AND NOT list_contains(got, '{name}') THEN list_append(got, '{name}') ELSE got END AS got FROM {before})"
        )
        before = f"r{k}"
    return f"""
WITH parts AS (
    SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', chr(10), 'g'), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s,
           generate_subscripts(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', chr(10), 'g'), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS k FROM documents),
said AS (SELECT doc_id, k, trim(regexp_replace(lower(s), '[^\\p{{L}}0-9]+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(s, '{SPEAKS}')),
named AS (SELECT doc_id, k, {known} AS i FROM said),
seen AS (
    SELECT d.doc_id, coalesce(string_agg(i, ',' ORDER BY k), '') AS sentences, coalesce(';;' || string_agg(i, ';;' ORDER BY k) || ';;', '') AS rest, CAST([] AS VARCHAR[]) AS got
    FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id),
{", ".join(steps).replace("r'(?<=;)", "'")}
SELECT doc_id, sentences, array_to_string(got, ',') AS licences FROM {before}
"""


#: The oracle doubles the separators, since its patterns cannot look back.
ORACLE_SQL = re.sub(r"';((?:\w+;)+)'", lambda m: "';" + m[1].replace(";", ";;")[:-1] + "'", _oracle())
