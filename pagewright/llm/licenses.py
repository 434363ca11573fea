"""Operator 5, licences by sentence rules.

Lines are joined to paragraphs, since licence texts are wrapped. Sentences are normalised
and looked up among known licence sentences; what remains is the sequence of their
identifiers. Ordered rules, the longest first, consume identifier sequences and name the
licence. Everything is row-local and runs inside the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AS_IS = "without warranties or conditions of any kind either express or implied"
GPL = "you can redistribute it and or modify it under the terms of the gnu {}general public license"
FSF = " as published by the free software foundation"


def _short(names: tuple[str, ...]) -> tuple[str, ...]:
    """The one-line notices that name a licence, without their head."""
    return tuple(f"under {name}" for name in names)


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"spdx license identifier {normal(n)}" for n in names)


#: How a one-line notice begins; it becomes "under".
HEAD = "^(this (work|project|software|program|package|library|file|code|document) is )?(licensed|released|distributed|available|published) under (an? |the )?(terms of the )?"


def normal(sentence: str) -> str:
    """What ``normalise`` makes of a sentence, in Python."""
    words = re.sub(r"[^a-z0-9.]+", " ", sentence.lower())
    return re.sub(HEAD, "under ", re.sub(r"\.+( |$)", r"\1", words).strip(" "))


#: Identifier -> normalised sentences: lower case, other signs than letters, digits and inner points as blanks.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-short": _short(("mit license",)) + _spdx("MIT"),
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-title": ("isc license", "the isc license"),
    "isc-short": _short(("isc license",)) + _spdx("ISC"),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd3-title": ("bsd 3 clause license", "the bsd 3 clause license"),
    "bsd2-title": ("bsd 2 clause license", "the bsd 2 clause license"),
    "bsd-redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-no-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-disclaimer": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd3-short": _short(("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")) + _spdx("BSD-3-Clause"),
    "bsd2-short": _short(("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")) + _spdx("BSD-2-Clause"),
    "apache2-licensed": _short(("apache license version 2.0", "apache license version 2.0 the license", "apache license 2.0")) + _spdx("Apache-2.0"),
    "apache2-compliance": ("you may not use this file except in compliance with the license", "you may not use this work except in compliance with the license", "you may not use these files except in compliance with the license"),
    "apache2-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"),
    "apache2-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", f"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis {AS_IS}"),
    "apache2-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl-terms": (GPL.format("") + FSF,),
    "lgpl-terms": (GPL.format("lesser ") + FSF, GPL.format("library ") + FSF),
    "agpl-terms": (GPL.format("affero ") + FSF,),
    "version2-later": ("either version 2 of the license or at your option any later version",),
    "version21-later": ("either version 2.1 of the license or at your option any later version",),
    "version3-later": ("either version 3 of the license or at your option any later version",),
    "gpl3-or-later": (GPL.format("") + FSF + " either version 3 of the license or at your option any later version", *_spdx("GPL-3.0-or-later", "GPL-3.0+")),
    "gpl2-or-later": (GPL.format("") + FSF + " either version 2 of the license or at your option any later version", *_spdx("GPL-2.0-or-later", "GPL-2.0+")),
    "lgpl-or-later": (
        GPL.format("lesser ") + FSF + " either version 3 of the license or at your option any later version",
        GPL.format("lesser ") + FSF + " either version 2.1 of the license or at your option any later version",
    ),
    "agpl3-or-later": (GPL.format("affero ") + FSF + " either version 3 of the license or at your option any later version", *_spdx("AGPL-3.0-or-later")),
    "gpl3-licensed": _short(("gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3")) + (GPL.format("") + " version 3" + FSF, *_spdx("GPL-3.0-only", "GPL-3.0")),
    "gpl2-licensed": _short(("gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2")) + (GPL.format("") + " version 2" + FSF, *_spdx("GPL-2.0-only", "GPL-2.0")),
    "lgpl-licensed": _short(("gnu lesser general public license version 2.1", "gnu lesser general public license version 3", "gnu lesser general public license")) + _spdx("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl3-licensed": _short(("gnu affero general public license version 3",)) + _spdx("AGPL-3.0-only"),
    "gpl-see": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"),
    "or-later": ("or at your option any later version",),
    "mpl2-terms": ("this source code form is subject to the terms of the mozilla public license v.2.0", *_short(("mozilla public license version 2.0", "mozilla public license 2.0")), *_spdx("MPL-2.0")),
    "mpl2-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    "cc-by-nc4": _short(("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license")) + _spdx("CC-BY-NC-4.0"),
    "cc-by-sa4": _short(("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license")) + _spdx("CC-BY-SA-4.0"),
    "cc-by4": _short(("cc by 4.0", "creative commons attribution 4.0 international license")) + _spdx("CC-BY-4.0"),
    "cc0": _short(("cc0 1.0",)) + ("this work is dedicated to the public domain under cc0 1.0", *_spdx("CC0-1.0")),
    "unlicense": ("this is free and unencumbered software released into the public domain", *_spdx("Unlicense")),
    "unlicense-anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "permission-free": ("permission is hereby granted free of charge",),
    "reserved": ("all rights reserved",),
    "proprietary": ("confidential and proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
}
COPYRIGHT = "copyright"
#: Sentences with a free part, by pattern. A copyright notice names a year or carries the sign (c); prose about
#: copyright does neither.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("^copyright (c |[0-9]{4})", COPYRIGHT),
    ("^neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$", "bsd-no-endorse"),
    ("^this software is provided by .* as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$", "bsd-disclaimer"),
)

#: Rules in the order they are tried; each consumes its identifiers where they follow one another.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache-header", "Apache-2.0", ("apache2-licensed", "apache2-compliance", "apache2-copy", "apache2-basis", "apache2-see")),
    ("apache-notice", "Apache-2.0", ("apache2-licensed", "apache2-compliance", "apache2-basis")),
    ("bsd4-text", "BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-no-endorse")),
    ("bsd3-full", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-no-endorse")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("bsd2-full", "BSD-2-Clause", ("bsd-redistribute", "bsd-source")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice")),
    ("gpl3-notice", "GPL-3.0-or-later", ("gpl-terms", "version3-later")),
    ("gpl2-notice", "GPL-2.0-or-later", ("gpl-terms", "version2-later")),
    ("lgpl3-notice", "LGPL", ("lgpl-terms", "version3-later")),
    ("lgpl21-notice", "LGPL", ("lgpl-terms", "version21-later")),
    ("lgpl2-notice", "LGPL", ("lgpl-terms", "version2-later")),
    ("agpl3-notice", "AGPL-3.0", ("agpl-terms", "version3-later")),
    ("gpl3-later", "GPL-3.0-or-later", ("gpl3-licensed", "or-later")),
    ("gpl2-later", "GPL-2.0-or-later", ("gpl2-licensed", "or-later")),
    ("mpl2-header", "MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("unlicense-text", "Unlicense", ("unlicense", "unlicense-anyone")),
    ("apache-short", "Apache-2.0", ("apache2-licensed",)),
    ("apache-copy", "Apache-2.0", ("apache2-compliance", "apache2-copy")),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-short", "MIT", ("mit-short",)),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-title", "MIT", ("mit-title",)),
    ("isc", "ISC", ("isc-grant",)),
    ("isc-short", "ISC", ("isc-short",)),
    ("isc-title", "ISC", ("isc-title",)),
    ("bsd3-short", "BSD-3-Clause", ("bsd3-short",)),
    ("bsd2-short", "BSD-2-Clause", ("bsd2-short",)),
    ("bsd3-title", "BSD-3-Clause", ("bsd3-title",)),
    ("bsd2-title", "BSD-2-Clause", ("bsd2-title",)),
    ("bsd-part", "BSD", ("bsd-redistribute",)),
    ("gpl3-or-later", "GPL-3.0-or-later", ("gpl3-or-later",)),
    ("gpl2-or-later", "GPL-2.0-or-later", ("gpl2-or-later",)),
    ("lgpl-or-later", "LGPL", ("lgpl-or-later",)),
    ("agpl3-or-later", "AGPL-3.0", ("agpl3-or-later",)),
    ("gpl3", "GPL-3.0-only", ("gpl3-licensed",)),
    ("gpl2", "GPL-2.0-only", ("gpl2-licensed",)),
    ("lgpl", "LGPL", ("lgpl-licensed",)),
    ("agpl3", "AGPL-3.0", ("agpl3-licensed",)),
    ("mpl2", "MPL-2.0", ("mpl2-terms",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("cc-by", "CC-BY-4.0", ("cc-by4",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("proprietary", "Proprietary", ("proprietary",)),
)
#: Tried where no other rule matched: open licences too have a head with these sentences.
WEAK_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("proprietary-notice", "Proprietary", (COPYRIGHT, "reserved")),
    ("reserved", "Proprietary", ("reserved",)),
)
KNOWN = {s: k for k, many in SENTENCES.items() for s in many}
#: Every known sentence holds one of these, so a text with none of them needs no splitting.
ANCHORS = ("licen", "permission", "redistribut", "copyright", "all rights reserved", "copying", "any later version", "public domain", "required by applicable law", "proprietary", "cc0", "cc by", "cc-by", "creative commons", "gpl", "warrant", "acknowledgement", "of the mpl", "anyone is free")
assert all(any(a in s for a in ANCHORS) for s in KNOWN), [s for s in KNOWN if not any(a in s for a in ANCHORS)]
#: Paragraphs end at blank lines, before the marks of comments and of list items are taken off the lines.
MARKS = r"^[ \t]*([*#/;%>|-]+[ \t]*)*([(]?([0-9]{1,2}|[a-z])[.)][ \t]+)?"
ENDS = r"([.!?;:])[ \t]+"


def sentences(text: Column) -> Column:
    """Sentences of each paragraph, its lines joined, then those of single lines that the joined ones miss.

    A sentence ends after . ! ? ; : and a blank, or with its paragraph; a notice without
    a full stop ends with its line. ``v. 2.0`` is one word.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"\bv\. ([0-9])", "v.$1"), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, MARKS, "")))
    paragraphs = F.split(F.array_join(lines, "\n"), r"\n\n+")
    cut = lambda x: F.split(F.regexp_replace(x, ENDS, "$1\n"), r"\n")
    return F.transform(paragraphs, lambda p: F.struct(cut(F.translate(p, "\n", " ")).alias("joined"), F.concat(cut(p), F.split(p, r"\n")).alias("single")))


def normalise(sentence: Column) -> Column:
    words = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(words, r"\.+( |$)", "$1")), HEAD, "under ")


def lookup(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if unknown."""
    table = F.expr("map(" + ", ".join(f"'{x}'" for kv in sorted(KNOWN.items()) for x in kv) + ")")
    return F.coalesce(F.try_element_at(table, sentence), *[F.when(sentence.rlike(p), F.lit(name)) for p, name in PATTERNS])


def consumed(sequence: Column, rules: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Column:
    """'|a|b|' with each rule's identifiers replaced by its own name in angle brackets."""
    return reduce(lambda s, rule: F.replace(s, F.lit("|" + "||".join(rule[2]) + "|"), F.lit(f"<{rule[0]}>")), rules, sequence)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, rules) of each row that holds a licence sentence.

    ``sentence_ids`` keeps the text's order; ``licenses`` is sorted and distinct and may
    be empty, where known sentences complete no rule. Where two rules could take the same
    sentences, the one listed first does. Repeated rows are reported each, null ids too.
    Null and empty texts hold nothing, an empty table gives no row, and texts are read
    whole, however long. Only id and text are read, so other columns can't clash; the id
    keeps its type.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # One element long, so that the text is put in lower case once and not for every anchor.
    rows = rows.where(F.exists(F.array(F.lower("text")), lambda low: reduce(lambda a, b: a | b, [low.contains(a) for a in ANCHORS])))
    found = lambda many: F.filter(F.transform(many, lambda s: lookup(normalise(s))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.transform(sentences(F.col("text")), lambda p: F.struct(found(p["joined"]).alias("j"), found(p["single"]).alias("s"))).alias("p"))
    # Exploding one array keeps the filter from running all that comes before it a second time.
    rows = rows.select("doc_id", F.explode(F.array(F.flatten(F.transform("p", lambda p: F.concat(p["j"], F.array_except(p["s"], p["j"])))))).alias("ids")).where(F.size("ids") > 0)
    rows = rows.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), consumed(F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|")), RULES).alias("left"))
    rows = rows.withColumn("left", F.when(F.instr("left", "<") > 0, F.col("left")).otherwise(consumed(F.col("left"), WEAK_RULES)))
    hits = [(F.instr("left", f"<{name}>") > 0, name, spdx) for name, spdx, _ in RULES + WEAK_RULES]
    names = F.filter(F.array(*[F.when(h, F.lit(n)) for h, n, _ in hits]), lambda x: x.isNotNull())
    spdx = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(h, F.lit(x)) for h, _, x in hits]), lambda x: x.isNotNull())))
    return rows.select("doc_id", "sentence_ids", F.array_join(spdx, ",").alias("licenses"), F.array_join(names, ",").alias("rules"))


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    anchors = " OR ".join(f"contains(lower(text), {quote(a)})" for a in ANCHORS)
    table = ", ".join(f"({quote(s)}, {quote(k)})" for s, k in sorted(KNOWN.items()))
    patterns = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(k)}" for p, k in PATTERNS)

    def replaced(left: str, rules: tuple) -> str:
        for name, _, seq in rules:
            left = f"replace({left}, {quote('|' + '||'.join(seq) + '|')}, {quote(f'<{name}>')})"
        return left

    every = RULES + WEAK_RULES
    pick = lambda what: "[" + ", ".join(f"CASE WHEN contains(rest, {quote(f'<{n}>')}) THEN {quote(x)} END" for n, x in what) + "]"
    names, spdx = pick([(n, n) for n, _, _ in every]), pick([(n, x) for n, x, _ in every])
    ends = quote(ENDS)
    return f"""
WITH known(s, id) AS (VALUES {table}),
rows AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_split_to_array(regexp_replace(text, '\\bv\\. ([0-9])', 'v.\\1', 'g'), '\\r?\\n') AS ls
  FROM documents WHERE {anchors}),
paragraphs AS (
  SELECT r, doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (
    SELECT r, doc_id, regexp_split_to_array(array_to_string(list_transform(ls, lambda x: trim(regexp_replace(x, {quote(MARKS)}, ''))), chr(10)), '\\n\\n+') AS ps FROM rows)),
parts AS (
  SELECT r, doc_id, k, 1 AS single, string_split(regexp_replace(p, {ends}, '\\1' || chr(10), 'g'), chr(10)) || string_split(p, chr(10)) AS ss FROM paragraphs
  UNION ALL
  SELECT r, doc_id, k, 0, string_split(regexp_replace(replace(p, chr(10), ' '), {ends}, '\\1' || chr(10), 'g'), chr(10)) FROM paragraphs),
one AS (SELECT r, doc_id, k, single, unnest(ss) AS l, generate_subscripts(ss, 1) AS j FROM parts),
norm AS (SELECT r, doc_id, k, single, j, regexp_replace(trim(regexp_replace(regexp_replace(lower(l), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', '\\1', 'g')), '{HEAD}', 'under ') AS s FROM one),
found AS (SELECT r, doc_id, k, single, j, coalesce(known.id, CASE {patterns} END) AS id FROM norm LEFT JOIN known USING (s)),
kept AS (
  SELECT * FROM found f WHERE id IS NOT NULL AND single = 0
  UNION ALL
  SELECT r, doc_id, k, single, min(j) AS j, id FROM found f WHERE id IS NOT NULL AND single = 1
    AND NOT EXISTS (SELECT 1 FROM found g WHERE g.r = f.r AND g.k = f.k AND g.single = 0 AND g.id = f.id) GROUP BY r, doc_id, k, single, id),
seq AS (SELECT r, doc_id, list(id ORDER BY k, single, j) AS ids FROM kept GROUP BY r, doc_id),
strong AS (SELECT doc_id, ids, {replaced("'|' || array_to_string(ids, '||') || '|'", RULES)} AS part FROM seq),
done AS (SELECT doc_id, ids, CASE WHEN contains(part, '<') THEN part ELSE {replaced("part", WEAK_RULES)} END AS rest FROM strong)
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter({spdx}, lambda x: x IS NOT NULL))), ',') AS licenses,
       array_to_string(list_filter({names}, lambda x: x IS NOT NULL), ',') AS rules
FROM done"""
