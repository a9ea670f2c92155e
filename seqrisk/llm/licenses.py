"""License scans by sentence rules; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.registry import query, table

#: Sentences of licences and notices, as they are written, with their identifiers. Fixed values.
SENTENCES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl3-name",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc4-name",
    "Released under the MIT License.": "mit-name",
    "Licensed under the Apache License, Version 2.0.": "apache2-name",
    "Licensed under the MIT License.": "mit-name",
    "This project is licensed under the MIT License.": "mit-name",
    "This work is licensed under the GNU General Public License, version 2.": "gpl2-name",
    "Licensed under CC BY 4.0.": "cc-by4-name",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa4-name",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by4-name",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc4-name",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa4-name",
    "Released under the BSD License.": "bsd-name",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2-name",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software.": "mit-notice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit-as-is",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
    " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE.": "mit-liability",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.": "bsd-names",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache2-head",
    "you may not use this file except in compliance with the License.": "apache2-comply",
    "You may obtain a copy of the License at": "apache2-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
    " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache2-as-is",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-later",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl2-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "gpl-hope",
    "This is free and unencumbered software released into the public domain.": "unlicense-head",
}
#: Licences with patterns over sentence identifiers, tried in this order; what a rule matches is used up.
RULES = (
    ("MIT", "<mit-grant>(<mit-notice>)?(<mit-as-is>)?(<mit-liability>)?"),
    ("ISC", "<isc-grant>"),
    ("BSD-3-Clause", "(<bsd-grant>)?<bsd-source><bsd-binary><bsd-names>"),
    ("BSD-2-Clause", "(<bsd-grant>)?<bsd-source><bsd-binary>"),
    ("BSD", "<bsd-name>|<bsd-grant>"),
    ("Apache-2.0", "<apache2-head>(<apache2-comply>)?(<apache2-copy>)?(<apache2-as-is>)?"),
    ("Apache-2.0", "<apache2-name>"),
    ("GPL-3.0-or-later", "<gpl3-later>(<gpl-hope>)?"),
    ("GPL-2.0-or-later", "<gpl2-later>(<gpl-hope>)?"),
    ("GPL-3.0", "<gpl3-name>"),
    ("GPL-2.0", "<gpl2-name>"),
    ("MIT", "<mit-name>"),
    ("CC-BY-NC-4.0", "<cc-by-nc4-name>"),
    ("CC-BY-SA-4.0", "<cc-by-sa4-name>"),
    ("CC-BY-4.0", "<cc-by4-name>"),
    ("MPL-2.0", "<mpl2-name>"),
    ("Unlicense", "<unlicense-head>"),
)
#: Every known sentence has one of these words or beginnings, so other texts need no look.
CUES = ("licen", "permission", "redistribut", "provided", "warrant", "liable", "unencumbered", "released", "contributors")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at these signs before white space, and at empty lines.
_END = r"[.!?;:]+([ \t\r\f]*\n|[ \t\n\r\f]+|$)|\n[ \t\r\f]*\n"


def normal_sentences() -> dict[str, str]:
    """Identifiers by normalised sentence; of entries that the end signs cut, the last part of some length counts."""
    out: dict[str, str] = {}
    for sentence, identifier in SENTENCES.items():
        parts = [re.sub(r"[^a-z0-9]+", " ", p.lower()).strip() for p in re.split(r"[.!?;:]+(?:\s+|$)", sentence)]
        out[[p for p in parts if p.count(" ") >= 3][-1]] = identifier
    return out


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence may run over several lines; one that is not known as a whole is looked up line by line.
    """
    names = F.create_map(*[F.lit(x) for pair in normal_sentences().items() for x in pair])
    low = F.translate(text, _UPPER, _LOWER)

    def identifier(part: Column) -> Column:
        return F.try_element_at(names, F.trim(F.regexp_replace(part, "[^a-z0-9]+", " ")))

    def parts(sentence: Column) -> Column:
        whole = identifier(sentence)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.split(sentence, "\n", -1), identifier))

    found = F.filter(F.flatten(F.transform(F.split(low, _END, -1), parts)), lambda i: i.isNotNull())
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains(low, F.lit(word))
    return F.when(F.coalesce(cue, F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def licenses_of(identifiers: Column) -> Column:
    """Licences whose rules match the identifier sequence, in the order of the rules, each once."""
    rest = F.concat(F.lit(""), F.array_join(F.transform(identifiers, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    found = []
    for name, pattern in RULES:
        found.append(F.when(F.rlike(rest, F.lit(pattern)), F.lit(name)))
        rest = F.regexp_replace(rest, pattern, "|")
    return F.array_distinct(F.array_compact(F.array(*found)))


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` (arrays) for each row of ``docs`` (doc_id, text).

    One pass without a shuffle: sentences are cut, normalised (letters and digits of ASCII, lower case) and looked up in
    a fixed table, and the identifier sequence is matched against the rules. Texts that are NULL, empty or
    without known sentences have empty arrays; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    seen = docs.select("doc_id", known_sentences(F.col("text")).alias("sentence_ids"))
    some = F.size("sentence_ids") > 0
    none = F.array().cast("array<string>")
    return seen.withColumn("licenses", F.when(some, licenses_of(F.col("sentence_ids"))).otherwise(none))


def _sql() -> str:
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in normal_sentences().items()) + "}"
    cues = " OR ".join(f"contains(low, '{c}')" for c in CUES)
    part = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
    steps = []
    for n, (name, pattern) in enumerate(RULES):
        steps.append(f"SELECT *, regexp_replace(r{n}, '{pattern}', '|', 'g') AS r{n + 1}, CASE WHEN regexp_matches(r{n}, '{pattern}') THEN '{name}' END AS f{n} FROM s{n}")
    ctes = ",\n".join(f"s{n + 1} AS ({step})" for n, step in enumerate(steps))
    firsts = ", ".join(f"f{n}" for n in range(len(RULES)))
    return rf"""
WITH d AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS low, {names} AS names FROM documents),
p AS (
  SELECT doc_id, names, unnest(CASE WHEN {cues} THEN regexp_split_to_array(low, '{_END.replace('([', '(?:[')}') ELSE [] END) AS sentence,
         generate_subscripts(CASE WHEN {cues} THEN regexp_split_to_array(low, '{_END.replace('([', '(?:[')}') ELSE [] END, 1) AS pos
  FROM d),
q AS (
  SELECT doc_id, pos, names, CASE WHEN names[{part.format('sentence')}] IS NOT NULL THEN [sentence] ELSE string_split(sentence, chr(10)) END AS lines
  FROM p),
u AS (SELECT doc_id, pos, names, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM q),
k AS (SELECT doc_id, pos, nth, names[{part.format('line')}] AS id FROM u),
g AS (
  SELECT doc_id, string_agg(id, ' ' ORDER BY pos, nth) AS ids, string_agg('<' || id || '>', '' ORDER BY pos, nth) AS r0
  FROM k WHERE id IS NOT NULL GROUP BY doc_id),
s0 AS (SELECT documents.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(r0, '') AS r0 FROM documents LEFT JOIN g USING (doc_id)),
{ctes}
SELECT doc_id, sentence_ids,
       array_to_string(list_filter([{firsts}], lambda x, i: x IS NOT NULL AND list_position([{firsts}], x) = i), ' ') AS licenses
FROM s{len(RULES)}
"""


@query("op5_license_sentences", _sql())
def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))
