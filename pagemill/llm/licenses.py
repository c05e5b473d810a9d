"""Licence scans: normalised sentences become identifiers, sequences of identifiers are matched with ordered rules.

Only DataFrame and SQL functions: comment marks at line starts go, the text is cut into sentences over its line ends,
each sentence is normalised (lower case, every run of characters other than a-z and 0-9 a space) and looked up in a
fixed table of known sentences. Where a sentence is not known as a whole, its lines are looked up one by one. The
identifiers in the order of the text are matched with the rules: a rule holds if its identifiers occur in this order,
others between them allowed, or for ``VERSIONS`` none between them. Nothing is shuffled.

The SQL cuts at every line end and knows ``SENTENCES`` and ``RULES`` only, so it agrees where no standard text is wrapped.

Defined cases: a null or empty text has no sentences and no licence. A known sentence that is repeated is listed again.
Rows of one doc_id are judged one by one; a null doc_id stays null. An empty table gives an empty result. Other columns
are ignored by the query and passed through by ``scan``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import documents, free_name

#: Known sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-title": "gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "this work is dedicated to the public domain under cc0 1 0",
    "all-rights": "all rights reserved",
}

#: A licence and the identifiers that name it, in order.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0-header", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL", ["gpl-redistribute", "gpl-warranty"]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
]



def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _standard() -> dict[str, list[str]]:
    """Sentences of the standard texts as they are published, normalised, with the identifiers each stands for."""
    apache_at = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    apache_as_is = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    out = {
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": ["apache-title"],
        'Licensed under the Apache License, Version 2.0 (the "License")': ["apache-notice"],
        'Licensed under the Apache License, Version 2.0 (the "License"), you may not use this file except in compliance with the License': ["apache-notice", "apache-compliance"],
        apache_at + apache_as_is: ["apache-copy"],
        apache_at.replace("http:", "https:"): ["apache-copy"],
        apache_at.replace("http:", "https:") + apache_as_is: ["apache-copy"],
        "MIT License": ["mit-title"],
        "The MIT License (MIT)": ["mit-title"],
        "MIT License (MIT)": ["mit-title"],
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": ["mit-keep"],
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software": ["mit-keep"],
        "ISC License": ["isc-title"],
        "The ISC License": ["isc-title"],
        "BSD 2-Clause License": ["bsd2-title"],
        "BSD 3-Clause License": ["bsd3-title"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v": ["mpl-terms"],
        "Mozilla Public License Version 2.0": ["mpl-title"],
        "Mozilla Public License, version 2.0": ["mpl-title"],
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["gpl3-title"],
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": ["gpl2-title"],
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["lgpl3-title"],
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": ["lgpl21-title"],
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": ["agpl3-title"],
    }
    for software in ('the "Software"', "the Software"):
        out[f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files ({software}), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"] = ["mit-grant"]
    for way in ("and/or", "and"):
        out[f"Permission to use, copy, modify, {way} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"] = ["isc-grant"]
    for who in ("the copyright holder", "the copyright holders", "the copyright owner", "the <organization>", "the author", "the authors", "the University"):
        for names in ("the names of its contributors", "the names of the contributors", "the names of their contributors", "the names of contributors"):
            out[f"Neither the name of {who} nor {names} may be used to endorse or promote products derived from this software without specific prior written permission"] = ["bsd-endorse"]
    for kind, key in (("General", "gpl"), ("Lesser General", "lgpl"), ("Library General", "lgpl"), ("Affero General", "agpl")):
        terms = f"you can redistribute it and/or modify it under the terms of the GNU {kind} Public License"
        for thing in ("This program is free software ", "This library is free software ", ""):
            out[f"{thing}{terms} as published by the Free Software Foundation"] = [f"{key}-redistribute"]
            for number in ("2", "2.1", "3"):
                version = f"version-{number}"
                out[f"{thing}{terms} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version"] = [f"{key}-redistribute", version]
                out[f"{thing}{terms} as published by the Free Software Foundation, version {number} of the License"] = [f"{key}-redistribute", version]
                out[f"{thing}{terms} as published by the Free Software Foundation, version {number}"] = [f"{key}-redistribute", version]
                out[f"{thing}{terms} version {number} as published by the Free Software Foundation"] = [f"{key}-redistribute", version]
    for number in ("2", "2.1", "3"):
        out[f"either version {number} of the License, or (at your option) any later version"] = [f"version-{number}"]
        out[f"version {number} of the License"] = [f"version-{number}"]
    return {_plain(k): v for k, v in out.items()}


#: Every known sentence, normalised, and its identifiers.
KNOWN = _standard() | {v: [k] for k, v in SENTENCES.items()}

#: Further rules, for the standard texts.
STANDARD_RULES = [
    ("Apache-2.0", ["apache-title"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("ISC", ["isc-title"]),
    ("ISC", ["isc-grant"]),
    ("BSD-2-Clause", ["bsd2-title"]),
    ("BSD-3-Clause", ["bsd3-title"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MPL-2.0", ["mpl-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
]

#: A licence and the identifiers that name it where one directly follows the other.
VERSIONS = [
    ("GPL-2.0", ["gpl-redistribute", "version-2"]),
    ("GPL-3.0", ["gpl-redistribute", "version-3"]),
    ("LGPL-2.0", ["lgpl-redistribute", "version-2"]),
    ("LGPL-2.1", ["lgpl-redistribute", "version-2.1"]),
    ("LGPL-3.0", ["lgpl-redistribute", "version-3"]),
    ("AGPL-3.0", ["agpl-redistribute", "version-3"]),
]

#: Marks of comments where a line starts, and lines that name the owner, which end a sentence.
COMMENT_MARK = r"(?m)^[ \t]*(?:<!--+|-->|//+|/?\*+/?|#+|;+|--+|%+|!+|(?:REM|rem|dnl)\b)[ \t]*"
OWNER_LINE = r"(?im)^([ \t]*copyright[ \t]+(?:\(c\)|\u00a9|[0-9])[^\n]*)$"

#: Sentences end at marks that blanks or line ends follow, before the first number of a list, and at blank lines (an
#: address below one belongs to the sentence above).
SENTENCE_END = r"[.!?;]+[ \t\r\n]+|:[ \t\r\n]+\(?[1aAiI][.)][ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*+(?!https?://)"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _sentence_ids(text: Column) -> Column:
    known = F.create_map(*[x for k, v in KNOWN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    shortest = min(map(len, KNOWN))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT_MARK, ""), OWNER_LINE, "$1\n")
    # normalising never lengthens a sentence, and no known one has fewer letters and digits than the shortest
    parts = F.filter(F.split(bare, SENTENCE_END), lambda s: F.length(s) >= shortest)
    both = F.transform(parts, lambda s: F.struct(s.alias("raw"), _normal(s).alias("plain")))
    both = F.filter(both, lambda s: s["plain"].isin(*KNOWN) | F.contains(s["raw"], F.lit("\n")))
    lines = F.transform(both, lambda s: F.when(s["plain"].isin(*KNOWN), F.array(s["plain"])).otherwise(
        F.transform(F.filter(F.split(s["raw"], "\n+"), lambda x: F.length(x) >= shortest), _normal)))
    found = F.filter(F.flatten(lines), lambda s: s.isin(*KNOWN))
    return F.flatten(F.transform(found, lambda s: F.element_at(known, s)))


def _holds(ids: Column, rule: list[str]) -> Column:
    """The rule's identifiers occur in this order: each is looked for behind the one before."""
    rest = ids
    for part in rule[:-1]:
        at = F.array_position(rest, part)
        rest = F.when(at > 0, F.slice(rest, (at + 1).cast("int"), F.size(rest))).otherwise(F.array().cast("array<string>"))
    return F.array_contains(rest, rule[-1])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``sentence_ids`` (array, in the order of the text) and ``licenses`` (array, sorted)."""
    own = docs.columns
    ids, names = free_name("sentence_ids", own), free_name("licenses", own)
    found = docs.select(*own, F.inline(F.array(F.struct(_sentence_ids(F.col(text)).alias(ids)))))  # computed once a row
    joined = F.concat(F.lit(","), F.array_join(F.col(ids), ","), F.lit(","))
    hits = F.array(*[F.when(_holds(F.col(ids), rule), F.lit(name)) for name, rule in RULES + STANDARD_RULES],
                   *[F.when(F.contains(joined, F.lit(f",{','.join(rule)},")), F.lit(name)) for name, rule in VERSIONS])
    return found.withColumn(names, F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(F.array_compact(hits)))).otherwise(F.array().cast("array<string>")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    known = " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in SENTENCES.items())
    rules = " UNION ALL ".join(f"SELECT '{name}' AS license, '%,{',%,'.join(rule)},%' AS pattern" for name, rule in RULES)
    return f"""
WITH parts AS (
  SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n+|[.!?;]+[ \\t\\r]+') AS s FROM documents)),
named AS (
  SELECT doc_id, place, CASE trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) {known} END AS id FROM parts),
ids AS (SELECT doc_id, count(id) AS n_sentences, coalesce(string_agg(id, ',' ORDER BY place), '') AS sentence_ids,
               ',' || coalesce(string_agg(id, ',,' ORDER BY place), '') || ',' AS chain FROM named GROUP BY doc_id),
rules AS ({rules})
SELECT doc_id, n_sentences::INTEGER AS n_sentences, sentence_ids,
       coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM rules WHERE chain LIKE pattern), '') AS licenses
FROM ids"""


ORACLE = _oracle()
