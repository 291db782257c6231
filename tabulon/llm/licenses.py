"""Licence scans (operator 9).

Method: sentence-rule recognition. A text is cut into sentences; each is normalised and looked up among known licence
sentences; the sequence of identifiers found is matched against ordered licence rules. A rule is a sequence of
identifiers; where it matches, it uses them up, so a longer rule that stands earlier wins over its parts.

Sentences end at line ends and after . ! ? ; : before white space. Three readings are scanned: by lines as they stand, with
all line breaks as spaces, and by paragraphs (for wrapped texts): comment marks at line starts go, blank lines end sentences,
other line breaks are spaces. A rule that matches in any is found; the SQL has the first two readings only, so it finds
fewer licences in wrapped or commented texts. The paragraphs' reading alone knows sentences that the cutting splits
(``MORE_SENTENCES``). Unknown sentences between known ones don't break a sequence.

The dictionary is a small fixed table, so all is one narrow projection of built-in functions; texts without any of the
dictionary's key words aren't cut at all.

Defined results: null or empty text: no identifiers, no licences; repeated rows each give a row; an empty table gives no
rows; only doc_id and text are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.util import LOWER, UPPER, table, text_or_empty

#: identifier: normalised sentence. Fixed values, from the licences' public texts and notices; the "named" ones are usual
#: one-line notices.
SENTENCES = {
    "apache-named": "licensed under the apache license version 2.0",
    "apache-notice": "licensed under the apache license version 2.0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-named": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-terms-3": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-terms-2": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "cc-by-nc-named": "licensed under cc by-nc 4.0",
    "cc-by-named": "licensed under cc by 4.0",
    "cc-by-sa-named": "licensed under cc by-sa 4.0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "reserved": "all rights reserved",
    "lgpl-library": "this library is free software",
    "lgpl-terms-3": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms-3": "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-named": "licensed under the isc license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "boost-named": "distributed under the boost software license version 1.0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following",
    "epl-accompanies": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which accompanies this distribution and is available at https //www.eclipse.org/legal/epl-2.0/",
    "epl-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https //www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "cc0-law": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}
#: licence and its sequence of identifiers, in the order of matching.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-notice", "apache-may-not", "apache-as-is")),
    ("Apache-2.0", ("apache-notice", "apache-may-not")),
    ("GPL-3.0", ("gpl-free", "gpl-terms-3")),
    ("GPL-2.0", ("gpl-free", "gpl-terms-2")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-named",)),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0", ("gpl3-named",)),
    ("GPL-3.0", ("gpl-terms-3",)),
    ("GPL-2.0", ("gpl-terms-2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-named",)),
    ("CC-BY-4.0", ("cc-by-named",)),
    ("MPL-2.0", ("mpl-form",)),
    ("All-Rights-Reserved", ("reserved",)),
    ("LGPL-3.0", ("lgpl-terms-3",)),
    ("AGPL-3.0", ("gpl-free", "agpl-terms-3")),
    ("AGPL-3.0", ("agpl-terms-3",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-named",)),
    ("Unlicense", ("unlicense",)),
    ("Unlicense", ("unlicense-anyone",)),
    ("BSL-1.0", ("boost-named",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl-accompanies",)),
    ("EPL-2.0", ("epl-available",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0-law",)),
)
#: Identifiers of the SPDX list that a tag line may name. Fixed values.
SPDX = "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 ISC Unlicense BSL-1.0 Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
#: What the reading by paragraphs knows besides: the GPL notices that have a semicolon before the version.
MORE_SENTENCES = SENTENCES | {
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-either-3": "either version 3 of the license or at your option any later version",
    "gpl-either-2": "either version 2 of the license or at your option any later version",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-either-2.1": "either version 2.1 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "spdx": "spdx-license-identifier",
    **{f"spdx-{x}": x.lower() for x in SPDX},
}
MORE_RULES = (
    ("AGPL-3.0", ("agpl-terms", "gpl-either-3")),
    ("LGPL-2.1", ("lgpl-terms", "lgpl-either-2.1")),
    ("LGPL-3.0", ("lgpl-terms", "gpl-either-3")),
    *((x.removesuffix("-only").removesuffix("-or-later"), ("spdx", f"spdx-{x}")) for x in SPDX),
    *RULES,
    ("GPL-3.0", ("gpl-terms", "gpl-either-3")),
    ("GPL-2.0", ("gpl-terms", "gpl-either-2")),
)
#: Each known sentence holds one of these.
KEYWORDS = "licen[sc]e|unencumbered|anyone is free|public domain|permission|redistribut|copyright|rights reserved|warrant|free software"
END = r"([.!?;:])[ \t\r\x0b\x0c]+"


def normalised(sentence: Column) -> Column:
    """Lower-case letters, digits and . - + / between them; other characters are spaces; marks at word ends go."""
    s = F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^a-z0-9.+/-]+", " ")
    s = F.regexp_replace(s, r"[.]+( |$)", "$1")
    return F.trim(F.regexp_replace(s, r" +", " "))


def paragraphs(text: Column) -> Column:
    """A text with one paragraph a line, without comment marks; a copyright line and an SPDX tag are paragraphs of their own."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?m)^[ \t]*(?:/\*+|//+!?|--+|\*+/?|#+|;+)?[ \t]*|[ \t]*\*+/[ \t]*$", "")
    s = F.regexp_replace(s, r"(?im)^(copyright[ \t]+(?:\(c\)|\u00a9|[0-9]{4})[^\n]*)\n", "$1\n\n")
    s = F.regexp_replace(s, r"(?im)^(spdx-license-identifier:[^\n]*)(\n|$)", "\n$1\n\n")
    s = F.regexp_replace(F.regexp_replace(s, r"\n\s*\n\s*", "\x1e"), r"\s+", " ")
    return F.regexp_replace(F.translate(s, "\x1e", "\n"), r"(?i)\bv\. (?=[0-9])", "v ")


def identifiers(text: Column, dictionary: dict[str, str] = SENTENCES) -> Column:
    """The known sentences of a text, in order."""
    sentences = F.split(F.regexp_replace(text, END, "$1\n"), "\n")
    known = F.create_map(*(F.lit(x) for pair in dictionary.items() for x in reversed(pair)))
    return F.filter(F.transform(sentences, lambda s: F.try_element_at(known, normalised(s))), lambda x: x.isNotNull())


def licences(ids: Column, rules: tuple = RULES) -> Column:
    """Licences whose rules match, in rule order. ids: identifiers joined by and between single spaces."""
    state, found = ids, []
    for name, sequence in rules:
        wanted = f" {' '.join(sequence)} "
        found.append(F.when(F.instr(state, wanted) > 0, F.lit(name)))
        state = F.replace(state, F.lit(wanted), F.lit(" . "))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _joined(ids: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones, by lines), sentence_ids and licenses, space-joined, of every row."""
    text = text_or_empty(F.col("text").cast("string"))
    likely = F.translate(text, UPPER, LOWER).rlike(KEYWORDS)
    none = F.array().cast("array<string>")
    read = lambda t, known=SENTENCES: F.when(likely, identifiers(t, known)).otherwise(none)
    rows = docs.select("doc_id", read(text).alias("by_line"), read(F.regexp_replace(text, r"\s+", " ")).alias("wrapped"), read(paragraphs(text), MORE_SENTENCES).alias("by_paragraph"))
    both = rows.select("doc_id", "by_line", licences(_joined(F.col("by_line"))).alias("a"), F.array_union(licences(_joined(F.col("wrapped"))), licences(_joined(F.col("by_paragraph")), MORE_RULES)).alias("b"))
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("by_line").cast("long").alias("n_sentences"), F.array_join("by_line", " ").alias("sentence_ids"), F.array_join(F.array_sort(F.array_union("a", "b")), " ").alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    text = "coalesce(text, '')"
    known = "CASE trim(regexp_replace(regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.+/-]+', ' ', 'g'), '[.]+( |$)', '\\1', 'g'), ' +', ' ', 'g')) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in SENTENCES.items()) + " END"
    cut = lambda t: f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?;:])[ \\t\\r\\x0b\\x0c]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: {known}), lambda x: x IS NOT NULL)"
    likely = f"regexp_matches(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{KEYWORDS}')"
    wrapped = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    steps = [f"WITH r AS (SELECT doc_id, CASE WHEN {likely} THEN {cut(text)} ELSE [] END AS ids, CASE WHEN {likely} THEN {cut(wrapped)} ELSE [] END AS more FROM documents)", "q0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS a, ' ' || array_to_string(more, ' ') || ' ' AS b, [] :: VARCHAR[] AS found FROM r)"]
    for i, (name, sequence) in enumerate(RULES):
        w = f"' {' '.join(sequence)} '"
        steps.append(f"q{i + 1} AS (SELECT doc_id, ids, replace(a, {w}, ' . ') AS a, replace(b, {w}, ' . ') AS b, CASE WHEN contains(a, {w}) OR contains(b, {w}) THEN list_append(found, '{name}') ELSE found END AS found FROM q{i})")
    return ",\n".join(steps) + f"\nSELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string(list_sort(list_distinct(found)), ' ') AS licenses FROM q{len(RULES)}"


ORACLE = _oracle()
