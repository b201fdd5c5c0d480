"""Licence recognition by sentence rules.

Texts are cut into sentences, which are normalised (A-Z in lower case, runs of other ASCII
characters as one blank) and looked up among known licence sentences.  The identifiers of
a document's known sentences, in their order, are then matched against ordered rules: a
rule holds if all parts of its sentences occur one after the other, others between them
allowed, and no rule that says more holds (:data:`MORE_SPECIFIC`).

End marks with blanks behind them and blank lines end a sentence.  A line end may end one or
be a wrap: a sentence may begin at any line and go on over the next lines, up to an end mark.
It counts at the place of its first line; a sentence and a longer one that begins with it
both count.

The lookup is a broadcast join of each piece of a text with the beginnings of the sentences
below, whose size is known; where a sentence goes on behind the next piece, its document is
read again and compared within the row.  Of all others only the found sentences move.  Defined results: null and empty texts have no sentences; a
sentence that stands several times counts each time; a text of any length is read whole, row by
row; rows alike in doc_id and text share a result; rows of a doc_id with different texts are
apart; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, stored

#: Identifier of a licence sentence, and the sentence in its usual form.
SENTENCES = {
    "agpl-grant": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-compliance": "You may not use this file except in compliance with the License.",
    "apache-grant": "Licensed under the Apache License, Version 2.0.",
    "apache-grant-full": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-grant": "Released under the BSD License.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "Dedicated to the public domain under CC0 1.0.",
    "gpl2-grant": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-grant": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free-software": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-grant": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-grant": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Ordered rules, from licence to the identifiers that follow each other.
RULES = [
    ("AGPL-3.0", ["agpl-grant"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-grant-full", "apache-compliance"]),
    ("BSD", ["bsd-grant"]),
    ("BSD", ["bsd-conditions"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-2.0", ["gpl2-grant"]),
    ("GPL-3.0", ["gpl3-grant"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl-no-warranty"]),
    ("ISC", ["isc-permission"]),
    ("LGPL-3.0", ["lgpl-grant"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-permission", "mit-as-is"]),
    ("MPL-2.0", ["mpl-grant"]),
    ("Proprietary", ["rights-reserved"]),
    ("Unlicense", ["unlicense"]),
]
#: Sentences and rules beside those of the table, in the words of the whole licence texts.
MORE_SENTENCES = {
    "agpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-int": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-int": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-int": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-int": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-int": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-int": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-permission-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl11-grant": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
MORE_RULES = [
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSL-1.0", ["boost"]),
    ("CC-BY-4.0", ["cc-by-int"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-int"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-int"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-int"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-int"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-int"]),
    ("GPL-2.0", ["gpl2-only"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("MIT", ["mit-permission-full", "mit-as-is"]),
    ("MPL-1.1", ["mpl11-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-permission"]),
]
#: Licences that do not count beside those that say more.
MORE_SPECIFIC = {"BSD": ["BSD-2-Clause", "BSD-3-Clause"], "BSD-2-Clause": ["BSD-3-Clause"]}
#: Sentence ends (a mark, and blanks, a line end or the end behind it) and what is no word, in
#: regular expressions that Spark and DuckDB both read; \\x01 stands behind an ended piece.
MARK = r"[.!?:;](?:[ \t\r]*\n|[ \t\r]+|\z)"
PLAIN = r"[^a-z0-9\x{80}-\x{10FFFF}\x01\n]+"


def pieces(sentence: str) -> list[str]:
    """A sentence of the table, cut and normalised as texts are."""
    marked = re.sub(r"[.!?:;](?:[ \t\r]*\n|[ \t\r]+|\Z)", "\n", sentence.lower())
    return [x.strip() for x in re.sub("[^a-z0-9\u0080-\U0010ffff\n]+", " ", marked).split("\n") if x.strip()]


def known_sentences() -> dict[str, str]:
    """Normalised sentences of the table and their identifiers; entries of several sentences are cut as texts are."""
    known: dict[str, str] = {}
    for key, entry in (SENTENCES | MORE_SENTENCES).items():
        for k, part in enumerate(pieces(entry)):
            known.setdefault(part, f"{key}+{k}" if k else key)
    return known


def rules() -> list[tuple[str, list[str]]]:
    """All rules, with the identifiers of all parts of their sentences."""
    known, table = known_sentences(), SENTENCES | MORE_SENTENCES
    return [(name, [known[part] for x in rule for part in pieces(table[x])]) for name, rule in RULES + MORE_RULES]


def rule_pattern(identifiers: list[str]) -> str:
    """A pattern over ',id,,id,,id,' for identifiers in order."""
    return "%".join(["", *(f",{x}," for x in identifiers), ""])


def heads() -> list[tuple[str, str, str, int]]:
    """(head, sid, sentence, words): the beginnings of all known sentences."""
    return [(" ".join(s.split()[:n]), sid, s, len(s.split())) for s, sid in known_sentences().items() for n in range(1, len(s.split()) + 1)]


#: The candidates ``c`` whose sentence is made up of the pieces from their place on, no end mark before the last one.
WHOLE = """
transform(filter(wanted, c -> size(pieces) - c.place > 1 AND
  exists(sequence(2, greatest(2, least(c.words, size(pieces) - c.place))), k ->
    NOT exists(slice(pieces, c.place + 1, k - 1), x -> endswith(x, '\u0001')) AND
    concat_ws(' ', transform(slice(pieces, c.place + 1, k), x -> trim(BOTH ' \u0001' FROM x))) = c.sentence)), c -> struct(c.place AS place, c.sid AS sid))
"""


def pieces_of(text: Column) -> Column:
    """The pieces of a text, normalised but for blanks at their ends; ended ones have \\x01 last."""
    low = F.replace(ascii_lower(text), F.lit("\x01"), F.lit(" "))
    return F.split(F.regexp_replace(F.regexp_replace(low, MARK, "\x01\n"), PLAIN, " "), "\n", -1)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids, licenses (sorted), comma-joined."""
    table = docs.sparkSession.createDataFrame(heads(), "head string, sid string, sentence string, words int")
    rows = docs.select(*row_key(), "doc_id", "text")
    cut = rows.select("_id", "_h", pieces_of(F.col("text")).alias("pieces"))
    # each piece with the next one, which rules out nearly all beginnings that do not go on
    pairs = cut.select("_id", "_h", F.posexplode(F.arrays_zip(F.col("pieces").alias("piece"), F.expr("slice(pieces, 2, size(pieces))").alias("next"))).alias("place", "x"))
    pairs = pairs.select("_id", "_h", "place", F.col("x.piece").alias("piece"), F.expr("trim(BOTH ' \u0001' FROM x.piece)").alias("bare"), F.expr("concat(trim(BOTH ' \u0001' FROM x.piece), ' ', trim(BOTH ' \u0001' FROM x.next))").alias("two"))
    on = "bare = head AND (head = sentence OR (NOT endswith(piece, '\u0001') AND (two = sentence OR startswith(sentence, concat(two, ' ')))))"
    met = stored(pairs.join(F.broadcast(table), F.expr(on)).select("_id", "_h", "place", "sid", "sentence", "words", F.expr("head = sentence").alias("whole")), "sentences")
    parts = met.filter("NOT whole").groupBy(F.col("_id").alias("i"), F.col("_h").alias("h")).agg(F.collect_set(F.struct("place", "sid", "sentence", "words")).alias("wanted"))
    # sentences over several lines: their few documents are read again
    parts = stored(parts, "wrapped")
    again = rows.join(parts, F.expr("_id <=> i AND _h = h")).select("_id", "_h", "wanted", pieces_of(F.col("text")).alias("pieces"))
    wrapped = again.select("_id", "_h", F.explode(F.expr(WHOLE)).alias("x"))
    all_ = met.filter("whole").select("_id", "_h", F.struct("place", "sid").alias("x")).union(wrapped)
    found = all_.groupBy(F.col("_id").alias("i"), F.col("_h").alias("h")).agg(F.array_sort(F.collect_set("x")).alias("s"))
    found = found.select("i", "h", F.expr("transform(s, x -> x.sid)").alias("ids"))
    out = rows.drop("text").join(found, F.expr("_id <=> i AND _h = h"), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    line = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    held = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(line.like(rule_pattern(rule)), F.lit(name)) for name, rule in rules())))))
    out = out.select("doc_id", ids.alias("ids"), held.alias("held"))
    weaker = F.array(*(F.when(F.arrays_overlap("held", F.array(*map(F.lit, more))), F.lit(name)) for name, more in MORE_SPECIFIC.items()))
    licenses = F.array_except("held", weaker)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licenses, ",").alias("licenses")
    )
