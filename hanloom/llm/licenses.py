"""License scans: sentences become identifiers, and rules are sequences of those in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices

#: Unknown sentences that may stand between two of a rule.
GAP = 2

# Normalised sentences of public licences. An asterisk stands for words that differ from case to case.
SENTENCES = {
    "apache_short": "licensed under the apache license version 2 0",
    "apache_spdx": "spdx license identifier apache 2 0",
    "apache_licensed": "licensed under the apache license version 2 0 the license",
    "apache_compliance": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at *",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_short": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_spdx": "spdx license identifier mit",
    "mit_title": "the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
    "mit_heading": "mit license",
    "mit_heading_short": "the mit license mit",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_short": "this work is licensed under the gnu general public license version 2",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "boost_short": "distributed under the boost software license version 1 0",
    "cc_by_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_nc_long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# Licences by the sentences that make them up, in order.
RULES = (
    ("Apache-2.0", ("apache_licensed", "apache_compliance", "apache_copy", "apache_as_is", "apache_see")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("Apache-2.0", ("apache_licensed", "apache_compliance")),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("apache_spdx",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_spdx",)),
    ("MIT", ("mit_title",)),
    ("GPL-3.0-only", ("gpl3_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("Proprietary", ("reserved",)),
    ("MIT", ("mit_heading",)),
    ("MIT", ("mit_heading_short",)),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("LGPL-3.0-or-later", ("lgpl3_free",)),
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("GPL-2.0-only", ("gpl2_short",)),
    ("MPL-2.0", ("mpl2_form",)),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("unlicense_free",)),
    ("BSL-1.0", ("boost_short",)),
    ("CC-BY-4.0", ("cc_by_long",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_long",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_long",)),
)
# SPDX identifiers, besides those of the sentences above.
SPDX = (
    "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "PostgreSQL", "Python-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
)

#: A sentence may end here: at a stop before white space, at a line's end.
_END = re.compile(r"[.!?;:](?=\s|$)|\n")
#: Words that an asterisk may stand for.
_OPEN = 40
_NOT = re.compile(r"[^0-9a-z]+")


def normalise(sentence: str) -> str:
    """Lower case; runs of anything but ASCII letters and digits become one space."""
    return _NOT.sub(" ", sentence.lower()).strip()


# Not the old ids GPL-2.0 and GPL-2.0+, which are alike when normalised.
SENTENCES |= {f"spdx_{x}": normalise(f"SPDX-License-Identifier: {x}") for x in SPDX}
RULES += tuple((x, (f"spdx_{x}",)) for x in SPDX)


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES, gap: int = GAP):
        self.exact = {s: k for k, s in sentences.items() if "*" not in s}
        self.open = [(k, re.compile("(?:.*)".join(map(re.escape, s.split("*")))), s.split("*")[0], len(s.split()) + _OPEN) for k, s in sentences.items() if "*" in s]
        heads = [*self.exact, *(h for _, _, h, _ in self.open)]
        self.begun = {" ".join(w[:i]) for w in map(str.split, heads) for i in range(1, len(w) + 1)}
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.gap = gap

    def _from(self, pieces: list[tuple[int, int, str]], i: int) -> tuple[int, str] | None:
        """The piece after, and the identifier of, the known sentence that starts with piece i: the longest without an asterisk, else the
        shortest with one."""
        s, best = "", None
        for j in range(i, len(pieces)):
            s = f"{s} {pieces[j][2]}" if s else pieces[j][2]
            if found := self.exact.get(s):
                best = j + 1, found
            opened = [x for x in self.open if s.startswith(x[2]) and s.count(" ") < x[3]]
            if not best:
                if found := next((k for k, p, _, _ in opened if p.fullmatch(s)), None):
                    return j + 1, found
            if s not in self.begun and not opened:
                break
        return best

    def sentences(self, text: str) -> list[tuple[int, int, int, str]]:
        """(number, start, end, identifier) of the known sentences. Texts fall into pieces at stops before white space and at the ends of
        lines; a known sentence is any run of pieces that reads like it, so it may hold stops, line ends, empty lines and comment signs."""
        pieces, at = [], 0
        for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
            if stop > at and (s := normalise(text[at:stop])):
                pieces.append((at, stop, s))
            at = stop
        out, i, number = [], 0, 0
        while i < len(pieces):
            found = self._from(pieces, i)
            if found:
                out.append((number, pieces[i][0], pieces[found[0] - 1][1], found[1]))
            i = found[0] if found else i + 1
            number += 1
        return out

    def licences(self, found: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int]]:
        """(licence, start, end): longer rules first; a sentence serves one rule."""
        used, out = [False] * len(found), []
        for name, rule in self.rules:
            i = 0
            while i + len(rule) <= len(found):
                span = found[i : i + len(rule)]
                near = all(b[0] - a[0] <= self.gap + 1 for a, b in zip(span, span[1:]))
                if near and not any(used[i : i + len(rule)]) and tuple(x[3] for x in span) == tuple(rule):
                    used[i : i + len(rule)] = [True] * len(rule)
                    out.append((name, span[0][1], span[-1][2]))
                    i += len(rule)
                else:
                    i += 1
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(row, sentences, licences), a row per row of ``docs``, ``row`` with all columns but the text; spans are code points, end exclusive.

    A null text counts as empty and has no sentence. Whole texts; repeated rows stay. A sentence that no rule takes is still listed.
    """
    scanner = scanner or Scanner()
    others = [c for c in docs.columns if c != text_col]
    sentence = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    licence = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    types = [pa.list_(pa.struct([(k, pa.string()), ("start", pa.int64()), ("end", pa.int64())])) for k in ("id", "licence")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [scanner.sentences(t) for t in b.column(1).to_pylist()]
            ids = pa.array([[{"id": k, "start": s, "end": e} for _, s, e, k in f] for f in found], types[0])
            names = pa.array([[{"licence": k, "start": s, "end": e} for k, s, e in scanner.licences(f)] for f in found], types[1])
            yield pa.RecordBatch.from_arrays([b.column(0), ids, names], ["row", "sentences", "licences"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.transform(map_arrow, run, T.StructType([rows.schema["row"], T.StructField("sentences", sentence), T.StructField("licences", licence)]))
