"""Licence scan by sentence rules: sentences are normalised and mapped to known licence sentences, and the
sequence of their identifiers is matched against ordered licence rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from firn.llm.lines import query, table

# Every known sentence holds one of these once it is normalised, so nothing is skipped that a pattern could find.
HINTS = ("licen", "permission", "redistribut", "warrant", "copyright", "spdx", "all rights", "public domain", " cc", "creative commons", "endorse", " as is")
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?=\S)|\n(?!\s*\n))+[.!?]*")
_LEADER = re.compile(r"(?m)^[ \t]*(?://+|#+|/\*+|\*+/?|--+|;+|<!--)[ \t]*")
_NOISE = re.compile(r"[\"'`‘’“”()]")
_GAP = re.compile(r"\s+")
_V = r"(?:,? ?(?:version|v\.?)? ?)(?P<v>\d+(?:\.\d+)?)?(?: of the license)?(?P<later>,? or(?: at your option)?,? (?:any )?later(?: version)?)?"

# Known sentences: identifier and pattern over the normalised sentence (lower case, one blank, no quotes or brackets).
SENTENCES = [(name, re.compile(pattern)) for name, pattern in (
    ("spdx", r"spdx-license-identifier: ?(?P<v>[a-z0-9.+:-]+)"),
    ("apache-name", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache license" + _V),
    ("apache-comply", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-asis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("asis", r"(?:the|this) software is provided(?: by .{1,80}?)? as is"),
    ("mit-name", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e"),
    ("isc-grant", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the name of .{1,120} may be used to endorse or promote products"),
    ("bsd-name", r"(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?(?P<v>[234])-clause bsd licen[sc]e"),
    ("agpl", r"(?:licensed|released|distributed|available|redistribute it and/or modify it) under (?:the )?(?:terms of the )?gnu affero general public license(?: as published by the free software foundation,? either)?" + _V),
    ("lgpl", r"(?:licensed|released|distributed|available|redistribute it and/or modify it) under (?:the )?(?:terms of the )?gnu (?:lesser|library) general public license(?: as published by the free software foundation,? either)?" + _V),
    ("gpl", r"(?:licensed|released|distributed|available|redistribute it and/or modify it) under (?:the )?(?:terms of the )?gnu general public license(?: as published by the free software foundation,? either)?" + _V),
    ("gpl-nowarranty", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    ("mpl", r"(?:subject to|under) the terms of the mozilla public license" + _V),
    ("cc", r"(?:licensed|released|distributed|available) under (?:a |the )?(?:cc|creative commons)[ -](?P<v>(?:by|attribution|zero|0)(?:[ -](?:nc|noncommercial|sa|sharealike|nd|noderivatives|noderivs))*(?: \d+\.\d+)?)"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("copyright", r"(?:^|\W)copyright (?:c |© )?\d{4}"),
    ("reserved", r"all rights reserved"),
)]

# Ordered rules: licence and the identifiers it needs, one after the other; the first that fits wins.
RULES = (
    ("Apache-2.0", ("apache-name", "apache-comply", "apache-asis", "apache-see")),
    ("Apache-{v}", ("apache-name",)),
    ("MIT", ("mit-grant", "mit-notice", "asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-grant", "asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-{v}-Clause", ("bsd-name",)),
    ("AGPL-{v}", ("agpl", "gpl-nowarranty")),
    ("AGPL-{v}", ("agpl",)),
    ("LGPL-{v}", ("lgpl", "gpl-nowarranty")),
    ("LGPL-{v}", ("lgpl",)),
    ("GPL-{v}", ("gpl", "gpl-nowarranty")),
    ("GPL-{v}", ("gpl",)),
    ("MPL-{v}", ("mpl",)),
    ("CC-{v}", ("cc",)),
    ("{v}", ("spdx",)),
    ("public-domain", ("public-domain",)),
    ("proprietary", ("copyright", "reserved")),
)
_ASIDE = {"copyright", "reserved"}


# The rest of an SPDX expression, whose signs are upper case: each operand is a licence of its own.
_SPDX = re.compile(r"(?i:spdx-license-identifier): ?((?i:[a-z0-9.+:-]+)(?: (?:AND|OR|WITH) (?i:[a-z0-9.+:-]+))*)")


def _plain(sentence: str) -> str:
    return _GAP.sub(" ", _NOISE.sub("", _LEADER.sub("", sentence))).strip()


def normalise(sentence: str) -> str:
    """Lower case, comment signs, quotes and brackets gone, white space collapsed."""
    return _plain(sentence).lower()


def _version(match: re.Match) -> str:
    groups = match.groupdict()
    version = groups.get("v") or "unversioned"
    version = version.replace("attribution", "by").replace("noncommercial", "nc").replace("sharealike", "sa").replace(" ", "-").rstrip(".").upper()
    if "later" in groups and version != "UNVERSIONED":
        version += "-or-later" if groups["later"] else "-only"
    return version


def _known(sentence: str) -> list[tuple[str, str]]:
    """(identifier, version) of all known sentences in a sentence, in order, each once."""
    low = sentence.lower()
    found = [(m.start(), n, name, _version(m)) for n, (name, pattern) in enumerate(SENTENCES) if name != "spdx" for m in pattern.finditer(low)]
    for m in _SPDX.finditer(sentence):
        found += [(m.start(), n, "spdx", x.rstrip(".").upper()) for n, x in enumerate(re.split(" (?:AND|OR) ", m.group(1)))]
    return list(dict.fromkeys(f[2:] for f in sorted(found)))


def recognise(text: str) -> tuple[list[dict], list[str], bool]:
    """Licences found (name, start, end in code points), sentence identifiers in order, and whether a sentence
    speaks of a licence but is not known."""
    low = normalise(text)
    if not any(h in low for h in HINTS):
        return [], [], False
    marks: list[tuple[str, str, int, int]] = []
    unknown = False
    for part in _SENTENCE.finditer(text):
        sentence = _plain(part.group())
        low = sentence.lower()
        if not any(h in low for h in HINTS):
            continue
        known = _known(sentence)
        start = part.end() - len(part.group().lstrip())
        marks += [(name, version, start, part.end()) for name, version in known]
        unknown |= not known and "licen" in low
    found, at = [], 0
    while at < len(marks):
        for licence, needs in RULES:
            rest = [m for m in marks[at:] if m[0] not in _ASIDE or m[0] in needs][: len(needs)]
            if marks[at][0] == needs[0] and tuple(m[0] for m in rest) == needs:
                name = licence.format(v=rest[0][1]).removesuffix("-only") if "Apache" in licence else licence.format(v=rest[0][1])
                found.append({"licence": name, "start": rest[0][2], "end": rest[-1][3]})
                at = marks.index(rest[-1], at)
                break
        at += 1
    return found, [m[0] for m in marks], unknown


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``licences`` (distinct, sorted), ``spans`` (licence, start, end), ``sentence_ids`` and ``unknown``
    for every row of ``docs`` (``doc_id``, ``text``).

    Whole texts are read; a null or empty text has no licence. Rows that repeat are scanned each; other columns
    are not read; an empty table gives an empty result. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [recognise(t.as_py() or "") for t in batch.column("text")]
            names = [sorted({s["licence"] for s in spans}) for spans, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array([f[0] for f in found], span),
                    pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "licences", "spans", "sentence_ids", "unknown"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, licences array<string>, spans array<struct<licence:string,start:long,end:long>>, sentence_ids array<string>, unknown boolean"
    )


@query("op2_licenses")
def op2_licenses(spark, folder):
    return scan(table(spark, folder, "documents"))
