"""License scans by sentence rules.

Texts are cut into sentences, which are normalised and mapped to identifiers of known licence sentences. The sequence of
identifiers of a text is then matched against ordered rules: the first rule whose identifiers stand in that order, with
no other known sentence between, names a licence, takes its sentences out, and matching goes on with the rest.

Defined results: a null text is an empty one; unknown sentences are passed over; texts of any length are read whole; repeated rows keep their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relatum.llm.common import text_slices

#: Normalised names of licences in sentences that grant them by name.
NAMES = {
    "mit license": "MIT",
    "mit": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "mpl 2 0": "MPL-2.0",
    "unlicense": "Unlicense",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu gpl v3": "GPL-3.0",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "bsd 3 clause license": "BSD-3-Clause",
    "bsd 2 clause license": "BSD-2-Clause",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc0 1 0": "CC0-1.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "isc license": "ISC",
}
#: Other known sentences, as beginnings of their normalised form.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": "the above copyright notice and this permission notice shall be included",
    "as-is": "the software is provided as is without warranty of any kind",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "neither the name of",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it",
    "gpl-hope": "this program is distributed in the hope that it will be useful",
    "apache-unless": "unless required by applicable law or agreed to in writing",
    "apache-use": "you may not use this file except in compliance with the license",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications",
    "gpl-lesser": "you should have received a copy of the gnu lesser general public license",
    "gpl-copy": "you should have received a copy of the gnu general public license",
    "rights": "all rights reserved",
}
#: Licences by the sequence of identifiers that names them, the more telling first.
RULES = [
    ("BSD-3-Clause", ("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("rights", "bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("rights", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("named:Apache-2.0", "apache-use", "apache-unless")),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form",)),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("LGPL", ("gpl-redistribute", "gpl-hope", "gpl-lesser")),
    ("GPL", ("gpl-redistribute", "gpl-hope", "gpl-copy")),
    ("GPL", ("gpl-redistribute", "gpl-hope")),
    ("GPL", ("gpl-redistribute",)),
    ("MIT", ("mit-grant",)),
    ("Proprietary", ("rights",)),
]
GRANT = re.compile(r"^(?:(?:this|the) (?:\w+ ){1,3}(?:is|are) )?(?:dual )?(?:released|licensed|distributed|made available|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(.+)$")
SPDX = re.compile(r"(?im)spdx-license-identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
#: Licences by the name that a tag has, in small letters; others keep theirs as it is written.
TAGS = {x.lower(): x for x in NAMES.values()}
#: What may follow a name in the sentence that grants by it.
AFTER = re.compile(r" (?:see|as|which|whose|you|unless|with|and may|available at|https?) .*$")
#: What a text must hold for any sentence to be known.
TRIGGER = r"(?i)licen[cs]ed|subject to the terms|copy of the|free and unencumbered|anyone is free|granted|released|distributed|available under|published under|provided|permission|redistribut|neither the name|free software|required by|compliance|rights reserved|spdx"
DECORATION = re.compile(r"[!#$%&*|]+")
#: A sentence ends at a mark or a blank line (of a comment too); its lines may be wrapped.
END = re.compile(r"[.;?](?=\s|$)|\n(?:[^\w\n]*\n)+")
#: Normalised characters that tell a wrapped sentence.
TELLING = 200
OTHER = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def sentence_id(sentence: str) -> str | None:
    """The identifier of a normalised sentence, None if it is not known."""
    m = GRANT.match(sentence)
    if m:
        name = m[1]
        name = name.removesuffix(" the license") if name.removesuffix(" the license") in NAMES else name
        for x in (name, name.removesuffix(" license"), AFTER.sub("", name), AFTER.sub("", name).removesuffix(" license")):
            if x in NAMES:
                return f"named:{NAMES[x]}"
    for key, start in SENTENCES.items():
        if sentence.startswith(start):
            return key
    return None


def tagged(expression: str) -> list[str]:
    """Identifiers of the licences in an expression such as `MIT OR (Apache-2.0 AND BSD-3-Clause)`, each once."""
    out, operand, exception = [], True, False
    for w in expression.replace("(", " ").replace(")", " ").split():
        if w.upper() in ("AND", "OR", "WITH"):
            operand, exception = True, w.upper() == "WITH"
        elif not operand:
            break
        else:
            plain = re.sub(r"(?i)-(?:or-later|only)$|\+$", "", w.rstrip("."))
            if plain and not exception:
                out.append(f"named:{TAGS.get(plain.lower(), plain)}")
            operand = exception = False
    return list(dict.fromkeys(out))


def identifiers(text: str) -> list[str]:
    """Known sentences of a text in order."""
    out = []
    for s in END.split(DECORATION.sub("", text)):
        if not re.search(TRIGGER, s.replace("\n", " ")):
            continue
        tags = [x for m in SPDX.finditer(s) for x in tagged(m[1])]
        if tags:
            out += tags
            continue
        lines = [normalised(x) for x in s.split("\n")]
        for i, line in enumerate(lines):
            # A known sentence may begin at any line; where the line alone is none, those it is wrapped to are joined.
            k, j = sentence_id(line) if line else None, i + 1
            if line and k is None and j < len(lines):
                while j < len(lines) and len(line) < TELLING:
                    line = f"{line} {lines[j]}".strip()
                    j += 1
                k = sentence_id(line)
            if k:
                out.append(k)
    return out


def matched(ids: list[str]) -> list[str]:
    """Licences that the rules find in a sequence of identifiers."""
    out, left = [], list(ids)
    for name, rule in RULES:
        i = 0
        while i + len(rule) <= len(left):
            if tuple(left[i : i + len(rule)]) == rule:
                out.append(name)
                del left[i : i + len(rule)]
            else:
                i += 1
    out += [x.removeprefix("named:") for x in left if x.startswith("named:")]
    return sorted(set(out))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, n_licenses, licenses (joined by commas) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            col = pc.fill_null(b.column("text"), "")
            maybe = pc.match_substring_regex(col, TRIGGER).to_pylist()
            ids = [identifiers(t.as_py()) if m else [] for t, m in zip(col, maybe, strict=True)]
            names = [matched(x) for x in ids]
            cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([",".join(x) for x in ids], pa.string()), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_sentences", "sentence_ids", "n_licenses", "licenses"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_sentences bigint, sentence_ids string, n_licenses bigint, licenses string")
