"""Licences of files: notices by TF-IDF cosine to templates, then inheritance from directories.

Sentences and paragraphs with a word that notices use are compared with short template texts as sparse
TF-IDF vectors of words and word pairs; the best template above ``THRESHOLD`` is the file's own licence.
The whole file, and its part from the first to the last paragraph with such a word, are compared in the same
way with full licence texts (``licence_texts``); one above ``WHOLE`` comes before any short notice, for full
texts name other licences.  A file that is mostly notice or as a whole a licence text is a licence file of
its directory.  Files without a notice inherit from
their nearest ancestor directory that has a licence file.  Inheritance joins directories, not files: the
distinct directories are resolved once, so a directory with very many files is one row.

Defined results: a null or empty text has no notice; a null path lies in no directory and inherits
nothing; of several licence files of a directory the best score wins, then the licence that is first in
the alphabet; of equal templates the first in the alphabet; repeated rows each get the same row; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, small_batches

NOTICES = "doc_id long, path string, own string, own_score double, share double"
THRESHOLD, WHOLE, MOSTLY = 0.55, 0.75, 0.5
TRIGGER = r"licen[cs]e|copyright|permission|warranty|redistribut|public domain|spdx"
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
# Notices of well-known licences and titles of their texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License, or any later version."),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause \"Simplified\" License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause \"New\" or \"Revised\" License"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Licensed under MPL 2.0."),
    ("MPL-2.0", "This Source Code Form is licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Released under the Unlicense."),
    ("Unlicense", "Licensed under The Unlicense"),
    *((name, f"Licensed under {short}.") for short, name in (("AGPL 3.0", "AGPL-3.0"), ("AGPLv3", "AGPL-3.0"), ("GPL 2.0", "GPL-2.0"), ("GPLv2", "GPL-2.0"), ("GPL 3.0", "GPL-3.0"), ("GPLv3", "GPL-3.0"), ("LGPL 2.1", "LGPL-2.1"), ("LGPL 3.0", "LGPL-3.0"), ("LGPLv3", "LGPL-3.0"))),
    *((f"CC-{code}-{v}", f"Licensed under CC {code} {v}.") for v in CC_VERSIONS for code in CC),
    *((f"CC-{code}-{v}", f"This work is licensed under a Creative Commons {name} {v} International License.") for v in CC_VERSIONS for code, name in CC.items() if (code, v) not in (("BY", "4.0"), ("BY-SA", "4.0"))),
    *((f"CC-{code}-{v}", f"Creative Commons {name} {v} International Public License") for v in CC_VERSIONS for code, name in CC.items()),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for end in ("", "-only", "-or-later") if (name, end) != ("GPL-3.0", "-only")),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "CC0-1.0", "ISC", "MPL-2.0", "Unlicense")),
    *((f"CC-{code}-{v}", f"SPDX-License-Identifier: CC-{code}-{v}") for v in CC_VERSIONS for code in CC),
)

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_TRIGGER = re.compile(TRIGGER)
_PIECE = re.compile(r"\n|(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n[^\w\n]*\n")


def full_texts() -> list[tuple[str, str]]:
    """Names and full texts of licences and of their long notices; the AGPL is made from the GPL by their differences."""
    return [(f.stem.removesuffix("_notice"), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def terms(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(words) + Counter(zip(words, words[1:]))


class Templates:
    """Weighted templates by term, and the weights of terms."""

    def __init__(self, templates=TEMPLATES):
        counted = [(name, terms(text)) for name, text in templates]
        df = Counter(t for _, c in counted for t in c)
        self.idf = {t: log((1 + len(counted)) / (1 + n)) + 1 for t, n in df.items()}
        self.unseen = log(1 + len(counted)) + 1
        self.by_term: dict = {}
        self.names = [name for name, _ in counted]
        for k, (_, c) in enumerate(counted):
            weights = {t: n * self.idf[t] for t, n in c.items()}
            norm = sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.by_term.setdefault(t, []).append((k, w / norm))

    def best(self, text: str) -> tuple[float, str]:
        weights = {t: n * self.idf.get(t, self.unseen) for t, n in terms(text).items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        scores: Counter = Counter()
        for t, w in weights.items():
            for k, v in self.by_term.get(t, ()):
                scores[k] += w * v / norm
        if not scores:
            return 0.0, ""
        top = max(scores.values())
        return top, min(self.names[k] for k, s in scores.items() if s >= top - 1e-12)

    def notice(self, text: str, full: Templates | None = None) -> tuple[str | None, float | None, float]:
        """Licence and score of a text's best notice, and the share of its words that are in notices."""
        paragraphs = _PARAGRAPH.split(text)
        triggered = [k for k, paragraph in enumerate(paragraphs) if _TRIGGER.search(paragraph.lower())]
        words = max(1, len(text.split()))
        if full and triggered:
            score, name = full.best(text)
            if score >= WHOLE:
                return name, score, 1.0
            part = "\n\n".join(paragraphs[triggered[0] : triggered[-1] + 1])
            score, name = full.best(part)
            if score >= WHOLE:
                return name, score, len(part.split()) / words
        found, held = (0.0, ""), 0
        for k in triggered:
            own, share = self.paragraph(paragraphs[k])
            held += share
            if own[0] > found[0] or own[0] == found[0] and own[1] < found[1]:
                found = own
        share = held / words
        return (found[1], found[0], share) if found[0] >= THRESHOLD else (None, None, share)

    def paragraph(self, text: str) -> tuple[tuple[float, str], int]:
        """The best of a paragraph's notices, and the number of its words that are in notices."""
        found, held = self.best(text), 0
        if found[0] >= THRESHOLD:
            held = len(text.split())
        pieces = _PIECE.split(text)
        part = 0
        for k, piece in enumerate(pieces):
            if not _TRIGGER.search(piece.lower()):
                continue
            own = self.best(piece)
            if k + 1 < len(pieces):  # a notice may run over a line's end
                longer = self.best(piece + " " + pieces[k + 1])
                own = longer if longer[0] > own[0] else own
            if own[0] >= THRESHOLD:
                part += len(piece.split())
            if own[0] > found[0] or own[0] == found[0] and own[1] < found[1]:
                found = own
        return found, max(held, part)


def notices(files: DataFrame) -> DataFrame:
    """The own licence of each file (columns doc_id, path, text)."""
    texts = full_texts()

    def find(batches):
        templates, full = Templates(), Templates(texts)
        for batch in batches:
            got = [templates.notice(t.decode("utf-8", "replace"), full) if t else (None, None, 0.0) for t in byte_rows(batch.column("text"))]
            columns = [batch.column("doc_id"), batch.column("path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "own", "own_score", "share"])

    own = small_batches(files).select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.when(F.col("text").rlike(f"(?i){TRIGGER}"), F.col("text")).alias("text"))
    return own.mapInArrow(find, NOTICES)


def parent(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan_licenses(files: DataFrame) -> DataFrame:
    """Own or inherited licence of each file."""
    own = notices(files).withColumn("dir", parent(F.col("path")))
    licensed = own.where((F.col("own").isNotNull()) & (F.col("share") >= MOSTLY) & F.col("dir").isNotNull())
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("rank"), "own")).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.own").alias("dir_license"), (-F.col("best.rank")).alias("dir_score"))
    dirs = own.where("own is null and dir is not null").select("dir").distinct()
    pieces = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(pieces, 1, n), "/").alias("ancestor")))
    above = dirs.select("dir", F.explode(ups).alias("up")).select("dir", "up.depth", "up.ancestor")
    near = above.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license", "dir_score")).alias("near"))
    joined = own.join(near, "dir", "left")
    mine = F.col("own").isNotNull()
    how = F.when(mine, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("own", "near.dir_license").alias("license"), F.round(F.coalesce("own_score", "near.dir_score"), 6).alias("score"), how.alias("how"), F.when(~mine, F.col("near.ancestor")).alias("from_dir"))
