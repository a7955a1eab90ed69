"""Licence scan: sparse TF-IDF cosine of file texts to licence templates, then inheritance from the nearest directory.

Sentences that several licences share are told apart by the words around them (version, Lesser, third clause), SPDX
lines are read, and a file is compared as a whole to whole licence texts. All licences found are kept, the best first.

Every stretch of a text as long as a template is a candidate. A stretch can only reach the wanted cosine if it holds
one of the template's heaviest terms, so texts without such a term are left after a substring search. Files without a
licence of their own take that of the nearest directory above them that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, stored

# --- fixed values: characteristic sentences of public licences ---
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
# --- end of fixed values ---

#: More sentences, weighed apart from the templates.
NOTICES = (
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
GNU = re.compile(r"gnu (?:(affero|lesser|library) )?general public licen[cs]e(?:.*?\bv(?:ersion )?(\d)(?: (\d))?\b)?")
GNU_KNOWN = {"GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-1.0", "AGPL-3.0"}
CREATIVE_COMMONS = re.compile(r"\bcc by((?: nc| nd| sa)*)(?: v?(\d) (\d))?\b")
APACHE = re.compile(r"\bapache licen[cs]e version (\d) (\d)\b")

#: A stretch that looks like a sentence of the licence but holds none of these words is of another.
TELLING = {
    "Apache-2.0": {"apache", "compliance"}, "BSL-1.0": {"boost"}, "CC-BY-4.0": {"cc"}, "CC-BY-NC-4.0": {"cc"}, "CC-BY-SA-4.0": {"cc"}, "GPL-3.0": {"gnu"},
    "MIT": {"mit", "granted"}, "MPL-1.1": {"mozilla"}, "MPL-2.0": {"mozilla"},
}
#: The two texts speak of each other.
SIBLINGS = {"GPL-3.0": "AGPL-3.0", "AGPL-3.0": "GPL-3.0"}

LEAST = 0.75
#: Wanted cosine of a whole file to a whole licence text, over 1 + log of the counts of all terms.
WHOLE_LEAST = 0.9
#: A file without any of these is not compared to whole texts, all of which hold one.
WHOLE_NEEDLES = ("license", "redistribution", "permission")
TERM = re.compile(r"[a-z0-9]+")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Templates as weighted vectors. ``seen`` has the documents that hold a term, for the templates' terms; any other
    term counts as one that no document holds."""

    def __init__(self, templates: Sequence[tuple[str, str]], documents: int, seen: dict[str, int], least: float) -> None:
        self.least = least
        self.top = math.log(1 + documents) + 1
        self.weight = {t: math.log((1 + documents) / (1 + seen.get(t, 0))) + 1 for _, x in templates for t in terms(x)}
        self.vectors, self.by_anchor = [], defaultdict(list)
        for name, text in templates:
            counts = Counter(terms(text))
            raw = {t: n * self.weight[t] for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vector = {t: w / norm for t, w in raw.items()}
            at = len(self.vectors)
            self.vectors.append((name, sum(counts.values()), vector))
            # the heaviest terms, until what is left cannot reach the cosine
            left = 1.0
            for t in sorted(vector, key=lambda t: (-vector[t], t)):
                if left < least * least - 1e-9:
                    break
                self.by_anchor[t].append(at)
                left -= vector[t] ** 2
        self.needles = tuple(self.by_anchor)

    def cosine(self, window: list[str], vector: dict[str, float]) -> float:
        counts = Counter(window)
        norm = math.sqrt(sum((n * self.weight.get(t, self.top)) ** 2 for t, n in counts.items()))
        return sum(n * self.weight[t] * vector[t] for t, n in counts.items() if t in vector) / norm

    def hits(self, low: str) -> list[tuple[str, float]]:
        """(licence, cosine) of every stretch of a text in lower case with at least the wanted cosine, of overlapping
        stretches the best one; the licence is the one that the words around it tell."""
        if not any(n in low for n in self.needles):
            return []
        found = TERM.findall(low)
        starts = defaultdict(set)
        for at, t in enumerate(found):
            for k in self.by_anchor.get(t, ()):
                size = self.vectors[k][1]
                starts[k].update(range(max(0, at - size + 1), min(at, max(0, len(found) - size)) + 1))
        out = []
        for k, places in starts.items():
            name, size, vector = self.vectors[k]
            scored = [(-score, at) for at in places if (score := round(self.cosine(found[at : at + size], vector), 9)) >= self.least]
            taken: set[int] = set()
            for score, at in sorted(scored):
                if not taken.intersection((at, at + size - 1)) and (name not in TELLING or TELLING[name].intersection(found[at : at + size])):
                    taken.update(range(at, at + size))
                    out.append((told(name, found, at, size), -score))
        return out


def told(name: str, found: list[str], at: int, size: int) -> str:
    """The licence that a stretch of a text names that looks like one of ``name``, by the words in and after it. Where
    they tell nothing, the sentence's own."""
    near, after = " ".join(found[max(0, at - 3) : at + size + 12]), " ".join(found[at : at + size + 160])
    if name.startswith("GPL") and (m := GNU.search(near)):
        kind = {"affero": "AGPL", None: "GPL"}.get(m[1], "LGPL")
        full = f"{kind}-{m[2]}.{m[3] or 0}"
        return full if full in GNU_KNOWN else {"GPL": name, "AGPL": "AGPL-3.0"}.get(kind, kind)
    if name.startswith("CC-BY") and (m := CREATIVE_COMMONS.search(near)):
        return "-".join(["CC-BY", *m[1].upper().split(), *([f"{m[2]}.{m[3]}"] if m[2] else [])])
    if name.startswith("Apache"):
        if m := APACHE.search(near):
            return f"Apache-{m[1]}.{m[2]}"
        before = " ".join(found[max(0, at - 40) : at + size + 40])
        others = {"mozilla public": "MPL-1.1", "common development and distribution": "CDDL-1.0", "educational community": "ECL-2.0"}
        return next((x for words, x in others.items() if words in before), name)
    if name.startswith("BSD"):
        clauses, goes_on, _ = after.partition("software is provided")
        if "advertising materials" in clauses:
            return "BSD-4-Clause"
        return "BSD-2-Clause" if goes_on and "endorse or promote" not in clauses and "neither the name" not in clauses else name
    if name == "MIT" and "person or organization" in after:
        return "BSL-1.0"
    if name == "ISC":
        here = " ".join(found[at : at + size])
        return "HPND" if "documentation" in here else "ISC" if "provided that" in here else "0BSD"
    return name


def spdx(text: str) -> set[str]:
    """The licences of the SPDX lines of a text, without exceptions and without ``-only``, ``-or-later`` and ``+``."""
    out = set()
    for line in SPDX.findall(text):
        ids, exception = SPDX_ID.findall(line), False
        for k, x in enumerate(ids):
            if x.upper() in ("AND", "OR", "WITH"):
                exception = x.upper() == "WITH"
            elif k == 0 or ids[k - 1].upper() in ("AND", "OR") and not exception:
                out.add(re.sub(r"(-only|-or-later|\+)$", "", x))
    return out


class Whole:
    """Whole licence texts as vectors."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.vectors = {name: self.vector(terms(x)) for name, x in texts.items()}

    @staticmethod
    def vector(found: list[str]) -> dict[str, float]:
        raw = {t: 1 + math.log(n) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    def best(self, low: str) -> tuple[str | None, float]:
        """(licence, cosine) of the text that a whole file in lower case is closest to, or (None, 0)."""
        if not any(n in low for n in WHOLE_NEEDLES):
            return None, 0.0
        found = TERM.findall(low)
        mine = self.vector(found)
        cosine, name = max((round(sum(w * mine.get(t, 0.0) for t, w in v.items()), 9), name) for name, v in self.vectors.items())
        if cosine < WHOLE_LEAST:
            return None, 0.0
        # the AGPL is the GPL's text but for its title and one section, the BSD licence of two clauses lacks the third
        if name == "GPL-3.0" and "affero" in found[:12]:
            name = "AGPL-3.0"
        elif name == "BSD-3-Clause":
            name = told(name, found, 0, len(found))
        return name, cosine


class Finder:
    """All that names a licence: the wanted templates and the notices, SPDX lines, and whole texts."""

    def __init__(self, matchers: Sequence[Matcher], whole: Whole) -> None:
        self.matchers, self.whole = matchers, whole

    def all(self, text: str | None) -> list[tuple[str, float]]:
        """(licence, cosine) of every licence that a text names. The one whose text the file as a whole is comes first,
        then the highest cosine, the first name on ties."""
        low, best = (text or "").lower(), {}
        for name, score in (*((x, 1.0) for x in spdx(text or "")), *(x for m in self.matchers for x in m.hits(low))):
            best[name] = max(score, best.get(name, 0.0))
        name, score = self.whole.best(low)
        if name:
            best[name] = score
            best.pop(SIBLINGS.get(name), None)
        return sorted(best.items(), key=lambda x: (x[0] != name, -x[1], x[0]))


def whole_texts() -> dict[str, str]:
    """The whole licence texts that lie beside this module, by licence; read by the driver only."""
    files = resources.files(__package__).joinpath("licence_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text() for f in sorted(files, key=lambda f: f.name) if f.name.endswith(".txt")}


def _document_counts(wanted: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for rows in batches:
            seen[""] += len(rows)
            for text in rows["text"]:
                low = text.lower()
                if any(t in low for t in wanted):
                    seen.update(wanted.intersection(TERM.findall(low)))
        if seen:
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return run


def fit(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> Finder:
    """Document frequencies of the sentences' terms over all files; their number is bounded by the sentences."""
    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    wanted = frozenset(t for _, x in (*templates, *NOTICES) for t in terms(x))
    texts = files.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInPandas(_document_counts(wanted), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = {r["term"]: r["n"] for r in counts}
    documents = seen.pop("", 0)
    return Finder([Matcher(x, documents, seen, least) for x in (templates, NOTICES)], Whole(whole_texts()))


def scan(files: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, path, own, cosine, named) of every file (doc_id, path, text): the licence its whole text names, or NULL,
    and all that it names, the best first."""
    spark = files.sparkSession
    ship_package(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(finder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [shared.value.all(t) for t in rows["text"]]
            own = pd.Series([x[0][0] if x else None for x in found], dtype=object, index=rows.index)
            named = pd.Series([[n for n, _ in x] for x in found], dtype=object, index=rows.index)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "path": rows["path"], "own": own, "cosine": [x[0][1] if x else 0.0 for x in found], "named": named})

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "path", "text").mapInPandas(run, f"doc_id {kind}, path string, own string, cosine double, named array<string>")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds licence, licence_from (``file``, the directory it is inherited from, or NULL) and licences, all that stand
    where the licence is from, to scanned files.

    Directories are resolved once each and joined back to their files. Of several licence files in a directory the one
    with the highest cosine counts, the first name on ties. A NULL path has no directory; paths are split at ``/``."""
    directory = F.regexp_replace(F.regexp_extract("path", "^(.*/)?", 0), "/$", "")
    rows = scanned.withColumn("_dir", F.when(F.col("path").isNotNull(), directory))
    is_licence = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE) & F.col("own").isNotNull()
    licensed = rows.where(is_licence).groupBy("_dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own", "named")).alias("given"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    ladder = rows.select("_dir").where("_dir IS NOT NULL").distinct().select("_dir", F.inline(above))
    near = ladder.join(licensed.withColumnRenamed("_dir", "above"), "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    out = rows.join(near, "_dir", "left")
    return out.select(
        "doc_id", "path", "own", "cosine",
        F.coalesce("own", "near.given.own").alias("licence"),
        F.when(F.col("own").isNotNull(), F.lit("file")).otherwise(F.col("near.above")).alias("licence_from"),
        F.when(F.col("own").isNotNull(), F.col("named")).otherwise(F.col("near.given.named")).alias("licences"),
    )


def label(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, path, own, cosine, licence, licence_from, licences) of every row of ``files`` (doc_id, path, text, anything else).
    NULL and empty texts name no licence; repeated rows are labelled alike; an empty table gives none."""
    return inherit(stored(scan(files, fit(files, templates, least)), "licences"))
