"""Licence scan: sparse word n-gram logistic regression over paragraphs, calibrated, confirmed by templates.

Licence stems (the name without version and qualifiers) are learned from the phrases below with
generated variations; the unknown class from fixed lines and from paragraphs of a bounded sample of the
corpus (SAMPLE documents). Features are the word bigrams and trigrams of the stems' phrases, with short
names written out (GPL, CC BY, ...) and versions left out. Scores are calibrated by one temperature,
fitted on held-out paragraphs; a prediction counts only if it is not 'unknown', its calibrated
probability reaches LEAST_PROBABILITY, the paragraph holds most word n-grams of one of the stem's
phrases, and it is a heading or says that something is licensed. Version and qualifiers (Lesser, Affero,
NonCommercial, ...) are then read from the paragraph, or from the lines that follow it, and name the
family; without a version the family is the stem alone (GPL). SPDX lines are read as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import bound_batches, hash_sample

SAMPLE = 200
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.7
STEPS, RATE, DECAY = 300, 0.5, 1e-3
WORD = re.compile(r"[a-z0-9.]+[a-z0-9]|[a-z0-9]")

#: Notices and headings by stem (fixed values).
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "MIT licensed",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Apache License",
               "Apache Software License"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
            "GNU General Public License", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "MPL": ["Licensed under the Mozilla Public License", "Mozilla Public License",
            "This Source Code Form is subject to the terms of the Mozilla Public License"],
    "ISC": ["Licensed under the ISC License", "ISC License",
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD License",
            "BSD License"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License.", "Creative Commons Attribution"],
    "CC0": ["Licensed under CC0", "Creative Commons Zero", "dedicated to the public domain under Creative Commons Zero"],
    "proprietary": ["All rights reserved."],
}
#: Lines that speak of licences, rights and permissions and grant none.
NO_LICENCE = [
    "The museum is licensed under local law to serve drinks.", "Drivers must carry a valid license at all times.",
    "The council granted permission to use the hall for any purpose.", "Human rights groups reserved judgement on the new law.",
    "A fishing license is required under the terms of the state code.", "The bank was licensed under the act of 1986.",
    "They are free to use and distribute the leaflets without a license.", "Released under a new label, the record sold well.",
    "The software license fee rose again this year.", "Seats are reserved and all tickets are final.",
]
#: Every phrase above holds one of these, and so does every line that is looked at.
ANCHOR = re.compile(r"licen[cs]|spdx|gpl|\bmpl|cc[ -]+by|cc0|creative commons|rights reserved|hereby granted|permission to use|binary forms|apache[ -]+v?\d|bsd[ -]+\d|\d[ -]clause")
#: A paragraph that is no heading must say that something is licensed (names alone are also only talked about).
GRANT = re.compile(r"licensed|released|distributed|available|published|redistribut|covered|provided|permission|permitted|subject to|dedicated|under (?:the |a |an )?(?:terms|version|gnu|mozilla|apache|creative|[a-z0-9]+ license)|rights reserved|license:")
HEADING_WORDS = 8
VERSIONS = {"Apache": {"1.0", "1.1", "2.0"}, "GPL": {"1.0", "2.0", "3.0"}, "LGPL": {"2.0", "2.1", "3.0"}, "AGPL": {"1.0", "3.0"},
            "MPL": {"1.0", "1.1", "2.0"}, "CC": {"1.0", "2.0", "2.5", "3.0", "4.0"}, "CC0": {"1.0"}}
#: Where a stem's name begins; versions count from there on, or right before it ("version 2 of the GNU ...").
NAMES = {"Apache": r"apache", "GPL": r"gnu (?:(?:lesser|library|affero) )?general", "MPL": r"mozilla", "CC-BY": r"creative commons", "CC0": r"creative commons"}
#: Lines after a paragraph that are read for its version or clauses.
AFTER = 12
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
SPDX = re.compile(r"spdx-license-identifier\s*:\s*([^\n*]+)", re.I)
V = r"[\s,(-]*(?:version|ver\.?|v\.?)?\s*(\d(?:\.\d)?)?(?![\w]|\.\d)"


def normal(text: str) -> str:
    """Lower case, short names written out, one spelling of license and of the version."""
    t = re.sub(r"\blicence", "license", text.lower())
    said = lambda v: f" version {v}" if v else ""
    kinds = {"l": "lesser ", "a": "affero ", "": "", None: ""}
    t = re.sub(r"\b(?:gnu )?([la]?)gpl\b(?! license)" + V + r"|\b(?:gnu )?([la]?)gpl(?:v(\d(?:\.\d)?))?\b", lambda m: f"gnu {kinds[m[1] or m[3]]}general public license{said(m[2] or m[4])}", t)
    t = re.sub(r"\bmpl\b" + V, lambda m: f"mozilla public license{said(m[1])}", t)
    t = re.sub(r"\bapache[ -]v?(\d\.\d)", r"apache license version \1", t)
    t = re.sub(r"\bbsd[ -](\d)[ -]clause(?: license)?|\b(\d)[ -]clause bsd(?: license)?", lambda m: f"bsd license clauses{m[1] or m[2]}", t)
    t = re.sub(r"\bcc0\b(?:[ -]?(\d\.\d))?", lambda m: f"creative commons zero{said(m[1])}", t)
    parts = {"nc": " noncommercial", "sa": " sharealike", "nd": " noderivatives"}
    t = re.sub(r"\bcc[ -]+by((?:[ -]+(?:nc|sa|nd)\b)*)(?:[ -]*v?(\d\.\d))?",
               lambda m: "creative commons attribution" + "".join(parts[x] for x in re.findall("nc|sa|nd", m[1])) + said(m[2]), t)
    t = re.sub(r"\bnon-commercial", "noncommercial", re.sub(r"\bshare-alike", "sharealike", re.sub(r"\bno-?deriv(?:ative)?s(?: works)?\b", "noderivatives", t)))
    return re.sub(r"\b(license|attribution|noncommercial|sharealike|noderivatives)(?:,? (?:version |v\.? ?)?| v)(\d\.\d)\b", r"\1 version \2", t)


_LEFT_OUT = re.compile(r"\bversion\b|\bv?\d(?:\.\d)?\b|\b(?:lesser|library|affero|noncommercial|sharealike|noderivatives)\b|\bclauses\d\b")


def grams(paragraph: str) -> list[str]:
    """Word bigrams and trigrams of the written-out paragraph, without versions and qualifiers."""
    w = WORD.findall(_LEFT_OUT.sub(" ", normal(paragraph)))
    return [" ".join(w[i: i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]


def _versions(stem: str, name: str, line: str, after: str) -> list[str]:
    """Versions of ``name`` that the written-out line states, else those of the text after it."""
    start = re.search(NAMES[stem], line)
    if not start:
        return []
    found = re.findall(r"\bversion (\d(?:\.\d)?)\b", line[start.start():]) + re.findall(r"\bversion (\d(?:\.\d)?) (?:or later )?of (?:the )?$", line[: start.start()])
    found = found or re.findall(r"\bversion (\d(?:\.\d)?)\b", after)
    return sorted({v if "." in v else v + ".0" for v in found} & VERSIONS.get(name, VERSIONS.get(name.split("-")[0], set())))


def named(stem: str, paragraph: str, after: str = "") -> list[str]:
    """Families of a paragraph of ``stem``: its qualifiers and versions, if need be from the text ``after`` it."""
    line, near = normal(paragraph), normal("\n".join(after.split("\n")[:3]))
    if stem == "BSD":
        clauses = re.findall(r"clauses([0-9])", line)
        if not clauses and "binary forms" in line:
            rest = " ".join(normal(after).split())
            clauses = ["3"] if "neither the name" in rest else ["2"] if "binary form must reproduce" in rest else []
        return sorted({f"BSD-{c}-Clause" for c in clauses}) or ["BSD"]
    if stem == "ISC":
        whole = f"{line} {near}"
        return ["ISC" if "isc " in line or "provided that" in whole or "hereby granted" not in whole else "0BSD"]
    if stem not in NAMES:
        return [stem]
    name = stem
    if stem == "GPL":
        kind = re.search(r"gnu (lesser|library|affero)", line)
        name = ("A" if kind[1] == "affero" else "L") + "GPL" if kind else "GPL"
    elif stem == "CC-BY":
        name += "".join(x for x, w in (("-NC", "noncommercial"), ("-SA", "sharealike"), ("-ND", "noderivatives")) if re.search(rf"\b{w}", line))
    return [f"{name}-{v}" for v in _versions(stem, name, line, near)] or [name]


def spdx(paragraph: str) -> list[str]:
    """Families of an SPDX line: the identifiers of its expression, without -only, -or-later, + and exceptions."""
    out = set()
    for m in SPDX.finditer(paragraph):
        for x in re.findall(r"(?i)(?<!\S)[A-Z0-9][\w.+-]*", re.sub(r"(?i)\bwith\s+\S+", " ", m[1].replace("(", " ").replace(")", " "))):
            if x.upper() not in ("AND", "OR", "NONE", "NOASSERTION"):
                out.add(re.sub(r"(?i)-only$|-or-later$|\+$", "", x))
    return sorted(out)


def _variations(rng) -> list[tuple[str, int]]:
    out = []
    for k, family in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[family]:
            w = t.split()
            for _ in range(12):
                drop = set(rng.choice(len(w), max(0, len(w) // 8), replace=False).tolist())
                out.append((" ".join(x for i, x in enumerate(w) if i not in drop), k))
            out.append((t, k))
    return out


class Model:
    """Weights of the known n-grams and the calibration temperature."""

    def __init__(self, negatives: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        rows = _variations(rng) + [(p, 0) for p in [*negatives, *NO_LICENCE]] + [("", 0)] * 10
        order = rng.permutation(len(rows))
        rows = [rows[i] for i in order]
        self.index = {g: i for i, g in enumerate(sorted({g for p, k in rows if k for g in grams(p)}))}
        x, y = np.stack([self.vector(p) for p, _ in rows]), np.array([k for _, k in rows])
        held = np.arange(len(rows)) % 5 == 0
        self.w, self.b, self.t = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0
        one = np.eye(len(FAMILIES))[y[~held]]
        weight = (1 / np.maximum(np.bincount(y[~held], minlength=len(FAMILIES)), 1))[y[~held]][:, None]
        for _ in range(STEPS):
            d = (self._softmax(x[~held] @ self.w + self.b) - one) * weight
            self.w -= RATE * (x[~held].T @ d + DECAY * self.w)
            self.b -= RATE * d.sum(0)
        z = x[held] @ self.w + self.b
        loss = lambda t: -np.log(self._softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean()
        self.t = min(np.geomspace(0.05, 5, 40), key=loss)
        self.templates = {f: [set(grams(t)) for t in ts] for f, ts in TEMPLATES.items()}

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def vector(self, p: str) -> np.ndarray:
        v = np.zeros(len(self.index))
        for g in grams(p):
            if g in self.index:
                v[self.index[g]] = 1
        return v

    def stem(self, paragraph: str) -> tuple[str, float, float]:
        """(stem, calibrated probability, best phrase overlap); unknown if not confirmed."""
        have = set(grams(paragraph))
        known = [self.index[g] for g in have if g in self.index]
        prob = self._softmax((self.w[known].sum(0) + self.b) / self.t)
        stem = FAMILIES[int(prob.argmax())]
        if stem == UNKNOWN or not known:
            return UNKNOWN, float(prob[0]), 0.0
        overlap = max(len(have & t) / len(t) for t in self.templates[stem])
        text = normal(paragraph)
        sure = (prob.max() >= LEAST_PROBABILITY and overlap >= LEAST_OVERLAP
                and (len(WORD.findall(paragraph.lower())) <= HEADING_WORDS or GRANT.search(text) is not None))
        return (stem if sure else UNKNOWN), float(prob.max()), overlap

    def families(self, paragraph: str, after: str = "") -> list[str]:
        """Families the paragraph names (none: unknown); ``after`` is the text that follows it."""
        declared = spdx(paragraph)
        if declared or SPDX.search(paragraph):
            return declared
        stem = self.stem(paragraph)[0]
        return [] if stem == UNKNOWN else named(stem, paragraph, after)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family, calibrated probability, best phrase overlap) of a paragraph that stands alone; unknown if not confirmed."""
        stem, probability, overlap = self.stem(paragraph)
        return (self.families(paragraph) or [UNKNOWN])[0], probability, overlap


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Unknown paragraphs: the first line, whole, of documents: ``sample`` different ones (least by hash), none of which names a licence."""
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    rows = docs.select(line.alias("p")).where(~F.col("p").rlike("(?i)licen|rights|permi|redistrib|copyright"))
    return Model(sorted(r.p for r in hash_sample(rows, sample, "p").collect()))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, families (sorted), n_paragraphs (licence paragraphs), lines (their line numbers), found.

    Paragraphs are \\n-separated lines of the whole text; a notice broken over two lines counts at its
    first. A line without any anchor is unknown. Null and empty texts have none. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[str]] = {}

        def known(p: str, after: str = "") -> list[str]:
            if len(seen) > 50_000:
                seen.clear()
            if (p, after) not in seen:
                seen[p, after] = model.families(p, after)
            return seen[p, after]

        for batch in batches:
            fam, lines = [], []
            for text in batch.column(1):
                f, at = set(), []
                text = text.as_py() or ""
                # line breaks inside an anchor count as blanks
                hit = {text.count("\n", 0, m.start()) for m in ANCHOR.finditer(text.lower().replace("\n", " "))} if text else set()
                parts = text.split("\n") if hit else []
                alone = {i: known(parts[i], "\n".join(parts[i + 1: i + 1 + AFTER])) for i in hit if i < len(parts)}
                found = {i: x for i, x in alone.items() if x}
                for i in sorted({j for h in hit for j in (h - 1, h) if 0 <= j < len(parts) - 1}):
                    if not {i - 1, i, i + 1} & set(found):  # neither line names a licence: both together may
                        x = known(parts[i] + " " + parts[i + 1], "\n".join(parts[i + 2: i + 2 + AFTER]))
                        if x:
                            found[i] = x
                for i in sorted(found):
                    f.update(found[i])
                    at.append(i)
                fam.append(sorted(f))
                lines.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fam, pa.list_(pa.string())), pa.array([len(x) for x in lines], pa.int64()),
                 pa.array(lines, pa.list_(pa.int32()))], ["doc_id", "families", "n_paragraphs", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, families array<string>, n_paragraphs bigint, lines array<int>")
