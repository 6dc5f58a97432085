"""The operators of the llm subpackage against brute force, the library or held-out truth, and on edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimscope.llm import (chat_format, decontaminate, language, licences, near_dedup, paragraph_dedup, pieces, pii,
                            quality_rules, similarity, substring_dedup)
from claimscope.llm.common import least_pairs, prefix_pairs, prefix_side, table

WORDS = [f"w{i}{'abcdefg'[i % 7]}" for i in range(400)]


def prose(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n)) + "."


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, near copies, clashing column names."""
    near = prose(1).replace(prose(1).split()[60], "changed", 1)
    rows = [(1, prose(1)), (2, prose(1)), (3, near), (4, prose(2)), (4, prose(2)), (5, None), (6, ""), (None, prose(3)), (7, "x"),
            (8, None), (9, "ab" * 4000 + " tail"), (10, prose(4, 6000)), (11, " \n\t"), (12, "mail a.b@c.example.org or +1 (415) 555-0100, 4111111111111111 or 10.0.0.1 now")]
    return spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id bigint, text string, n_words int, key string, tag int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").where("length(text) < 6000")


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + 200] for b in raws for i in range(len(b) - 199))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                cover[i:i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *w)) for r, w in zip(rows, brute_repeats([r.text for r in rows])))
    assert sorted(str(tuple(r)) for r in substring_dedup.remove_repeats(df).collect()) == want


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_substring_dedup_counts_large_groups_by_digests(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *w)) for r, w in zip(rows, brute_repeats([r.text for r in rows])))
    monkeypatch.setattr(substring_dedup, "GROUP", 1)
    assert sorted(str(tuple(r)) for r in substring_dedup.remove_repeats(df).collect()) == want


def test_interval_groups_hold_all_occurrences():
    a = b"q" + bytes(range(1, 251)) + b"z"
    found = substring_dedup.interval_groups([a, b"p" + a[1:], a[1:251] + b"y"])
    assert max(size for size, _ in found) == 251 and any(len(at) == 3 and size == 250 for size, at in found)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_classes(rows):
    sets = []
    for r in rows:
        w = words_of(r.text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", r.text or "")})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for a, b in {p for l in by.values() for p in itertools.combinations(l, 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


def test_near_dedup_classes(docs):
    rows = docs.select("doc_id", "text").collect()
    least = {}
    for r, c in zip(rows, brute_classes(rows)):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: least[c] for r, c in zip(rows, brute_classes(rows))}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert sum(got[i] != want[i] for i in want) <= 1  # repeated shingles weigh in


def test_near_dedup_edges(spark, edge):
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(edge).collect())
    assert got[2, 1] == got[3, 1] == 1 and got[4, 4] == 2 and got[8, 5] == got[6, 5] == 1
    kept = near_dedup.keep_one(edge)
    assert kept.schema == edge.schema and Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, None, 7, 9, 10, 11, 12])
    assert near_dedup.classes(edge.limit(0)).count() == 0


def test_near_dedup_classes_that_share_a_doc_id(spark):
    """Unrelated texts under null doc_ids, and under one repeated doc_id, are classes of their own."""
    near = prose(41).replace(prose(41).split()[60], "changed", 1)
    rows = [(None, prose(41)), (None, near), (None, prose(42)), (None, prose(43)), (7, prose(44)), (7, prose(45)), (None, prose(45)),
            (8, prose(46)), (7, prose(46)), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()]
    assert Counter(d for d, _ in kept) == Counter([None, None, None, 7, 7, 7, 9])
    assert len({t for _, t in kept} & {prose(41), near}) == 1
    assert {t for d, t in kept if d is None} - {prose(41), near} == {prose(42), prose(43)}
    assert {t for d, t in kept if d == 7} == {prose(44), prose(45), prose(46)}
    got = Counter((r.class_key, r.class_id) for r in near_dedup.classes(docs).collect())
    assert sorted((c is None, c, n) for (_, c), n in got.items()) == [(False, 7, 1), (False, 7, 2), (False, 7, 2), (False, 9, 2), (True, None, 1), (True, None, 1), (True, None, 2)]


def test_near_dedup_of_varied_copies(spark):
    """A group of copies so varied that no hub links to all: the classes equal those of all pairs."""
    r = random.Random(5)
    base, rows = prose(31, 150).split(), []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(len(w)), r.randint(1, 10)):
            w[k] = f"z{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = defaultdict(set), defaultdict(set)
    for x, c in zip(rows, brute_classes(docs.collect())):
        want[c].add(x[0])
    for x in near_dedup.classes(docs).collect():
        got[x.class_id].add(x.doc_id)
    assert 3 < len(want) < 150
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_prefix_pairs_lose_no_similar_pair(spark):
    r = np.random.default_rng(3)
    units = r.integers(1, 4, (40, 30)) * (r.random((40, 30)) < 0.9)
    units[20:] = np.maximum(units[:20] + (r.random((20, 30)) < 0.1) - (r.random((20, 30)) < 0.1), 0)
    grams = spark.createDataFrame([(bytes([i]), int(g), int(w)) for i, u in enumerate(units) for g, w in enumerate(u) if w], similarity.GRAMS)
    sets = spark.createDataFrame([(bytes([i]), np.flatnonzero(u).astype(np.uint64).tobytes(), u[u > 0].astype(np.uint32).tobytes()) for i, u in enumerate(units)], similarity.SETS)
    comps = sets.mapInArrow(similarity.set_bits, similarity.BIT_SCHEMA).selectExpr("*", "key AS comp")
    side = prefix_side(comps, grams, 0.6)
    got = {(x.a[0], x.b[0]) for x in prefix_pairs(side, 0.6).collect()}
    assert {(x.a[0], x.b[0]) for x in least_pairs(side, 0.6).collect()} <= got
    want = {(i, j) for i in range(40) for j in range(i) if similarity.probability_jaccard(units[i].astype(float), units[j].astype(float)) >= 0.6}
    assert want and want <= got


def test_probability_jaccard_against_definition():
    r = np.random.default_rng(0)
    for _ in range(20):
        x, y = r.integers(0, 4, 12).astype(float), r.integers(0, 4, 12).astype(float)
        a, b = x / x.sum(), y / y.sum()
        want = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(12)) for i in range(12) if a[i] and b[i])
        assert similarity.probability_jaccard(x, y) == pytest.approx(want)


def test_paragraph_dedup(spark):
    near = prose(7, 60).replace("w", "v", 1)
    rows = [(1, "alpha beta\n" + prose(7, 60)), (2, prose(8, 60) + "\n" + near), (3, prose(9, 60)), (4, None), (5, ""), (6, prose(7, 60)), (6, prose(7, 60))]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, line int")
    got = sorted((r.doc_id, r.line, r.class_doc_id, r.class_line, r.removed) for r in paragraph_dedup.repeated_paragraphs(df).collect() if r.n_lines)
    assert got[0] == (1, 1, 1, 1, False) and got[1] == (2, 1, 1, 1, True) and len(got) == 4 and all(g[4] for g in got[1:])
    assert paragraph_dedup.repeated_paragraphs(df.limit(0)).count() == 0


def test_paragraph_dedup_of_short_and_wrapped_lines(spark):
    """Short lines are compared, a wrapped copy meets its single line, one row of a repeated head stays."""
    w = prose(51, 60).split()
    wrapped = "\n".join(" ".join(w[i:i + 8]) for i in range(0, 60, 8))
    long = " ".join(prose(52, 30).split())
    twice = "\n".join([" ".join(prose(55, 20).split()), "ends here"])  # its run is near its own first line
    rows = [(1, "Read more\n\n" + " ".join(w)), (2, "Read more\n\n" + wrapped), (3, "\nread  MORE!"), (4, long), (4, long), (5, twice)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.line, r.n_lines, r.class_doc_id, r.class_line, r.removed) for r in paragraph_dedup.repeated_paragraphs(df).collect() if r.n_lines)
    assert got == Counter([(1, 2, 1, 1, 2, False), (2, 2, 8, 1, 2, True), (4, 0, 1, 4, 0, False), (4, 0, 1, 4, 0, True)])
    short = {(r.doc_id, r.line) for r in paragraph_dedup.repeated_short_lines(df).collect()}
    assert short == {(1, 0), (2, 0), (3, 1)}


def test_short_lines_count_beside_a_repeated_paragraph(spark):
    rows = [(1, "Same title\n" + prose(71, 40) + "\nother end"), (2, "Same title\n" + prose(71, 40)), (3, "x y\n\nSame title"), (4, prose(72, 40))]
    got = {(r.doc_id, r.line) for r in paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.n_lines}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_passages_inside_other_paragraphs(spark, sf):
    """Planted passages of 52 words and more in other lines, and the documents of a table that share one: found, others left alone."""
    r = random.Random(2)
    some = lambda n: " ".join(f"u{r.randint(0, 9999)}" for _ in range(n))
    rows, planted = [], set()
    for k in range(60):
        passage = some(r.randint(52, 90))
        for _ in range(2):
            planted.add(len(rows))
            rows.append((len(rows), some(r.randint(0, 40)) + " " + re.sub(r" ", lambda m: r.choice(["  ", "\n", " ", ", "]), passage) + " " + some(r.randint(0, 40))))
        rows.append((len(rows), some(100)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id for x in paragraph_dedup.repeated_paragraphs(df).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted)
    kept = paragraph_dedup.repeated_passages(df).where("not removed").count()
    assert kept * 2 == paragraph_dedup.repeated_passages(df).count()

    docs = [(x.doc_id, words_of(x.text)) for x in table(spark, sf, "documents").collect()]
    seen = defaultdict(set)
    for d, w in docs:
        for i in range(len(w) - 49):
            seen[tuple(w[i:i + 50])].add(d)
    sharing = {d for at in seen.values() if len(at) > 1 for d in at}
    got = {x.doc_id for x in paragraph_dedup.repeated_paragraphs(table(spark, sf, "documents")).collect()}
    assert len(got & sharing) >= 0.95 * len(sharing)


BASE_PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_pii_patterns_never_retry():
    """The same spans as the plain patterns on signs in any order, and no more than linear time on long runs."""
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice("aZ_.-@@+ 00012459..()x") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)
    import time
    n = 1_000_000
    at = time.perf_counter()
    for text in ("1" * n, "1." * (n // 2), "a" * n + "@", "a@" * (n // 2), "+" + "(" * n, "a@b" + ".c" * n, "1 " * n, "0" * 5_000 + "1.2.3.4", "1.2.3." + "9" * n, "+1" * (n // 2)):
        pii.base_spans(text)
    assert time.perf_counter() - at < 30
    assert pii.base_spans("0" * 5_000 + "1.2.3.4") == [(0, 5_007, 1)]


def brute_spans(text):
    out = []
    for k, p in enumerate(BASE_PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn
                    or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii(spark, edge, docs):
    df = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    texts = Counter((r.doc_id, pii._said(brute_spans(r.text or ""))) for r in df.collect())
    got = pii.personal_data(df).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter({(d, hashlib.sha256(s.encode()).hexdigest()): n for (d, s), n in texts.items()})
    said = {hashlib.sha256(s.encode()).hexdigest(): s for _, s in texts}
    assert all({x for x in said[r.base_sha256].split(",") if x} <= set(r.spans.split(",")) for r in got)
    clean = {r.doc_id: r.text for r in pii.redact(edge).collect()}
    assert clean[5] is None and clean[12].startswith("mail [EMAIL] or [PHONE], [CARD] or [IP]")
    assert pii.personal_data(edge.limit(0)).count() == 0


def test_pii_gradients():
    r = np.random.default_rng(0)
    x, y, p = r.integers(0, 96, (3, 7)), r.integers(0, pii.TAGS, (3, 7)), pii.initial()
    _, g = pii.loss_gradients(p, x, y)
    for k in p:
        at = tuple(r.integers(0, s) for s in p[k].shape) if k != "E" else (x[0, 0], 2)
        keep, e = p[k][at], 1e-5
        p[k][at] = keep + e
        up = pii.loss_gradients(p, x, y)[0]
        p[k][at] = keep - e
        down = pii.loss_gradients(p, x, y)[0]
        p[k][at] = keep
        assert (up - down) / 2 / e == pytest.approx(g[k][at], abs=1e-6)


def test_decontamination(spark, edge):
    bench = spark.createDataFrame([(1, " ".join(prose(4, 6000).split()[50:62])), (2, "tail"), (3, None), (4, "no such words here at all"), (None, "x")],
                                  "item_id bigint, text string")
    got = {(r.doc_id, r.n_hit): r for r in decontaminate.contamination(edge, bench).collect()}
    assert (10, 12) in got and (9, 1) in got and (7, 1) in got and (5, 0) in got
    assert got[10, 12].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[7, 1].n_items == 0
    assert decontaminate.drop_contaminated(edge, bench).count() == 11
    assert decontaminate.contamination(edge.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(edge, bench.limit(0)).collect())
    swapped = spark.createDataFrame([(1, " ".join(["w1b", *prose(4, 6000).split()[50:61]]))], "item_id bigint, text string")
    assert decontaminate.matches(edge, swapped, slop=1).where("not exact").count() > 0


def test_licences(spark, docs):
    truth = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r.doc_id: r.families for r in licences.scan(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == sorted({truth[x] for x in r.text.split("\n") if x in truth})
    model = licences.train(docs)
    assert model.classify("Licensed under the Apache License Version 2.0")[0] == "Apache-2.0"
    assert model.classify("The museum is licensed under local law to serve drinks.")[0] == "unknown"


HELD_OUT = {
    "The MIT License (MIT)": ["MIT"], "GNU GENERAL PUBLIC LICENSE": ["GPL"], "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
    "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT)": ["GPL-2.0", "MIT"],
    "Licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "Code is under the GPLv3 license.": ["GPL-3.0"],
    "Licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1"], "Available under the AGPL-3.0.": ["AGPL-3.0"],
    "Distributed under the terms of the Mozilla Public License, v. 2.0.": ["MPL-2.0"], "You may use it under version 2 of the GNU General Public License": ["GPL-2.0"],
    "This file is distributed under the BSD 2-Clause License": ["BSD-2-Clause"], "Distributed under the ISC license": ["ISC"],
    "Text is available under the Creative Commons Attribution-ShareAlike 3.0 License": ["CC-BY-SA-3.0"], "Photos: CC BY-ND 4.0": ["CC-BY-ND-4.0"],
    "Foo version 2.0 is released under the GNU General Public License": ["GPL"],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991": ["GPL-2.0"],
    "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or": ["GPL-3.0"],
    "This program comes with no promise and is licensed under the GNU General\nPublic License, version 3.": ["GPL-3.0"],
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that\n"
    "2. Redistributions in binary form must reproduce the above": ["BSD-2-Clause"],
    "The conference debated the GNU General Public License for hours before lunch was served": [],
    "A driving license is issued under the terms of the road act.": [], "The committee reserved all rights of reply for members.": [],
}


def test_licences_held_out(spark, docs):
    """Wording that is no template: headings, SPDX lines, wrapped notices, sibling licences and versions."""
    assert not {t for ts in licences.TEMPLATES.values() for t in ts} & set(HELD_OUT)
    assert all(licences.ANCHOR.search(t.lower()) for ts in licences.TEMPLATES.values() for t in ts)
    rows = [(-1 - i, f"Some prose about a town.\n{t}\nMore prose.") for i, t in enumerate(HELD_OUT)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.families for r in licences.scan(df).collect()}
    assert {t: got[-1 - i] for i, t in enumerate(HELD_OUT)} == HELD_OUT


def test_language(spark, sf):
    pages = table(spark, sf, "pages")
    rows = language.identify(pages, table(spark, sf, "documents")).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(urls)
    right = sum(f"/{r.lang}/" in urls[r.page_id] for r in rows)
    assert right >= 0.9 * len(rows)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", "", "y")], "page_id bigint, url string, html string, host string")
    assert language.identify(odd, table(spark, sf, "documents")).count() == 2


def test_pieces_equal_the_library(docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in docs.limit(60).collect()] + ["a  b\n\tc  \x00y  ", " ", "日本語 😀😀 é", "aaaa abababab", "x" * 500]
    encoder = pieces.Encoder(pieces.MODEL)
    for t, ids in zip(texts, encoder(texts)):
        assert ids.tolist() == sp.encode(t) and pieces.decode_ids(ids, encoder.v) == t
    odd = "▁x ▁▁"
    assert pieces.decode_ids(encoder([odd])[0], encoder.v) == odd


def test_pieces_edges(edge):
    rows = pieces.encode(edge).collect()
    assert len(rows) == edge.count() and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    assert pieces.encode(edge.limit(0)).count() == 0


def test_quality_rules(edge, docs):
    for df in (edge, docs):
        want = []
        for r in df.select("doc_id", "text").collect():
            t = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            tri = Counter(zip(w, w[1:], w[2:]))
            marked = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
            want.append(str((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked),
                             len(w) < 50 or 100 * len(marked) > 50 * len(w))))
        assert sorted(str(tuple(r)[:7]) for r in quality_rules.measure(df).collect()) == sorted(want)
    out = quality_rules.clean(edge)
    assert out.schema == edge.schema and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None, 10}


def test_chat_tree(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "a</s>\\-b"), (2, 0, "user", "hello"), (2, 1, "assistant", "other"),
            (3, 0, "user", "hello"), (4, 0, None, None), (5, 1, "assistant", "x"), (5, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("none", "start")
    nodes, paths = chat_format.prefix_tree(df.unionByName(chat_format.special_conversation(df)))
    got = {r.conv_id: r for r in chat_format.read_back(nodes, paths).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(b"a</s>\\-b").hexdigest() and got[4].n_turns == 1 and got[5].loss_chars == 2
    assert got[-1].turns_sha256 == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    tree = nodes.collect()
    by = {r.node: r for r in tree}
    assert sum(r.formatted.count("hello") for r in tree) == 1
    assert not any("</s>" in r.formatted or "[INST]" in r.formatted for r in tree)
    for r in tree:  # nested intervals: a parent's holds its child's, and positions follow the path
        if r.parent:
            p = by[r.parent]
            assert p.start < r.start and r.subtree_end <= p.subtree_end and r.position == p.position + p.n_tokens
    spans = sorted((r.start, r.start + r.n_tokens) for r in tree)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pipeline(spark, sf):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_index_of_sets_equals_dense_vectors():
    r = np.random.default_rng(1)
    for _ in range(50):
        x, y = r.integers(0, 4, 30) * (r.random(30) < 0.6), r.integers(0, 4, 30) * (r.random(30) < 0.6)
        pack = lambda v: (np.flatnonzero(v).astype(np.uint64) * np.uint64(7), v[v > 0].astype(np.uint32))
        assert similarity.index_of(*pack(x), *pack(y)) == pytest.approx(similarity.probability_jaccard(x.astype(float), y.astype(float)))


def test_stages_with_clashing_names_and_empty_tables(spark, sf):
    """Columns named like everything the stages use inside come back as they were; an empty table stays empty."""
    import corpus_pipeline
    names = ["_rep", "_key", "h_doc", "h_tag", "key", "comp", "rep", "row", "of", "id", "tag", "at", "ids", "n_words", "start", "spans", "rows", "n_chars"]
    rows = [(i, prose(60 + i % 4), *range(len(names))) for i in range(6)] + [(None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        for table_ in (docs, docs.limit(0)):
            out = stage(spark, table_, sf).collect()
            assert len(out) <= len(rows) and (table_ is docs) == bool(out)
            if name != "sentencepiece" and out:
                assert all(r[n] == i or n == "n_chars" for r in out for i, n in enumerate(names))


def test_words_relaxed_together_equal_words_one_by_one():
    v = pieces.vocabulary(pieces.MODEL)
    r = random.Random(1)
    words = [" " * r.randint(0, 3) + "".join(r.choice("abehtionsTIéüß漢😀▁\x00.,0129-ñçœ\n") for _ in range(r.randint(1, 14))) for _ in range(5000)]
    words += [" ", " " * 5, "the", "x" * 700, " " + "漢字" * 200]
    assert [x.tolist() for x in pieces.encode_words(words, v)] == [x.tolist() for x in pieces.encode_long_words(words, v)]


def test_pii_decoding_holds_few_states():
    """Decoding keeps nothing for a backward pass and reads a bounded number of windows at once, with the same tags as the training pass."""
    import tracemalloc

    p, texts = pii.initial(), [f"call +1 202 555 01{i % 90 + 10} or write to a{i}@b.org, " * 3 for i in range(1500)]
    x = np.random.default_rng(5).integers(0, 96, (40, pii.WINDOW))
    assert np.array_equal(pii.emissions(p, x)[0], pii.emissions(p, x, training=False)[0])
    pii.find(texts[:10], p)
    tracemalloc.start()
    found = pii.find(texts, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and peak < 64 << 20
    assert pii.find(texts[:3], p) == found[:3]
