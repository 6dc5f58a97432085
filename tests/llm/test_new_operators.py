"""Periodic runs, fill-in-the-middle and wrapper extraction against brute force, exact round trips and planted pages."""

import hashlib
import html
import random
import re
import zlib

import pytest

from claimscope.llm import catalog, fill_middle, periodic_runs, wrappers
from claimscope.llm.common import table

SCHEMA = "doc_id bigint, text string, n int, h1 long, form string, runs int, host string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "psm", 3, "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "the the"), (None, "a b " * 30), (4, "x " * 24), (4, "x " * 24), (5, "x " * 23), (6, "1,2 <P> z"),
            (7, "tail <M>"), (8, "<S"), (9, ">ü–漢字<"), (10, "né " * 9 + "漢 字 " * 20 + "né " * 30), (11, "w" * 300_000 + " end"),
            (12, " ".join(r.choice("abcdefgh") for _ in range(60_000))), (13, "very long run " * 40_000), (14, "<<P" + ">" * 3), (15, " a b " * 12)]
    rows += [(100 + k, " ".join(r.choice("abc") * r.randint(1, 2) for _ in range(r.randint(0, 90))) * r.randint(1, 5)) for k in range(200)]
    return frame(spark, rows)


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        j = 0
        while j + q < len(w):
            s = j
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - s >= max(24, 3 * q) and j > s:
                found.setdefault((s, j + q), q)
            j += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    top = None
    for s, length, q in found:
        if top is None or length * top[2] > top[1] * q:
            top = (s, length, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_periodic_runs(request, spark, sf, which):
    df = request.getfixturevalue("edge") if which == "edge" else table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect() if len((r.text or "").split()) < 3000]  # the brute force is square in the words
    got = periodic_runs.report(periodic_runs.collapse_runs(df, plant=True)).collect()
    assert len(got) == df.count()
    small = {d for d, _ in rows}
    assert sorted(str(tuple(r)) for r in got if r.doc_id in small) == sorted(str(brute_report(*r)) for r in rows)


def test_periodic_runs_of_very_long_texts(edge):
    got = {r.doc_id: r for r in periodic_runs.collapse_runs(edge).where("doc_id in (11, 13)").collect()}
    assert got[11].runs == [] and [tuple(r) for r in got[13].runs] == [(0, 120_000, 3)] and got[13].collapsed == "very long run"
    assert periodic_runs.report(periodic_runs.collapse_runs(edge.limit(0))).count() == 0


def test_suffixes_part_at_one_place_only():
    """Many runs that end at one word: each is found once, by its least period."""
    unit = ["a"] * 30 + ["b"]
    ids = {"a": 0, "b": 1}
    import numpy as np
    w = unit * 4 + ["c"] + ["a", "b"] * 20
    flat = np.array([ids.get(x, 2) for x in w], np.int64)
    s, e, q = periodic_runs.runs(flat, np.zeros(len(w), np.int64), np.array([len(w)]))
    assert [(a, b - a, c) for a, b, c in zip(s.tolist(), e.tolist(), q.tolist())] == brute_runs(w)


def brute_middle(doc_id, text):
    t = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    h = [int(sha("1:" + ("" if doc_id is None else str(doc_id)))[8 * k: 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, t
    out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return doc_id, len(w), out[0], len(pre), len(mid), out[1]


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_fill_middle(request, spark, sf, which):
    df = request.getfixturevalue("edge") if which == "edge" else table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    made = fill_middle.transform(df)
    assert sorted(str(tuple(r)) for r in made.collect()) == sorted(str(brute_middle(*r)) for r in rows)
    back = fill_middle.restore(made).collect()
    assert sorted(str((r.doc_id, r.restored)) for r in back) == sorted(str((d, t or "")) for d, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_restore_refuses_other_outputs(spark, edge):
    rows = [("psm", "<P>a<S>b<M>c"), ("spm", "<S>a<P>b<M>c"), ("psm", "<S>a<P>b<M>c"), ("psm", "a<S>b<M>c"), ("spm", ""), (None, "x"), ("plain", None),
            ("psm", "<P><S><M>"), ("other", "x"), ("psm", "<P>a<S>b<M>c<M>")]
    df = spark.createDataFrame(rows, "form string, output string").coalesce(1)
    assert [r.restored for r in fill_middle.restore(df).collect()] == ["acb", "bca", None, None, None, None, "", "", None, None]
    assert fill_middle.restore(fill_middle.transform(edge.limit(0))).count() == 0


# ---- pages

def article_only(page):
    """What the made pages hold, read by their one article element."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner[1])] if inner else []
    return "\n\n".join(x for x in out if x)


def test_extraction_of_the_pages_table(spark, sf):
    rows = table(spark, sf, "pages").collect()
    got = {r.page_id: r for r in catalog.op13_html_extraction(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].text, got[r.page_id].url) == (article_only(r.html), r.url) and got[r.page_id].n_chars == len(got[r.page_id].text)


def words(r, n):
    return " ".join("".join(r.choice("aeioustrnm") for _ in range(r.randint(2, 9))) for _ in range(n))


def page(r, kind, k):
    """(html, main text) in one of three templates; parts come and go from page to page."""
    paragraphs = [words(r, r.randint(5, 60)) for _ in range(r.randint(1, 6))]
    body = "".join(f"<p>{p[:20]}<b>{p[20:]}</b></p>" if r.random() < 0.5 else f"<p>{p}" for p in paragraphs)
    blocks = list(paragraphs)
    if r.random() < 0.4:
        at = r.randint(0, 1)
        cells = [words(r, 3) for _ in range(4)]
        body += f"<h2>{words(random.Random(k), 3)}</h2><table><tr><td>{cells[0]}<td>{cells[1]}<tr><td>{cells[2]}</td><td>{cells[3]}</table>" if at else \
            f"<ul><li>{cells[0]}<li><i>{cells[1]}</i></ul>"
        blocks += [words(random.Random(k), 3), *cells] if at else cells[:2]
    if r.random() < 0.3:
        body += f"<div class='ad-slot'>{words(r, 30)}</div>"
    if r.random() < 0.3:
        body += "<form><p>Name</p><input name=a><textarea><p>x</textarea><button>Send</button></form>"
    if r.random() < 0.5:
        body += f"<p>Fish &amp; chips &lt;b&gt; caf&eacute;&nbsp;&#8364;5</p><script>document.write('<p>{words(r, 4)}</p>')</script>"
        blocks.append("Fish & chips <b> café €5")
    comments = "".join(f"<div class=comment><p>{words(r, 40)}</p></div>" for _ in range(r.randint(0, 4)))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{words(r, 1)}</a></li>" for i in range(r.randint(2, 9))) + "</ul>"
    if kind == "article":
        text = f"<header><a href=/>{words(r, 2)}</a></header><nav>{menu}</nav><main><article class='post no-sidebar'>{body}</article><section id=comments>{comments}</section></main><aside>{words(r, 80)}</aside>"
    elif kind == "div":
        text = f"<div id=top-menu>{menu}</div><div class='wrap'><div class='cookieNotice'>We use cookies {words(r, 20)}</div><div class=story>{body}</div><div class=sidebar>{words(r, 50)}</div></div><div class=comments>{comments}</div>"
    else:
        text = f"<div>{menu}</div><div><div>{body}</div></div><div>Always the same line</div>"
    foot = "<footer>&copy; someone</footer></body></html>" if r.random() < 0.7 else ""
    return f"<!doctype html><html><head><title>{words(r, 3)}</title><style>p{{}}</style></head><body>{text}{foot}", "\n\n".join(blocks)


def test_extraction_with_other_templates(spark):
    r = random.Random(8)
    rows, want = [], {}
    for k in range(240):
        kind = ["article", "div", "bare"][k % 3]
        made, want[k] = page(r, kind, k)
        rows.append((k, f"https://user@{kind}.example.org:8080/{k}?a=b", made))
    got = {x.page_id: x.text for x in wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert {k: t for k, t in got.items()} == want


def test_extraction_edges(spark):
    deep = "<div>" * 5000 + "low" + "</div>" * 5000
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "<article><p>one"), (3, "http://a/", "<article><p>one"), (None, "http://a/", "<article>b &am"),
            (4, "HTTP://A:80", "plain text"), (5, "http://b/", deep), (6, "http://b/", "<p>" + "long text " * 300_000), (7, "http://c/", "<article"), (8, "http://c/", "<!-- <p>x"),
            (9, "http://d/", "<article><p title=\"a > b\">t</p>\n <script>x</script>"), (10, "http://d/", "<script><article>x"), (11, "http://e/", "a < b </> <3"), (12, "http://e/", '<a href="x>y <p>z')]
    df = spark.createDataFrame([(*x, "h", "w", 1) for x in rows], "page_id bigint, url string, html string, host string, wrapper string, slots int")
    out = wrappers.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text[:30], r.n_chars) for r in out.collect()))
    assert got == [(0, "b &am", 5), (1, "", 0), (2, "", 0), (3, "one", 3), (3, "one", 3), (4, "plain text", 10), (5, "low", 3), (6, ("long text " * 3), 2_999_999),
                   (7, "", 0), (8, "", 0), (9, "t", 1), (10, "", 0), (11, "a < b <3", 8), (12, "y", 1)]
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_wrappers_accept_every_page_and_keep_every_text():
    r = random.Random(2)
    names = "div p ul li a b span article nav table tr td section h2 br hr form".split()
    part = lambda: (lambda f: f.replace("%", r.choice(names)))(r.choice(["<%>", "<%>", "</%>", "<% class='ad'>", "<", "&amp;", "t ", "u", "<!-- c -->", '"']))

    def texts(children):
        for c in children:
            if c[0] is not None:
                yield from texts(c[1])
            elif not c[1].isspace():
                yield c[1]

    for _ in range(400):
        trees = [wrappers.tree("".join(part() for _ in range(r.randint(0, 60)))) for _ in range(3)]
        wrapper = wrappers.expression(trees[0])
        for t in trees[1:]:
            wrapper = wrappers.align(wrapper, wrappers.expression(t))
        for t in trees:
            read = [x for x in wrappers.read(t, wrappers.Model(wrapper))]
            assert [x[1] for x in read] == list(texts(t)) and not any("?" in x[0] for x in read)
