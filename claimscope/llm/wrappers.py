"""Main text of web pages by inferred wrappers: one union-free regular expression over the token stream of a host's pages.

A page's tokens (block tags with their class words; text) are made well nested. Equal neighbours, single or in groups,
are folded into repeated groups: this is a page's own expression. The expressions of a host are aligned
one after the other; where they differ, the surplus becomes optional, a difference in number a repeated group,
and text a slot. The result, the host's wrapper, accepts every page of the host.

Pages are then read through their wrapper, which gives every text its slot. What is main text is decided once per host,
from the wrapper's tags and class words and from the slots' sums over all pages (text, link text, whether a
slot ever changes), and then holds for every page.

Expressions are grouped by (host, expression) before they are aligned, in two rounds (by host and salt, then by
host), each a streaming pass over sorted rows, so a host with a third of all pages is neither held in memory nor
aligned in one task.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import BROADCAST_BYTES, stored

#: Elements nested deeper open no node of their own; their text stays.
MAX_DEPTH = 120
#: Longest group of neighbours that is looked for as a repetition; longer ones stay written out.
MAX_GROUP = 24
#: First round: expressions of one host are dealt over so many tasks.
SALTS = 64
#: Where no article is marked: a part with this share of its parent's text takes its place, and slots with more link text go.
MAIN_SHARE, LINK_SHARE = 0.6, 0.5

# ---- fixed values: element names and class words of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small"
                    " span strike strong sub sup time tt u var").split())
HIDDEN = frozenset(("head script style template noscript iframe object svg math canvas audio video map select option datalist button"
                    " textarea input form fieldset nav header footer aside dialog menu").split())
NOISE = frozenset(("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus"
                   " breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist disqus reply replies respond"
                   " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
                   " share sharing social related recommended widget widgets pagination pager toolbar search contentinfo complementary").split())
MAIN = frozenset("articlebody".split())
#: Tags that say little of their content: two of them are the same part only if their children are alike.
SHAPED = frozenset("div section article main center table td".split())
#: Tags of an article's own blocks; its part of the page is never one of them alone.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table address details summary hgroup".split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
                      " h6 header hgroup hr main menu nav ol p pre search section table ul").split())
#: A start tag closes an open one of these, unless one of the others stands between.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option optgroup", "select"),
          "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
          "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"),
          "tfoot": ("tbody thead tfoot tr td th", "table"), "body": ("head", "body")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# ---- end of fixed values

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple]:
    """('text', string), ('start', name, attributes), ('end', name); comments, declarations and raw content are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1: lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        found = (_TAG.match(page, lt) or _LOOSE.match(page, lt)) if nxt == "/" or nxt.isalpha() and nxt.isascii() else None
        if not found:
            if nxt.isalpha() and nxt.isascii() or nxt == "/":
                end = page.find(">", lt)
                if end < 0:                                         # a tag that the end of the page cuts
                    return
                at = end + 1                                        # an end tag without a name
            else:
                yield "text", "<"
                at = lt + 1
            continue
        at = found.end()
        name = found[2].lower()
        if found[1]:
            yield "end", name
            continue
        yield "start", name, found[3]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else n
            if not close:
                return


def head_of(name: str, attributes: str) -> str:
    """Name and class words of a tag: ``div.ad``; a number in a class does not tell tags apart."""
    if not attributes or attributes.isspace():
        return name
    marks = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            marks.add("hidden")
        for word in _SPACE.split(value.strip("\"'")):
            word = re.sub(r"[^A-Za-z_-]", "", word)
            if word:
                marks.add(word)
    return ".".join([name, *sorted(marks)])


@cache
def is_noise(head: str) -> bool:
    """Whether a tag is no part of an article by its name or class words."""
    name, *marks = head.split(".")
    if name in HIDDEN:
        return True
    if name in ("html", "body", "main"):
        return False
    for mark in marks:
        words = [w.lower() for w in _WORD.findall(mark)]
        if mark == "hidden":
            return True
        for k, word in enumerate(words):
            bad = word in NOISE if name != "article" else word in ("comment", "comments", "reply", "related", "ad", "ads", "sponsored")
            if bad and not (k and words[k - 1] in ("no", "has", "with", "without")):
                return True
    return False


def is_article(head: str) -> bool:
    name, *marks = head.split(".")
    return name in ("article", "main") or any(m.lower() in MAIN or m == "main" for m in marks)


def tree(page: str) -> list:
    """Well-nested children of the page: [head, children] for elements, [None, text, link characters, glued] for texts.

    A text is ``glued`` if only an inline element stands between it and the text before.
    """
    root: list = ["", []]
    stack = [root]
    names: list[str] = [""]
    links = glued = 0

    def close(upto: int) -> None:
        del stack[upto:], names[upto:]

    for kind, value, *rest in tokens(page):
        top = stack[-1][1]
        if kind == "text":
            text = references.unescape(value)
            if text.isspace() and not (top and top[-1][0] is None):
                continue
            if top and top[-1][0] is None and not glued:
                top[-1][1] += text
                top[-1][2] += len(text) if links else 0
            else:
                top.append([None, text, len(text) if links else 0, bool(glued)])
            glued = 0
        elif kind == "start":
            name = value
            if name == "a":
                links += 1
            if name in ("br", "wbr"):
                if name == "br" and top and top[-1][0] is None:
                    top[-1][1] += " "
                continue
            if name in INLINE and not is_noise(head := head_of(name, rest[0])):
                continue
            if name not in INLINE:
                glued = 0
                if name in ("html", "body") and name in names:
                    continue
                if name in CLOSES_P and "p" in names:
                    close(len(names) - 1 - names[::-1].index("p"))
                if name in CLOSES:
                    ends, stops = CLOSES[name]
                    for k in range(len(names) - 1, 0, -1):
                        if names[k] in stops:
                            break
                        if names[k] in ends:
                            close(k)
                head = head_of(name, rest[0])
            node = [head, []]
            stack[-1][1].append(node)
            if name not in VOID and len(stack) < MAX_DEPTH:
                stack.append(node)
                names.append(name)
        else:
            if value == "a":
                links = max(0, links - 1)
            if value in names:
                k = len(names) - 1 - names[::-1].index(value)
                stops = CLOSES[value][1] if value in CLOSES else ()
                if not any(x in stops for x in names[k + 1:]):
                    close(k)
            glued = int(value in INLINE and bool(stack[-1][1]) and stack[-1][1][-1][0] is not None)
    return root[1]


# ---- expressions: lists of [head, quantifier ('', '?', '+', '*'), children]; head '#' is a text slot, '(..)' a group

def _either(a: str, b: str) -> str:
    optional = "?" in (a, b) or "*" in (a, b)
    many = "+" in (a, b) or "*" in (a, b)
    return ("*" if many else "?") if optional else ("+" if many else "")


def _together(a: str, b: str) -> str:
    """Quantifier of two equal neighbours folded into one: empty only where both may be."""
    return "*" if a in ("?", "*") and b in ("?", "*") else "+"


def _fits(a: list, b: list) -> bool:
    """Whether two items are one part of a page: the same head, and for tags that say little, half of the smaller one's child heads."""
    if a[0] != b[0] or a[0].split(".", 1)[0] not in SHAPED:
        return a[0] == b[0]
    x, y = {c[0] for c in a[2]}, {c[0] for c in b[2]}
    return 2 * len(x & y) >= min(len(x), len(y))


def fold(items: list) -> list:
    """Equal neighbours become repeated items, then equal groups of neighbours repeated groups."""
    out: list = []
    for item in items:
        if out and _fits(out[-1], item):
            last = out[-1]
            out[-1] = [item[0], _together(last[1], item[1]), align(last[2], item[2])]
        else:
            out.append(item)
    p = 2
    while p <= min(MAX_GROUP, len(out) // 2):
        heads = [x[0] for x in out]
        i = 0
        while i + 2 * p <= len(out):
            alike = lambda j: heads[j:j + p] == heads[i:i + p] and all(map(_fits, out[i:i + p], out[j:j + p]))  # noqa: E731, B023
            if alike(i + p):
                group = out[i:i + p]
                j = i + p
                while alike(j):
                    group = [[a[0], _either(a[1], b[1]), align(a[2], b[2])] for a, b in zip(group, out[j:j + p])]
                    j += p
                out[i:j] = [["(" + " ".join(heads[i:i + p]) + ")", "+", group]]
                return fold(out)
            i += 1
        p += 1
    return out


def _grouped(items: list, groups: dict[str, list[str]]) -> list:
    """Plain neighbours that the other side has as a group are put into one."""
    if not groups:
        return items
    heads = [x[0] for x in items]
    out, i = [], 0
    while i < len(items):
        for name, inner in groups.items():
            if heads[i:i + len(inner)] == inner:
                out.append([name, "", items[i:i + len(inner)]])
                i += len(inner)
                break
        else:
            out.append(items[i])
            i += 1
    return fold(out) if len(out) < len(items) else items


def align(a: list, b: list) -> list:
    """An expression that accepts what either accepts: common items in order, the rest optional, then folded."""
    if a == b:
        return a
    a = _grouped(a, {x[0]: [y[0] for y in x[2]] for x in b if x[0][0] == "("})
    b = _grouped(b, {x[0]: [y[0] for y in x[2]] for x in a if x[0][0] == "("})
    lead = 0
    while lead < min(len(a), len(b)) and _fits(a[lead], b[lead]):
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and _fits(a[-1 - tail], b[-1 - tail]):
        tail += 1
    x, y = a[lead:len(a) - tail], b[lead:len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _fits(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    both = lambda p, q: [p[0], _either(p[1], q[1]), align(p[2], q[2])]
    maybe = lambda p: [p[0], _either(p[1], "?"), p[2]]
    out = [both(p, q) for p, q in zip(a[:lead], b[:lead])]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and _fits(x[i], y[j]):
            out.append(both(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append(maybe(x[i]))
            i += 1
        else:
            out.append(maybe(y[j]))
            j += 1
    out += [both(p, q) for p, q in zip(a[len(a) - tail:], b[len(b) - tail:])]
    return fold(out) if len({p[0] for p in out}) < len(out) else out


def expression(children: list) -> list:
    """A page's own expression: its tree with text as slots and repetitions folded; blank texts are no slots."""
    return fold([["#", "", []] if c[0] is None else [c[0], "", expression(c[1])] for c in children if c[0] is not None or not c[1].isspace()])


class Model:
    """The children an element of a wrapper may have, as an automaton over their heads."""

    def __init__(self, items: list, path: str = ""):
        self.places: list[tuple[str, list]] = []
        self.follow: list[set[int]] = []
        self.first, _, _ = self._sequence(items)
        self.heads = {head for head, _ in self.places}
        self.path, self.inner = path, {}

    def _sequence(self, items: list) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for head, quantifier, children in items:
            if head[0] == "(":
                f, l, e = self._sequence(children)
            else:
                k = len(self.places)
                self.places.append((head, children))
                self.follow.append(set())
                f, l, e = {k}, {k}, False
            if quantifier in ("+", "*"):
                for k in l:
                    self.follow[k] |= f
            e = e or quantifier in ("?", "*")
            for k in last:
                self.follow[k] |= f
            first |= f if empty else set()
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def read(self, children: list) -> list[int]:
        """A place for each child, along a path of the automaton; -1 for heads it has no place for.

        Of several ways, one whose places can hold what the children hold.
        """
        steps: list[dict[int, int]] = []
        now: list[int] | None = [-1]
        for child in children:
            head = child[0] or "#"
            known: dict[int, int] = {}
            for before in now or ():
                for k in (self.follow[before] if before >= 0 else self.first):
                    if self.places[k][0] == head:
                        known.setdefault(k, before)
            if not known:                                            # no way from here: go on at any place of this head
                known = {k: -1 for k, (h, _) in enumerate(self.places) if h == head}
            if len(known) > 1 and head != "#":
                holds = {c[0] or "#" for c in child[1] if c[0] is not None or not c[1].isspace()}
                known = {k: v for k, v in known.items() if holds <= self.child(k).heads} or known
            steps.append(known)
            now = sorted(known) or now
        out, k = [-1] * len(children), -1
        for t in range(len(children) - 1, -1, -1):
            if k not in steps[t]:
                k = min(steps[t], default=-1)
            out[t] = k
            k = steps[t].get(k, -1)
        return out

    def child(self, k: int) -> "Model":
        if k not in self.inner:
            self.inner[k] = Model(self.places[k][1], f"{self.path}{k}.")
        return self.inner[k]


def read(children: list, model: Model) -> Iterator[tuple[str, str, int, bool]]:
    """(slot, text, link characters, glued) of every text of a page, in order; a slot is its path in the wrapper.

    Where a page can be read in two ways, the chosen one may lead to an element without a place for a child; such a
    child's path goes on with ``?``, and its text belongs to the element that holds it.
    """
    inner = [c for c in children if c[0] is not None or not c[1].isspace()]
    for c, k in zip(inner, model.read(inner)):
        place = k if k >= 0 else "?"
        if c[0] is None:
            yield f"{model.path}{place}", c[1], c[2], c[3]
        elif k >= 0 or not is_noise(c[0]):
            yield from read(c[1], model.child(k) if k >= 0 else Model([], f"{model.path}?."))


def main_slots(wrapper: list, slots: dict[str, tuple[int, int, bool]]) -> tuple[list[str], list[str]]:
    """Slots of the main text, and of the text to take where a page has none of those.

    ``slots``: characters, link characters, and whether the text ever changes, per slot, over all pages of the host.
    The main text is the marked article (or main) part with most text. Else, and for pages without it, it is the part that
    holds most of its parent's text, level by level, without link lists (and, where that is the whole page, without text that never changes).
    """
    nodes: list[tuple[str, str, bool, bool]] = []          # path, head, inside noise, is a text slot

    def walk(model: Model, noisy: bool) -> None:
        for k, (head, _) in enumerate(model.places):
            bad = noisy or head != "#" and is_noise(head)
            nodes.append((f"{model.path}{k}", head, bad, head == "#"))
            if head != "#":
                walk(model.child(k), bad)

    walk(Model(wrapper), False)
    clean = [(p, slots.get(p, (0, 0, False))) for p, _, bad, text in nodes if text and not bad]

    def mass(path: str, skip: str | None = None) -> int:
        return sum(s[0] - s[1] for p, s in clean if p.startswith(path + ".") and not (skip and p.startswith(skip + ".")))

    marked = [(mass(p), -len(p), p, head) for p, head, bad, text in nodes if not text and not bad and is_article(head)]
    first = max(marked, default=None)
    chosen = None
    if first and first[0] > 0:
        inner = [m for m in marked if m[2].startswith(first[2] + ".") and m[3].startswith("article") and 2 * m[0] >= first[0]]
        chosen = max(inner, key=lambda m: (m[0], m[1]), default=first)[2]
    main = [p for p, _ in clean if chosen and p.startswith(chosen + ".")]
    # the heaviest part of the rest
    at = ""
    elements = [p for p, head, bad, text in nodes if not text and not bad and p != chosen and head.split(".", 1)[0] not in BLOCKS]
    while True:
        below = [p for p in elements if p.startswith(at) and "." not in p[len(at):]]
        whole = sum(s[0] - s[1] for p, s in clean if p.startswith(at) and p not in main)
        heavy = max(((mass(p, chosen), p) for p in below), default=(0, ""))
        if not whole or heavy[0] < MAIN_SHARE * whole:
            break
        at = heavy[1] + "."
    rest = [(p, varies) for p, (chars, link, varies) in clean if p.startswith(at) and p not in main and chars and link <= LINK_SHARE * chars]
    if next((head for p, head, _, _ in nodes if f"{p}." == at), "") in ("", "html", "body"):
        rest = [x for x in rest if x[1]] or rest        # of a whole page, what never changes is the host's, not the page's
    rest = [p for p, _ in rest]
    return main + [f"{chosen}.?"] * bool(main), rest


def blocks(children: list, model: Model, main: frozenset, rest: frozenset) -> str:
    """The page's main text: blocks of one line, two line breaks between."""
    inside = next((s[:-1] for s in main if s.endswith("?")), None)
    for wanted in (main, rest):
        out: list[str] = []
        for slot, text, _, glued in read(children, model):
            if slot in wanted or "?" in slot and wanted is main and inside and slot.startswith(inside):
                if glued and out:
                    out[-1] += text
                else:
                    out.append(text)
        lines = [t for t in (_SPACE.sub(" ", x).strip() for x in out) if t]
        if lines:
            return "\n\n".join(lines)
    return ""


# ---- Spark

def host_of(url) -> F.Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the expression, as JSON, that accepts every page of the host. ``pages`` has host and html."""
    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"host": df.host, "wrapper": [json.dumps(expression(tree(x or "")), separators=(",", ":")) for x in df.html]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, now = None, None
        for df in batches:
            for h, w in zip(df.host, df.wrapper):
                if h != host:
                    if host is not None:
                        yield pd.DataFrame({"host": [host], "wrapper": [json.dumps(now, separators=(",", ":"))]})
                    host, now = h, json.loads(w)
                else:
                    now = align(now, json.loads(w))
        if host is not None:
            yield pd.DataFrame({"host": [host], "wrapper": [json.dumps(now, separators=(",", ":"))]})

    schema = "host string, wrapper string"
    found = pages.select("host", "html").mapInPandas(own, schema).distinct()
    dealt = found.select("*", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt"))
    # one task holds whole (host, salt) pairs; the salts of a task are merged one after the other as well
    part = dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInPandas(merge, schema)
    return part.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(merge, schema)


def _with(pages: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with columns of their host's row, broadcast if its measured bytes allow, else joined by shuffle (AQE splits hot hosts)."""
    size = side.agg(F.sum(sum((F.length(F.col(c).cast("string")) for c in columns), F.length("host")))).first()[0] or 0
    return pages.join(F.broadcast(side) if 4 * size <= BROADCAST_BYTES else side, "host")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (main text, empty if none), n_chars (its code points).

    A null or empty html gives an empty text; pages without a host in their url share one wrapper. Repeated rows are
    rows of their own; an empty table gives an empty one. Only page_id, url and html are read. A page is one
    row of one task, whatever its length; elements nested deeper than MAX_DEPTH count as part of the one there.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = stored(wrappers(rows))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Model] = {}
        for df in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for h, w, page in zip(df.host, df.wrapper, df.html):
                if h not in known:
                    known = {h: Model(json.loads(w))} if len(known) > 200 else {**known, h: Model(json.loads(w))}
                for slot, text, link, _ in read(tree(page or ""), known[h]):
                    crc = zlib.crc32(text.encode("utf-8", "replace"))
                    t = total.setdefault((h, slot), [0, 0, crc, crc])
                    t[0], t[1], t[2], t[3] = t[0] + len(text), t[1] + link, min(t[2], crc), max(t[3], crc)
            yield pd.DataFrame([(*k, *t) for k, t in total.items()], columns=["host", "slot", "chars", "link", "low", "high"])

    slots = _with(rows.select("host", "html"), found, ["wrapper"]).mapInPandas(sums, "host string, slot string, chars long, link long, low long, high long")
    slots = slots.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("link").alias("link"), (F.min("low") < F.max("high")).alias("varies"))
    # a host's slots are bounded by its wrapper, not by its pages
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "link", "varies")).alias("slots"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            picked = [main_slots(json.loads(w), {s["slot"]: (s["chars"], s["link"], s["varies"]) for s in (ss if ss is not None else ())})
                      for w, ss in zip(df.wrapper, df.slots)]
            yield pd.DataFrame({"host": df.host, "wrapper": df.wrapper, "main": [p[0] for p in picked], "rest": [p[1] for p in picked]})

    plan = stored(found.join(slots, "host", "left").mapInPandas(choose, "host string, wrapper string, main array<string>, rest array<string>"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for df in batches:
            texts = []
            for h, w, main, rest, page in zip(df.host, df.wrapper, df.main, df.rest, df.html):
                if h not in known:
                    one = (Model(json.loads(w)), frozenset(main), frozenset(rest))
                    known = {h: one} if len(known) > 200 else {**known, h: one}
                texts.append(blocks(tree(page or ""), *known[h]))
            yield pd.DataFrame({"page_id": df.page_id, "url": df.url, "text": texts})

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    out = _with(rows, plan, ["wrapper", "main", "rest"]).mapInPandas(extract, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
