"""Personal data: base patterns, and a character-level BiLSTM-CRF that is trained on spans they label.

The network (embedding, one LSTM each way, a linear layer, CRF transitions) is trained in NumPy
on a bounded sample of labelled windows (TRAIN_DOCUMENTS documents, TRAIN_WINDOWS windows each).
It reads every place where a span can be: overlapping windows over each ``@`` or digit, one of
which every labelled kind contains. Each window is decoded by Viterbi; a span cut by a window's
edge is left to the overlapping window; the spans of a document are then reconciled as a whole,
by the set of non-overlapping spans of the highest total confidence. Base spans always stay;
of the others those stay that touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import bound_batches, hash_sample

KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns, written so that no text makes them retry: nothing that may follow a possessive part begins with a
# character of it, and a match that fails from the head of a run of digits fails from all its places.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
TRIGGER = re.compile("[0-9@]")
ADDRESS_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")

TRAIN_DOCUMENTS, TRAIN_WINDOWS = 400, 4
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN, TAGS = 8, 16, 1 + 2 * len(KINDS)
STEPS, BATCH, RATE, SEED = 120, 48, 0.02, 7
LEAST_CONFIDENCE = 2.0
DECODED = 256         # windows that are decoded at once; every task of an executor holds the network's states of so many

Span = tuple[int, int, int]  # start, end (exclusive), kind


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans that pass their checks, by start, then kind."""
    out: list[Span] = []
    if "@" in text:  # a match stays inside a run of address characters, so only runs with an @ are searched
        for at, stop in _runs(text):
            while m := LOCAL.search(text, at, stop):
                at = m.end()
                if at < stop and text[at] == "@" and (d := DOMAIN.match(text, at + 1, stop)):
                    out.append((m.start(), d.end(), 0))
                    at = d.end()
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = "".join(DIGITS.findall(m.group()))
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 10 <= len("".join(DIGITS.findall(m.group()))) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of address characters that hold an @."""
    runs, at = [], text.find("@")
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")
    while at >= 0:
        left = at
        while left and text[left - 1] in allowed:
            left -= 1
        right = ADDRESS_RUN.match(text, at).end()
        runs.append((left, right))
        at = text.find("@", right)
    return runs


def codes(text: str) -> np.ndarray:
    """Character classes: printable ASCII as it is, other white space as a blank, the rest as one letter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < 32, 32, np.where(c > 126, 127, c)) - 32


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial() -> dict[str, np.ndarray]:
    r = np.random.default_rng(SEED)
    p = {"E": r.normal(0, 0.3, (96, EMBED)), "V": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS),
         "A": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p["W" + d] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        p["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    return p


def _lstm(x, w, b, training=True):
    """x (steps, n, EMBED) -> hidden states and (training) what the backward pass needs."""
    n, keep = x.shape[1], []
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out = np.empty((len(x), n, HIDDEN))
    for k, step in enumerate(x):
        z = np.concatenate([step, h], 1)
        a = z @ w + b
        s = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
        before, c = c, f * c + i * g
        t = np.tanh(c)
        h = o * t
        if training:
            keep.append((z, i, f, o, g, before, t))
        out[k] = h
    return out, keep


def _lstm_back(dh_all, keep, w):
    n = dh_all.shape[1]
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), []
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for d, (z, i, f, o, g, before, t) in zip(dh_all[::-1], keep[::-1]):
        dh = dh + d
        dc = dc + dh * o * (1 - t * t)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += z.T @ da
        db += da.sum(0)
        dz = da @ w.T
        dx.append(dz[:, :EMBED])
        dh, dc = dz[:, EMBED:], dc * f
    return np.stack(dx[::-1]), dw, db


def emissions(p, x, training=True):
    """x (n, steps) character classes -> (steps, n, TAGS), and (training) the states of both ways."""
    e = p["E"][x.T]
    hf, kf = _lstm(e, p["Wf"], p["bf"], training)
    hb, kb = _lstm(e[::-1], p["Wb"], p["bb"], training)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ p["V"] + p["c"], (h, kf, kb)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_gradients(p, x, y):
    """Mean CRF negative log-likelihood of tags y (n, steps), and the gradient of every parameter."""
    n, steps = x.shape
    em, (h, kf, kb) = emissions(p, x)
    alpha, beta = np.zeros((steps, n, TAGS)), np.zeros((steps, n, TAGS))
    alpha[0] = em[0]
    for t in range(1, steps):
        alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + p["A"], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(p["A"] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    tags = y.T
    rows = np.arange(n)
    score = sum(em[t, rows, tags[t]] for t in range(steps)) + sum(p["A"][tags[t - 1], tags[t]] for t in range(1, steps))
    de = np.exp(alpha + beta - log_z[None, :, None])
    da = np.zeros_like(p["A"])
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + p["A"] + (em[t] + beta[t])[:, None, :] - log_z[:, None, None]
        da += np.exp(pair).sum(0)
        np.add.at(da, (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        de[t, rows, tags[t]] -= 1
    de, da = de / n, da / n
    dh = de @ p["V"].T
    dxf, dwf, dbf = _lstm_back(dh[:, :, :HIDDEN], kf, p["Wf"])
    dxb, dwb, dbb = _lstm_back(dh[::-1, :, HIDDEN:], kb, p["Wb"])
    grad_e = np.zeros_like(p["E"])
    np.add.at(grad_e, x.T, dxf + dxb[::-1])
    return float((log_z - score).mean()), {
        "E": grad_e, "V": np.einsum("tnh,tnk->hk", h, de), "c": de.sum((0, 1)), "A": da,
        "Wf": dwf, "bf": dbf, "Wb": dwb, "bb": dbb}


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam over random batches of windows x (n, WINDOW) with tags y."""
    p, r = initial(), np.random.default_rng(SEED)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        take = r.integers(0, len(x), BATCH)
        _, g = loss_gradients(p, x[take], y[take])
        norm = np.sqrt(sum((a * a).sum() for a in g.values()))
        for k in p:
            a = g[k] / max(1.0, norm / 5)
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in p.items()}


def decode(p, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi tags (n, steps) of windows, and how far each emission lies above that of 'outside'."""
    em, _ = emissions(p, x, training=False)
    steps, n = em.shape[:2]
    best, back = em[0], np.zeros((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        s = best[:, :, None] + p["A"]
        back[t] = s.argmax(1)
        best = em[t] + s.max(1)
    tags = np.zeros((n, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    margin = np.take_along_axis(em, tags.T[:, :, None], 2)[:, :, 0].T - em[:, :, 0].T
    return tags, margin


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a place where a span can be."""
    last = max(0, (len(text) - 1) // STRIDE)
    at = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
    return sorted(STRIDE * i for i in {j for i in at for j in (i - 1, i) if 0 <= j <= last})


def _windows(text: str, starts: list[int]) -> np.ndarray:
    c = codes(text)
    return np.stack([np.pad(c[s: s + WINDOW], (0, max(0, WINDOW - len(c[s: s + WINDOW])))) for s in starts])


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    y = np.zeros(WINDOW, np.int64)
    for a, b, k in spans:
        if start <= a and b <= start + WINDOW:
            y[a - start], y[a - start + 1: b - start] = 1 + 2 * k, 2 + 2 * k
    return y


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            starts = [max(0, a - (7 * i + a) % (WINDOW // 2)) for i, (a, _, _) in enumerate(spans[:TRAIN_WINDOWS])]
            for s in (starts or window_starts(text)[:1]):
                xs.append(_windows(text, [s])[0].astype(np.int8).tobytes())
                ys.append(tags_of(spans, s).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> dict[str, np.ndarray] | None:
    """A model fitted on windows of at most ``documents`` documents (the least by hash of those with an @ or a digit).

    None if no window of the sample holds a labelled span; then only base spans are found.
    """
    with_signs = docs.select("text").where(F.col("text").rlike("@|[0-9]{4}|[0-9][.][0-9]"))
    sample = hash_sample(with_signs, documents, "text")
    rows = sample.mapInArrow(_training_rows, "x binary, y binary").collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r.x, np.int8) for r in rows]).astype(np.int64)
    y = np.stack([np.frombuffer(r.y, np.int8) for r in rows]).astype(np.int64)
    order = np.lexsort(x.T)
    return fit(x[order], y[order]) if y.any() else None


def _reconcile(found: dict[Span, float]) -> list[Span]:
    """The non-overlapping spans of the highest total confidence."""
    spans = sorted(found, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best = [0.0]
    take = []
    for i, s in enumerate(spans):
        j = bisect_right(ends, s[0], 0, i)
        with_it = best[j] + found[s]
        take.append(with_it > best[-1])
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            out.append(spans[i - 1])
            i = bisect_right(ends, spans[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def find(texts: list[str], model) -> list[tuple[list[Span], list[Span]]]:
    """Per text, its base spans and all spans (base, and the model's that touch none of them)."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    found: list[dict[Span, float]] = [{} for _ in texts]
    todo: list[tuple[int, int]] = []

    def flush():
        if not todo:
            return
        by_text: dict[int, list[int]] = {}
        for i, s in todo:
            by_text.setdefault(i, []).append(s)
        x = np.concatenate([_windows(texts[i], s) for i, s in by_text.items()])
        tags, margin = decode(model, x)
        for (i, s), t, m in zip([(i, s) for i, ss in by_text.items() for s in ss], tags, margin):
            size = len(texts[i])
            a = 0
            while a < WINDOW:
                if t[a] == 0 or t[a] % 2 == 0:
                    a += 1
                    continue
                b = a + 1
                while b < WINDOW and t[b] == t[a] + 1:
                    b += 1
                whole = (a > 0 or s == 0) and (b < WINDOW or s + b >= size) and s + b <= size
                piece, sure = texts[i][s + a: s + b], float(m[a:b].mean())
                if whole and b - a >= 7 and sure >= LEAST_CONFIDENCE and TRIGGER.search(piece) and piece == piece.strip():
                    key = (s + a, s + b, int(t[a] - 1) // 2)
                    found[i][key] = max(found[i].get(key, 0.0), sure)
                a = b
        todo.clear()

    for i, text in enumerate(texts):
        for s in window_starts(text):
            todo.append((i, s))
            if len(todo) >= DECODED:
                flush()
    flush()
    out = []
    for b, f in zip(base, found):
        extra = [s for s in _reconcile(f) if not any(s[0] < y and x < s[1] for x, y, _ in b)] if f else []
        out.append((b, sorted(b + extra, key=lambda s: (s[0], s[2]))))
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _texts(column) -> Iterator[tuple[int, list[str]]]:
    """Slices of about 8 MB (nulls as empty) with their first row."""
    i, part, size = 0, [], 0
    for j, value in enumerate(column):
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size > 8 << 20:
            yield i, part
            i, part, size = j + 1, [], 0
    if part:
        yield i, part


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Null and empty texts have no spans. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                rows = find(texts, model)
                counts = [pa.array([sum(s[2] == k for s in b) for b, _ in rows], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(texts)), *counts,
                     pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in rows]),
                     pa.array([_said(a) for _, a in rows])],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans are replaced as one, by the first's kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked (and ``n_chars`` to match, if there); null texts stay null."""
    bound_batches(docs.sparkSession)
    model = train(docs)
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch.column(at)):
                part = batch.slice(i, len(texts))
                columns = list(part.columns)
                masked = [mask(t, a) for t, (_, a) in zip(texts, find(texts, model))]
                null = columns[at].is_null().to_numpy(zero_copy_only=False)
                columns[at] = pa.array(masked, pa.string(), mask=null).cast(columns[at].type)
                if size_at is not None:
                    columns[size_at] = pa.array([len(t) for t in masked], pa.int64(), mask=null).cast(columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
