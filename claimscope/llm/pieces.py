"""SentencePiece encoding and decoding by suffix-array matching over the distinct words of a batch.

The model's pieces never hold a blank after another character, so a text can be cut before every
blank that follows a non-blank, and each cut word is encoded by itself, once per batch. The new
words of a batch are concatenated; a suffix array over the text (suffixes ordered by their first
bytes, up to the longest piece) is binary-searched for every piece; the occurrence ranges are
expanded to edges (word, start, end, piece), sorted by end, and relaxed from left to right.

The relaxation yields the merge-order (BPE) segmentation of the model: of the edges that end at a
place exactly one follows the best segmentation of its start, namely the one whose piece next to
the last piece there is left apart by the merges. That pair rule is computed by the merges
themselves once per pair of pieces and kept. Characters without a piece become byte pieces, and
so does a literal U+2581, so that decoding returns every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimscope.llm.common import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "\u2581"
CUT = re.compile(r" *[^ ]+| +")
#: Words kept by a worker between batches; older ones are forgotten, never left out.
KEPT_WORDS = 400_000


class Vocabulary:
    """Pieces of a model file, and the pair rule of its merges."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.texts = {i: sp.id_to_piece(i).replace(BLANK, " ") for i in range(n) if i not in special}
        if any(" " in t.lstrip(" ") for t in self.texts.values()):
            raise ValueError("a piece spans words; this model cannot be encoded word by word")
        self.score = {t: sp.get_score(i) for i, t in self.texts.items()}
        self.special = special
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        ids = sorted(self.texts, key=lambda i: self.texts[i].encode())
        self.ids = np.array(ids, np.int64)
        self.raw = [self.texts[i].encode() for i in ids]
        self.lengths = np.array([len(r) for r in self.raw])
        self.blocks = -(-int(self.lengths.max()) // 8)
        self.low = [self._block(k, 0x00) for k in range(self.blocks)]
        self.high = [self._block(k, 0xFF) for k in range(self.blocks)]
        self.bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else self.texts.get(i, "").encode() for i in range(n)]
        self.pairs: dict[tuple[int, int], bool] = {}

    def _block(self, k: int, pad: int) -> np.ndarray:
        fill = bytes([pad])
        return np.array([int.from_bytes(r[8 * k: 8 * k + 8].ljust(8, fill), "big") for r in self.raw], np.uint64)

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short text by the merges: the best-scored neighbour pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave piece b unmerged after piece a (a < 0: at a word's start or after bytes)."""
        known = self.pairs.get((a, b))
        if known is None:
            left = [self.texts[a]] if a >= 0 else []
            known = self.merged("".join(left) + self.texts[b]) == [*left, self.texts[b]]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def edges(words: list[bytes], v: Vocabulary, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, start, piece) of every occurrence of a piece in the concatenated words, sorted by end, then start (if ``ordered``)."""
    data = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
    n = len(data)
    # 8-byte blocks of every suffix; the separator (never part of UTF-8) ends all matches
    padded = np.concatenate([data, np.full(8 * v.blocks + 8, 0xFF, np.uint8)])
    key = np.zeros(n + 8 * v.blocks, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j: j + len(key)]
    order = np.argsort(key[:n], kind="stable")
    block = [key[8 * k: 8 * k + n] for k in range(v.blocks)]
    first = block[0][order]
    same = np.zeros(n, bool)
    same[1:] = first[1:] == first[:-1]
    tied = np.flatnonzero(same | np.append(same[1:], False))
    if len(tied) and v.blocks > 1:
        part = order[tied]
        order[tied] = part[np.lexsort([b[part] for b in block[:0:-1]] + [first[tied]])]
    # ranges: block by block, inside the range of equal earlier blocks
    lo = np.searchsorted(first, v.low[0], "left")
    hi = np.searchsorted(first, v.high[0], "right")
    for k in range(1, v.blocks):
        longer = np.flatnonzero((v.lengths > 8 * k) & (hi > lo))
        for i in longer:  # few pieces are longer than a block, and fewer occur
            part = block[k][order[lo[i]: hi[i]]]
            lo[i], hi[i] = lo[i] + np.searchsorted(part, v.low[k][i], "left"), lo[i] + np.searchsorted(part, v.high[k][i], "right")
    found = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(found)), found)
    at = order[np.repeat(lo, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
    end = at + v.lengths[which]
    if not ordered:
        return end, at, v.ids[which]
    by = np.lexsort((at, end))
    return end[by], at[by], v.ids[which][by]


def encode_long_words(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """``encode_words`` place by place, for words of any length."""
    if not words:
        return []
    raw = [w.replace(BLANK, "\x00").encode() for w in words]  # a literal blank mark has no piece here
    end, start, piece = edges(raw, v)
    sizes = np.array([len(r) for r in raw]) + 1
    begin = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(end, np.append(begin, begin[-1] + sizes[-1]), "right").tolist()
    end, start, piece, begin = end.tolist(), start.tolist(), piece.tolist(), begin.tolist()
    apart, pairs = v.apart, v.pairs
    out = []
    for i, r in enumerate(raw):
        base, size = begin[i], len(r)
        last: list = [None] * (size + 1)   # piece that ends here in the segmentation of the word up to here
        came = [0] * (size + 1)
        last[0] = -1
        e, stop = cuts[i], cuts[i + 1]
        p = 0
        while p < size:                      # places in order; every place relaxes the edges that end at it
            p += 1
            target = base + p
            while e < stop and end[e] == target:
                s = start[e] - base
                before = last[s]
                if before is not None and last[p] is None:
                    b = piece[e]
                    ok = pairs.get((before, b))
                    if apart(before, b) if ok is None else ok:
                        last[p], came[p] = b, s
                e += 1
            if last[p] is None and (p == size or (r[p] & 0xC0) != 0x80):  # a character's end that no piece reaches
                s = p - 1
                while s and (r[s] & 0xC0) == 0x80:
                    s -= 1
                if last[s] is not None and r[s:p].decode() not in v.score:
                    last[p], came[p] = -1, s
        ids, p = [], size
        while p:
            s = came[p]
            if last[p] >= 0:
                ids.append(last[p])
            else:
                ids += [v.byte_id[b] for b in reversed(r[s:p] if r[s:p] != b"\x00" or BLANK not in words[i] else BLANK.encode())]
            p = s
        out.append(np.array(ids[::-1], np.int32))
    return out


class PairTable:
    """The pair rule for arrays of pairs: a table by hash of the latest pairs, the vocabulary's own memory behind it."""

    SLOTS = 1 << 20

    def __init__(self, v: Vocabulary):
        self.v, self.width = v, np.int64(max(v.texts) + 2)
        self.code, self.rule = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def __call__(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        code = (before + 1) * self.width + piece
        slot = (((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.rule[slot]
        miss = np.flatnonzero(self.code[slot] != code)
        if len(miss):
            new, at = np.unique(code[miss], return_inverse=True)
            rule = np.array([self.v.apart(c // int(self.width) - 1, c % int(self.width)) for c in new.tolist()], bool)
            out[miss] = rule[at]
            self.code[slot[miss]], self.rule[slot[miss]] = code[miss], rule[at]
        return out


@cache
def pair_table(v: Vocabulary) -> PairTable:
    return PairTable(v)


#: Words of more bytes are relaxed one by one.
LONG = 256


def encode_words(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each word (leading blanks, then no blank inside); words are relaxed together, by the distance of a place from its word's start."""
    raw = [w.replace(BLANK, "\x00").encode() for w in words]  # a literal blank mark has no piece here
    odd = [i for i, r in enumerate(raw) if len(r) > LONG or b"\x00" in r]
    if odd:
        out: list = [None] * len(words)
        for i, ids in zip(odd, encode_long_words([words[i] for i in odd], v)):
            out[i] = ids
        rest = [i for i in range(len(words)) if out[i] is None]
        for i, ids in zip(rest, encode_words([words[i] for i in rest], v) if rest else []):
            out[i] = ids
        return out
    end, start, piece = edges(raw, v, ordered=False)
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    size = np.array([len(r) for r in raw])
    begin = np.cumsum(size + 1) - size - 1
    apart = pair_table(v)
    place = np.arange(len(data))
    far = (place - np.repeat(begin, size + 1)).astype(np.uint16)    # from the word's start; small numbers sort fast
    head = (data & 0xC0) != 0x80                                    # a character (or the word's end) is here
    before_head = np.maximum.accumulate(np.where(head, place, 0))
    came = np.append(0, before_head[:-1])                           # start of the character that ends here
    single = np.zeros(len(data), bool)                              # that character is a piece
    single[end[start == came[end]]] = True
    order = np.argsort(far[end], kind="stable")                     # edges by distance
    end, start, piece = end[order], start[order], piece[order]
    steps = np.searchsorted(far[end], np.arange(1, int(size.max(initial=0)) + 2))
    stops = np.flatnonzero(head & (far > 0))
    stops = stops[np.argsort(far[stops], kind="stable")]
    stop_steps = np.searchsorted(far[stops], np.arange(1, int(size.max(initial=0)) + 2))
    last = np.full(len(data), -2, np.int64)                         # piece that ends here in the segmentation up to here; -2: none yet
    last[begin] = -1
    for k in range(len(steps) - 1):
        s, e, b = start[steps[k]: steps[k + 1]], end[steps[k]: steps[k + 1]], piece[steps[k]: steps[k + 1]]
        reached = np.flatnonzero(last[s] > -2)
        s, e, b = s[reached], e[reached], b[reached]
        won = np.flatnonzero(apart(last[s], b))                     # one of the edges that end at a place
        last[e[won]], came[e[won]] = b[won], s[won]
        at = stops[stop_steps[k]: stop_steps[k + 1]]
        at = at[(last[at] == -2) & ~single[at]]                     # a character's end that no piece reaches: its bytes
        at = at[last[before_head[at - 1]] > -2]
        last[at] = -1
        came[at] = before_head[at - 1]
    # back from the ends; byte pieces are one id a byte
    parts, word, at, turn = [], np.arange(len(raw)), begin + size, 0
    live = np.flatnonzero(size > 0)
    word, at = word[live], at[live]
    while len(word):
        parts.append((word, np.full(len(word), turn), last[at], came[at], at))
        at = came[at]
        go = at > begin[word]
        word, at, turn = word[go], at[go], turn + 1
    if not parts:
        return [np.zeros(0, np.int32) for _ in raw]
    word, turn, ids, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-turn, word))
    word, ids, lo, hi = word[order], ids[order], lo[order], hi[order]
    count = np.where(ids >= 0, 1, hi - lo)
    flat = np.repeat(ids, count)
    byte = np.flatnonzero(flat < 0)
    if len(byte):
        first = np.cumsum(count) - count
        offset = np.arange(len(flat)) - np.repeat(first, count)
        flat[byte] = np.array(v.byte_id)[data[np.repeat(lo, count)[byte] + offset[byte]]]
    cuts = np.cumsum(np.bincount(word, count, len(raw)).astype(np.int64))[:-1]
    return np.split(flat.astype(np.int32), cuts)


def joined(ids: np.ndarray, v: Vocabulary) -> str:
    """Pieces and byte pieces of ids as one text, with the blank that every encoded text starts with."""
    return b"".join([v.bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """The text that was encoded to ``ids``."""
    return joined(ids, v)[1:]


class Encoder:
    """Encodes texts batch by batch, keeping the latest words."""

    def __init__(self, path: str):
        self.v, self.known = vocabulary(path), {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [CUT.findall(" " + t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.known})
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list({w for words in cut for w in words})
        for i in range(0, len(new), 50_000):
            part = new[i: i + 50_000]
            self.known.update(zip(part, (ids.tobytes() for ids in encode_words(part, self.v))))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in cut]


def encode(docs: DataFrame, model: str = MODEL, batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_tokens, n_byte_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip.

    round_trip tells whether decoding the ids gives the text again. Null and empty texts have no
    ids. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        v = encoder.v
        byte_ids = np.array(sorted(v.byte_of))
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            i = 0
            while i < n:
                texts, size = [], 0
                while i + len(texts) < n and size < batch_bytes:
                    texts.append(column[i + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids = encoder(texts)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lengths = np.array([len(x) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(texts)), pa.array(lengths, pa.int64()),
                     pa.array([int(np.isin(x, byte_ids).sum()) for x in ids], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat)),
                     pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                     pa.array([joined(x, v) == (" " + t if t else "") for x, t in zip(ids, texts)])],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids", "ids_sha256", "round_trip"])
                i += len(texts)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("round_trip", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
