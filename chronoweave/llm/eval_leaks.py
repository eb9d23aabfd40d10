"""Passages of evaluation items inside documents: q-gram counts in diagonal bands, then alignment."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed

Q = 8  # a q-gram is eight bytes, read as one integer
_LONG = 24  # bytes; longer words are shortened to this, keeping them distinct by a hash
#: Scripts written without blanks, in which every character counts as a word: kana, Han, Thai, Lao, Myanmar, Khmer.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_QUOTES = re.compile("['’‘ʼ`´′]")
#: Band width and step in bytes: shifts of two words of up to _LONG bytes and their blanks stay inside one band.
_BAND, _STEP = 128, 64
_FAR = 1 << 40  # beyond any position in a passage


def words(text: str | None) -> list[str]:
    """Lower-case words; punctuation, spacing, line breaks and quote marks do not matter."""
    if not text:
        return []
    found = _WORD.findall(_QUOTES.sub("", text.casefold()))
    return [w if len(w) * 4 <= _LONG or (len(w) <= _LONG and w.isascii()) else _short(w) for w in found]


def _short(w: str) -> str:
    b = w.encode("utf-8", "surrogatepass")
    return w if len(b) <= _LONG else xxhash.xxh3_128_hexdigest(b)[:_LONG]


def _stream(ws: list[str]) -> bytes:
    return " ".join(ws).encode("utf-8", "surrogatepass")


def _edges(ws: list[str]) -> np.ndarray:
    """Where each word starts in the stream, and its end."""
    return np.cumsum([0, *(len(w.encode("utf-8", "surrogatepass")) + 1 for w in ws)])


def _grams(stream: np.ndarray) -> np.ndarray:
    """The q-grams of a byte stream, one per position."""
    if len(stream) < Q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(stream, Q).copy().view("<u8")[:, 0]


def _bounds(ws: list[str], run: int, edits: int) -> tuple[int, int]:
    """Fewest q-grams that a stretch of `run` words shares with a copy with that many words edited (q-gram lemma), and its greatest length."""
    size = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in ws])
    each = np.lib.stride_tricks.sliding_window_view(size, run)
    length = each.sum(axis=1) - 1
    lost = (np.sort(each, axis=1)[:, run - edits :] + Q - 1).sum(axis=1)
    return max(1, int((length - Q + 1 - lost).min())), int(length.max())


class _Index:
    """The items' q-grams with their positions, for one block of items."""

    def __init__(self, items: list[tuple[int, str]], run: int, edits: int):
        self.ids, self.words, bounds, grams, where, item = [], [], [], [], [], []
        for key, text in items:
            ws = words(text)
            if len(ws) < run:
                continue
            g = _grams(np.frombuffer(_stream(ws), np.uint8))
            bounds.append(_bounds(ws, run, edits))
            grams.append(g)
            where.append(np.arange(len(g)))
            item.append(np.full(len(g), len(self.ids)))
            self.ids.append(key)
            self.words.append(ws)
        self.empty = not self.ids
        if self.empty:
            return
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")  # by gram, then item, then position
        self.pos, self.item = np.concatenate(where)[order].astype(np.int64), np.concatenate(item)[order].astype(np.int64)
        self.gram, first, n = np.unique(g[order], return_index=True, return_counts=True)
        self.first, self.n = first, n
        self.edges = [_edges(ws) for ws in self.words]
        self.line: np.ndarray | None = None
        self.least, self.longest = np.array(bounds, np.int64).T
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[self._slot(self.gram)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def shared(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the stream, number of the q-gram) of every q-gram that an item holds."""
        g = _grams(stream)
        at = np.flatnonzero(self.bloom[self._slot(g)])
        i = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[i] == g[at]
        return at[ok], i[ok]

    def slices(self, i: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Ranges of items over which the q-grams expand to at most `most` hits each, or to one item's."""
        if self.n[i].sum() <= most:
            return [(0, len(self.ids))]
        each = np.bincount(i, minlength=len(self.gram))
        per = np.bincount(self.item, weights=np.repeat(each, self.n), minlength=len(self.ids))
        out, lo, size = [], 0, 0.0
        for k, n in enumerate(per):
            if k > lo and size + n > most:
                out.append((lo, k))
                lo, size = k, 0.0
            size += n
        return [*out, (lo, len(self.ids))]

    def hits(self, at: np.ndarray, i: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the stream, item, position in the item) of every shared q-gram of items lo to hi."""
        first, n = self.first[i], self.n[i]
        if (lo, hi) != (0, len(self.ids)):
            if self.line is None:
                self.line = np.repeat(np.arange(len(self.gram)), self.n) * len(self.ids) + self.item  # ascending
            first, end = (np.searchsorted(self.line, i * len(self.ids) + x) for x in (lo, hi))
            n = end - first
        k = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[k], self.pos[k]


def aligned(item: list[str], doc: list[str], run: int, edits: int) -> bool:
    """Whether some `run` consecutive item words stand in doc with at most that many words changed, dropped or added.

    Row by row over the item's words; layer e holds, for every place in the
    document, the longest run of item words that ends there with e edits.
    """
    code: dict[str, int] = {}
    d = np.array([code.setdefault(w, len(code)) for w in doc], np.int64)
    zero = np.zeros(len(d) + 1, np.int64)
    none = -(10**6)
    above = [zero.copy() for _ in range(edits + 1)]
    for w in item:
        same = d == code.get(w, -1)
        now: list[np.ndarray] = []
        for e in range(edits + 1):
            row = zero.copy()
            row[1:] = np.where(same, above[e][:-1] + 1, none)
            if e:
                row[1:] = np.maximum(row[1:], above[e - 1][:-1] + 1)  # changed
                row = np.maximum(row, above[e - 1] + 1)  # dropped
                row[1:] = np.maximum(row[1:], now[e - 1][:-1])  # added
                row = np.maximum(row, now[e - 1])
            row = np.maximum(row, 0)
            now.append(row)
        if now[edits].max() >= run:
            return True
        above = now
    return False


def carried(item: list[str], doc: list[str], run: int, edits: int) -> bool:
    """As `aligned`, but unchanged copies are told by a search for the words as they stand."""
    text = f" {' '.join(doc)} "
    return any(f" {' '.join(item[k : k + run])} " in text for k in range(len(item) - run + 1)) or aligned(item, doc, run, edits)


#: What is held at once: bytes of documents, and q-gram hits.
_BATCH_BYTES, _HITS = 1_000_000, 4_000_000
_kept: dict[str, _Index] = {}


def _index(shared, token: str, run: int, edits: int) -> _Index:
    """The block's index, built once in a worker process."""
    if token not in _kept:
        _kept.clear()
        _kept[token] = _Index(shared.value, run, edits)
    return _kept[token]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > _BATCH_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    yield lo, len(texts)


def _matcher(shared, run: int, edits: int):
    token = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, token, run, edits)
        for b in batches:
            if index.empty:
                continue
            texts = b.column("text").to_pylist()
            for lo, hi in _batches(texts):
                docs = [words(t) for t in texts[lo:hi]]
                streams = [_stream(w) for w in docs]
                gap = b"\n" * Q
                starts = np.cumsum([0, *(len(s) + Q for s in streams)])
                place, gram = index.shared(np.frombuffer(gap.join([*streams, b""]), np.uint8))
                found: list[tuple[int, int]] = []
                for first, last in index.slices(gram, _HITS):
                    at, item, pos = index.hits(place, gram, first, last)
                    doc = np.searchsorted(starts, at, side="right") - 1
                    found += sorted(_verified(index, docs, doc, at - starts[doc], item, pos, run, edits))
                ids = b.column("id").take(pa.array([lo + d for d, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for _, i in found], pa.int64())], names=["doc_id", "item_id"])

    return match


def _verified(index: _Index, docs: list[list[str]], doc: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray, run: int, edits: int) -> set[tuple[int, int]]:
    """(document, item) pairs with a band that keeps enough q-grams and a region in it that aligns."""
    if not len(doc):
        return set()
    # A pair with too few shared q-grams in all has no band with enough.
    pair = doc * len(index.ids) + item
    enough = np.bincount(pair)[pair] >= index.least[item]
    doc, at, item, pos = doc[enough], at[enough], item[enough], pos[enough]
    if not len(doc):
        return set()
    diag = at - pos
    out: set[tuple[int, int]] = set()
    edges: dict[int, np.ndarray] = {}
    low = int(diag.min()) - _BAND
    n_bands = (int(diag.max()) - low) // _STEP + 2
    for shift in (0, 1):  # two sets of bands, each starting in the middle of the other's
        band = (diag - low + shift * _STEP) // _BAND
        key = (doc * len(index.ids) + item) * n_bands + band
        order = np.argsort(key * (int(pos.max()) + 1) + pos)
        k, p, a = key[order], pos[order], at[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])  # an item's q-gram counts once per band
        k, p, a = k[fresh], p[fresh], a[fresh]
        # Most q-grams of the band within any stretch of the item as long as `run` words can be.
        who = k // n_bands % len(index.ids)
        line = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) * _FAR + p
        dense = np.searchsorted(line, line + index.longest[who], side="right") - np.arange(len(line)) >= index.least[who]
        # Dense hits that follow each other closely are one region.
        at_d = np.flatnonzero(dense)
        if not len(at_d):
            continue
        joined = np.zeros(len(at_d), bool)
        joined[1:] = (np.diff(at_d) == 1) & (k[at_d][1:] == k[at_d][:-1]) & (np.diff(p[at_d]) < Q)
        begins = np.flatnonzero(~joined)
        ends = at_d[np.append(begins[1:], len(at_d)) - 1]
        for g, end in zip(at_d[begins].tolist(), ends.tolist()):
            d, i = divmod(int(k[g] // n_bands), len(index.ids))
            if (d, i) in out:
                continue
            s = slice(g, int(np.searchsorted(line, line[end] + index.longest[i], side="right")))
            if d not in edges:
                edges[d] = _edges(docs[d])
            dw, ww = edges[d], index.edges[i]
            d0, d1 = np.searchsorted(dw, [a[s].min(), a[s].max() + Q])
            i0, i1 = np.searchsorted(ww, [p[s].min(), p[s].max() + Q])
            if carried(index.words[i][max(0, i0 - run) : i1 + run], docs[d][max(0, d0 - run - edits) : d1 + run + edits], run, edits):
                out.add((d, i))
    return out


def eval_leaks(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, passage: Column, run: int = 18, edits: int = 2, block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id): documents that carry `run` consecutive words of an item's passage with at most `edits` words changed, dropped or added.

    The items' character q-grams are broadcast; every task reads its documents
    once, whole, and counts shared q-grams per document, item and overlapping
    diagonal band. By the q-gram lemma a copied stretch keeps a computable number
    of them in one band; bands that keep fewer are dropped, the others' regions
    are aligned word by word. Nothing is shuffled, and no document is compared
    with more than what it shares.

    The broadcast is bounded by `block_chars` characters of passages; a larger
    set of items is taken in that many blocks, each against all documents.

    Null or empty texts and passages, and passages of fewer than `run` words,
    match nothing; repeated rows give one result row; an empty table gives no
    rows; words of more than 24 bytes are compared by a hash, and each character of
    a script without blanks is a word; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = items.select(item_id.cast("bigint").alias("i"), passage.alias("p")).where("i is not null and p is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    text_rows = docs.select(doc_id.cast("bigint").alias("id"), text.cast("string").alias("text")).where("text is not null and id is not null")
    out = None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.i, r.p) for r in own.collect()])  # at most about block_chars characters
        part = text_rows.mapInArrow(_matcher(shared, run, edits), "doc_id bigint, item_id bigint")
        if blocks > 1:  # one block after another: no two are held at once
            part = checkpointed(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.distinct()
