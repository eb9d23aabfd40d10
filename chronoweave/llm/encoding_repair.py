"""Text decoded with the wrong character encoding: found and restored by character n-gram models."""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Single-byte encodings that text is commonly misread in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866"]
# Pairs (misread as, true) between single-byte encodings.
SWAPPED = [
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "koi8-r"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
]
LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_BUCKETS = 1 << 20
_MASK = _BUCKETS - 1
_ALPHABET = 4096.0
_SMOOTH = 2.0


def _tables(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; bytes without a character stand for the control of the same code."""
    chars = []
    for b in range(256):
        try:
            chars.append(codecs.decode(bytes([b]), name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


_CODECS = {n: _tables(n) for n in READ_AS}


def _encode(s: str, name: str) -> bytes | None:
    table = _CODECS[name][0]
    out = bytearray()
    for c in s:
        b = table.get(c)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _utf8(b: bytes) -> str | None:
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return None


def unread(run: str) -> Iterator[tuple[str, str]]:
    """(chain, candidate) for UTF-8 that was read as a single-byte encoding, up to three times over."""
    seen = {run}
    layer = [("", run)]
    for _ in range(3):
        deeper = []
        for name, s in layer:
            for w in READ_AS:
                b = _encode(s, w)
                t = None if b is None else _utf8(b)
                if t is not None and t not in seen:
                    seen.add(t)
                    deeper.append((f"{name}{w}>utf-8 ", t))
        yield from deeper
        layer = [(n, t) for n, t in deeper if not t.isascii()]


def swapped(run: str) -> Iterator[tuple[int, str]]:
    """(index in SWAPPED, candidate) for one single-byte encoding read as another."""
    for i, (w, true) in enumerate(SWAPPED):
        b = _encode(run, w)
        if b is not None:
            t = "".join(_CODECS[true][1][x] for x in b)
            if t != run:
                yield i, t


def plainly_misread(text: str) -> bool:
    """Whether a text holds lost characters, C1 controls or a run that is valid UTF-8 when encoded back; such texts don't train the model."""
    for m in _RUN.finditer(text):
        r = m.group()
        if LOST in r or any("\x80" <= c <= "\x9f" for c in r):
            return True
        if len(r) > 1:
            for w in READ_AS:
                b = _encode(r, w)
                t = None if b is None else _utf8(b)
                # Short words of some scripts are by chance valid, but give characters of remote ones.
                if t is not None and all(c < "\u0530" or "\u2000" <= c < "\u2700" for c in t):
                    return True
    return False


def _slot(a: int, b: int, c: int) -> int:
    return ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) >> 7) & _MASK


def _count_grams(text: str, counts: np.ndarray, piece: int = 400_000) -> None:
    """Add a text's hashed 1-grams, and its 2- and 3-grams at and around non-ASCII characters, piece by piece."""
    z = np.uint64
    padded = f"\n\n{text}\n\n"
    for lo in range(2, len(padded) - 2, piece):
        hi = min(lo + piece, len(padded) - 2)
        o = np.frombuffer(padded[lo - 2 : hi + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(z)
        far = np.concatenate([[False, False], o > 127, [False, False]])
        near = (far[:-4] | far[1:-3] | far[2:-2] | far[3:-1] | far[4:])[2:-2]
        x, y, w = o[:-4], o[1:-3], o[2:-2]
        for k, (keep, p, q) in enumerate(((slice(None), z(0), z(0)), (near, z(0), y[near]), (near, x[near], y[near]))):
            g = ((p * z(0x9E3779B1) + q * z(0x85EBCA6B) + w[keep] * z(0xC2B2AE35)) >> z(7)) & z(_MASK)
            slot, n = np.unique(g, return_counts=True)
            counts[slot.astype(np.int64) + k * _BUCKETS] += n


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed n-gram counts of one partition's texts that are not plainly misread."""
    counts = np.zeros(3 * _BUCKETS, np.int64)
    held: list[str] = []
    size = 0
    for b in batches:
        for text in b.column("text").to_pylist():
            if plainly_misread(text):
                continue
            held.append(text)
            size += len(text)
            if size > 400_000:
                _count_grams("\n\n".join(held), counts)
                held, size = [], 0
    _count_grams("\n\n".join(held), counts)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])


class Model:
    """Interpolated character trigram model over hashed counts."""

    def __init__(self, slots: np.ndarray, n: np.ndarray):
        c = np.zeros(3 * _BUCKETS, np.float64)
        c[slots] = n
        self.one, self.two, self.three = (memoryview(x) for x in np.split(c, 3))
        self.total = float(c[:_BUCKETS].sum())
        self.cache: dict[tuple[str, str, str], float] = {}

    def log_p(self, a: int, b: int, c: int) -> float:
        p = (self.one[_slot(0, 0, c)] + 0.1) / (self.total + 0.1 * _ALPHABET)
        p = (self.two[_slot(0, b, c)] + _SMOOTH * p) / (max(self.one[_slot(0, 0, b)], self.two[_slot(0, b, c)]) + _SMOOTH)
        p = (self.three[_slot(a, b, c)] + _SMOOTH * p) / (max(self.two[_slot(0, a, b)], self.three[_slot(a, b, c)]) + _SMOOTH)
        return math.log(p)

    def score(self, before: str, s: str, after: str) -> float:
        """Log likelihood of s and of what follows it, given what stands before it."""
        o = [*map(ord, before), *map(ord, s), *map(ord, after)]
        k = len(before)
        return sum(self.log_p(o[i - 2], o[i - 1], o[i]) for i in range(k, len(o)))

    def evidence(self, before: str, run: str, after: str) -> tuple[float, str, str, dict[int, tuple[float, str]]]:
        """Gains in log likelihood over the run as it stands: the best UTF-8 chain's (gain, candidate, name), and each swap's (gain, candidate)."""
        key = (before, run, after)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            own = self.score(before, run, after)
            top = max(((self.score(before, t, after) - own, t, name.strip()) for name, t in unread(run)), default=(-math.inf, run, ""))
            # A no-break space stands in clean text wherever a blank may: it adds nothing to the evidence of a swap.
            most = 0.0 if not run.strip("\u00a0\u00ad") else math.inf
            self.cache[key] = (*top, {i: (min(most, self.score(before, t, after) - own), t) for i, t in swapped(run)})
        return self.cache[key]


#: UTF-8 sequences of several bytes, one after another.
_SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def chained(run: str) -> list[tuple[int, int]]:
    """Stretches of a run that are UTF-8 sequences when encoded back, whatever stands around them; the longest first, none overlapping.

    In a single-byte encoding a character is a byte, so a stretch of bytes is one
    of characters, cut at the borders of sequences.
    """
    found = set()
    for w in READ_AS:
        table = _CODECS[w][0]
        found |= {m.span() for m in _SEQUENCES.finditer(bytes(table.get(c, 0) for c in run))}
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found, key=lambda x: (x[0] - x[1], x)):
        if all(hi <= a or lo >= b for a, b in out):
            out.append((lo, hi))
    return out


#: Up to so many characters a run without an inner UTF-8 stretch is judged at once; swaps add up over the pieces of a longer one.
_PIECE = 64


def runs(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Runs of non-ASCII characters with up to two ASCII characters of context on either side.

    A run that is a UTF-8 chain as a whole, of whatever length, stays whole; of
    another that is longer than a piece, the stretches that are UTF-8 sequences
    stay whole and what lies between comes in pieces.

    A neighbouring run may be misread too, so it is no context: NUL, which no
    model knows, stands before instead, and what follows ends there.
    """
    padded = f"\n\n{text}\n\n"
    for m in _RUN.finditer(text):
        start, end = m.span()
        cuts = [start, end]
        if end - start > _PIECE and next(iter(unread(m[0])), None) is None:
            whole = sorted((start + a, start + b) for a, b in chained(m[0]))
            edges = [start, *(x for span in whole for x in span), end]
            cuts = sorted({x for lo, hi in zip(edges, edges[1:]) for x in ((lo, hi) if (lo, hi) in whole else (*range(lo, hi, _PIECE), hi))})
        for lo, hi in zip(cuts, cuts[1:]):
            before, after = padded[lo : lo + 2], padded[hi + 2 : hi + 4]
            if not before.isascii():
                before = "\0" + (before[1] if before[1].isascii() else "\0")
            if not after.isascii():
                after = after[:1] if after[0].isascii() else ""
            yield lo, hi, before, text[lo:hi], after


#: What a run counts, in a stretch, under a swap that cannot have made it.
_UNFIT = -4.0


def repair(model: Model, text: str, margins: tuple[float, float]) -> tuple[bool, str, float, float, str]:
    """(misread, restored text, largest UTF-8 gain, largest swap gain, chains used) of one text.

    UTF-8 chains are judged run by run: hardly any clean run is valid UTF-8.
    Swaps of single-byte encodings fit most runs, so their gains are added up
    over the best stretch of consecutive runs (largest sum of a subarray).
    """
    spans = list(runs(text))
    seen = [model.evidence(before, run, after) for _, _, before, run, after in spans]
    lost = LOST in text
    utf8 = max((e[0] for e in seen), default=-math.inf)
    best, stretch = -math.inf, (0, 0, 0)
    for i in {i for e in seen for i, (g, _) in e[3].items() if g > 0}:
        total, start = 0.0, 0
        for k, e in enumerate(seen):
            if total <= 0:
                total, start = 0.0, k
            total += e[3][i][0] if i in e[3] else _UNFIT
            if total > best:
                best, stretch = total, (i, start, k + 1)
    out, at, used = [], 0, set()
    for k, ((lo, hi, *_), e) in enumerate(zip(spans, seen)):
        t = None
        if e[0] > margins[0]:
            t = e[1]
            used.add(e[2])
        elif best > margins[1] and stretch[1] <= k < stretch[2] and stretch[0] in e[3]:
            t = e[3][stretch[0]][1]
            used.add(">".join(SWAPPED[stretch[0]]))
        if t is not None:
            out += [text[at:lo], t]
            at = hi
    out.append(text[at:])
    return bool(used) or lost, "".join(out), utf8, best, ",".join(sorted(used))


def _misread(text: str, read_as: str, true: str) -> str | None:
    """What a clean text would look like if it had been misread."""
    if true == "utf-8":
        b = text.encode("utf-8", "surrogatepass")
    else:
        table = _CODECS[true][0]
        if any(c not in table for c in text):
            return None
        b = bytes(table[c] for c in text)
    return "".join(_CODECS[read_as][1][x] for x in b)


#: Gains at which a margin is tried.
_CUTS = np.arange(1.0, 40, 0.25)


def _trial(shared):
    """How many gains of clean texts, and of the same texts with a piece misread on purpose, lie above each cut."""
    never = (math.inf, math.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        pairs = [(w, "utf-8") for w in READ_AS] + SWAPPED
        # Per kind: how many gains there are, after those whose number of cuts below them is the index.
        counts = np.zeros((4, len(_CUTS) + 2), np.int64)
        for b in batches:
            rows: list[tuple] = []
            for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
                if plainly_misread(text):
                    continue
                w, true = pairs[h % len(pairs)]
                pieces = [x for x in re.split(r"(?<=[.\n])", text) if not x.isascii()]
                piece = pieces[h // len(pairs) % len(pieces)]
                t = _misread(piece, w, true)
                _, _, u, s, _ = repair(model, text, never)
                bad = (None, None) if t is None or t == piece else repair(model, text.replace(piece, t), never)[2:4]
                rows.append((u, s, bad[0] if true == "utf-8" else None, bad[1] if true != "utf-8" else None))
            for k in range(4):
                gains = [r[k] for r in rows if r[k] is not None]
                np.add.at(counts[k], np.searchsorted(_CUTS, gains, side="left"), 1)
                counts[k, -1] += len(gains)
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(counts[kind, at])], names=["kind", "at", "n"])

    return run


def _repairer(shared, margins: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            r = [repair(model, t, margins) for t in b.column("text").to_pylist()]
            gain = [None if max(x[2], x[3]) == -math.inf else max(x[2], x[3]) for x in r]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in r], pa.bool_()), pa.array([x[1] for x in r], pa.string()), pa.array(gain, pa.float64()), pa.array([x[4] for x in r], pa.string())],
                names=["doc_id", "misread", "restored", "gain", "chains"],
            )

    return run


def _cleaner(shared, margins: tuple[float, float]):
    """Keep the texts that the model takes for clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            keep = [t for t in b.column("text").to_pylist() if not plainly_misread(t) and not repair(model, t, margins)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["text"])

    return run


def validated_margin(good: np.ndarray, bad: np.ndarray, fallback: float = 6.0) -> float:
    """The gain that best tells clean texts from misread ones, weighing both kinds of error by rate; never below the least cut.

    good, bad: counts of gains by how many cuts lie below them, and last the number of all.
    """
    if not good[-1] or not bad[-1]:
        return fallback
    # A gain exceeds cut i if more than i cuts lie below it.
    wrong = 1 - np.cumsum(good[:-2]) / good[-1]
    missed = np.cumsum(bad[:-2]) / bad[-1]
    loss = 10 * wrong + missed  # clean texts are the many: an error on them weighs ten times
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(_CUTS[best[len(best) // 2]])  # midway between what either kind reaches


def repair_encoding(docs: DataFrame, doc_id: Column, text: Column, margins: tuple[float, float] | None = None) -> DataFrame:
    """Find texts with stretches decoded by the wrong encoding and restore them where possible.

    A smoothed character trigram model is trained on all records that are not
    plainly misread, and once more on those that the first model takes for
    clean. Counts are hashed into a fixed table, so what is collected and
    broadcast is bounded at 3 * 2^20 counts whatever the data. ASCII is the same
    in all encodings considered, so each run of non-ASCII characters is judged by
    itself in its context: every chain of re-encodings that applies gives a
    candidate, whose gain in log likelihood must exceed a margin (`repair`). The
    margins, one for UTF-8 chains and one for swapped single-byte encodings, are
    validated on all records with non-ASCII characters that are not plainly misread,
    a piece of each also misread on purpose; only counts of gains between fixed
    cuts are collected. Everything runs over all records and whole texts.

    Output: doc_id, misread, restored (the text as it stands if not misread),
    gain (largest; null without candidates), chains. Lost characters (U+FFFD) mark
    a text as misread though nothing restores them.
    Null ids and texts are left out; ASCII and empty texts are not misread;
    repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text")).where("doc_id is not null and text is not null")
    foreign = rows.where(F.col("text").rlike(r"[^\x00-\x7F]"))

    def trained(texts: DataFrame):
        # Each task adds up its own counts first; few, long tasks keep what is shuffled bounded by their number.
        t = texts.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(_gram_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 3 * 2^20 rows, by the hashing
        return spark.sparkContext.broadcast((t["slot"].to_numpy(np.int64), t["n"].to_numpy(np.float64)))

    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def validated(shared) -> tuple[float, float]:
        if margins:
            return margins
        n = np.zeros((4, len(_CUTS) + 2), np.int64)
        for r in foreign.select("text", h.alias("h")).mapInArrow(_trial(shared), "kind bigint, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
            n[r.kind, r.at] = r.n
        return validated_margin(n[0], n[2]), validated_margin(n[1], n[3])

    first = trained(foreign.select("text"))
    model = trained(foreign.select("text").mapInArrow(_cleaner(first, validated(first)), "text string"))
    judged = foreign.mapInArrow(_repairer(model, validated(model)), "doc_id bigint, misread boolean, restored string, gain double, chains string")
    plain = rows.where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", F.lit(False).alias("misread"), F.col("text").alias("restored"), F.lit(None).cast("double").alias("gain"), F.lit("").alias("chains"))
    return judged.unionByName(plain)
