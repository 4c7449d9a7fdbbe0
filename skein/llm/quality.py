"""Quality rules: base counts, then hashed word and character n-gram logistic regression with calibrated probabilities.

A text's features are, for each family of n-grams, the shares of its n-grams that fall into each of 4096 hash bins. The model is
trained on the driver from a bounded sample of labelled rows whose features executors have computed; its probabilities are
calibrated on a part of the sample that training has not seen (Platt's sigmoid). Texts are scored in Arrow batches: a gram's
weight is looked up by its hash and averaged, so no feature vector is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, kept_rows, remembered, slices

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Labelled rows that a model is trained on, half of each kind where there are so many, those of the smallest hashes of doc_id; the
#: documented bound of the sample.
SAMPLE = 2000
#: A text is kept if its calibrated probability of quality is at least this.
THRESHOLD = 0.3
BINS = 1 << 12
CHAR_GRAMS = (2, 3, 4)
WORD_GRAMS = (1, 2)
FAMILIES = len(CHAR_GRAMS) + len(WORD_GRAMS)
#: Characters hashed at once; the n-grams of longer texts are counted piece by piece.
PIECE = 1 << 20
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """How many words lie in a window of so many words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    bits = max(1, (len(number) - 1).bit_length())
    if bits * window <= 63:
        keys = np.zeros(n, np.int64)
        for i in range(window):
            keys = keys << bits | ids[i : i + n]
    else:  # numbers of ever longer windows in place of their words
        keys = ids[:n]
        for i in range(1, window):
            keys = np.unique(keys * len(number) + ids[i : i + n], return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _bin(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(52)).astype(np.int32)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family, the bins of all n-grams of the texts one after another, and where each text's begin (and the last end)."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    c = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for n in CHAR_GRAMS:
        h = np.zeros(max(0, len(c) - n + 1), np.uint64)
        for i in range(n):
            h += c[i : i + len(h)] * _MIX[100 + 8 * n + i]
        inside = np.ones(len(h), bool)
        for i in range(1, n):
            at = ends - i
            inside[at[(at >= 0) & (at < len(h)) & (i <= lengths)]] = False
        for e in ends[lengths < n - 1]:  # a short text's own characters start no n-gram
            inside[max(0, e - n + 1) : e] &= False
        kept = np.concatenate(([0], np.cumsum(inside)))
        yield _bin(h[inside]), kept[np.minimum(np.concatenate((starts, ends[-1:])), len(h))]
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    begin = ~blank
    begin[1:] &= blank[:-1] | np.isin(np.arange(1, len(c)), starts)
    first = np.flatnonzero(begin)
    place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c)))) if len(first) and first[0] == 0 else None
    if place is None:
        lead = first[0] if len(first) else len(c)
        place = np.concatenate((np.zeros(lead, np.int64), np.arange(lead, len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))))
    term = np.where(blank, np.uint64(0), (c + np.uint64(1)) * _MIX[place & 63])
    words = np.add.reduceat(term, first) if len(first) else np.empty(0, np.uint64)
    bounds = np.searchsorted(first, np.concatenate((starts, ends[-1:])))
    yield _bin(words), bounds
    pairs = words[:-1] * _MIX[200] + words[1:] * _MIX[201] if len(words) else words
    inside = np.ones(len(pairs), bool)
    at = bounds[1:] - 1
    inside[at[(at >= 0) & (at < len(pairs)) & (np.diff(bounds) > 0)]] = False
    kept = np.concatenate(([0], np.cumsum(inside)))
    yield _bin(pairs[inside]), kept[np.minimum(bounds, len(pairs))]


def _counted(bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, minlength=BINS)


def long_counts(text: str) -> np.ndarray:
    """How many n-grams of each family fall into each bin, as grams() has them, PIECE characters at a time.

    Characters beyond a piece complete the n-grams that begin in it. A word's hash is a sum over its characters and so grows from piece
    to piece, and the last whole word stays for the pair with the next.
    """
    out = np.zeros((FAMILIES, BINS), np.int64)
    carry, place, before = None, 0, np.empty(0, np.uint64)  # hash and length of the word that a cut divides, the word before
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + max(CHAR_GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for family, n in enumerate(CHAR_GRAMS):
            own = c[: PIECE + n - 1]
            h = np.zeros(max(0, len(own) - n + 1), np.uint64)
            for i in range(n):
                h += own[i : i + len(h)] * _MIX[100 + 8 * n + i]
            out[family] += _counted(_bin(h))
        c = c[:PIECE]
        blank = (c == 32) | ((c >= 9) & (c <= 13))
        begin = ~blank
        begin[1:] &= blank[:-1]
        first = np.flatnonzero(begin)
        words = np.empty(0, np.uint64)
        last = 0
        if len(first):
            lengths = np.arange(first[0], len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
            if carry is not None and not blank[0]:
                lengths[: first[1] if len(first) > 1 else None] += place
            words = np.add.reduceat(np.where(blank[first[0] :], np.uint64(0), (c[first[0] :] + np.uint64(1)) * _MIX[lengths & 63]), first - first[0])
            last = int(lengths[-1]) + 1
        if carry is not None:
            if blank[0]:
                words = np.append(carry, words)
            else:
                words[:1] += carry
        carry = None
        if not blank[-1] and at + PIECE < len(text):
            carry, place, words = words[-1:].copy(), last, words[:-1]
        out[len(CHAR_GRAMS)] += _counted(_bin(words))
        words = np.append(before, words)
        out[len(CHAR_GRAMS) + 1] += _counted(_bin(words[:-1] * _MIX[200] + words[1:] * _MIX[201]))
        before = words[-1:]
    return out


@dataclass
class Model:
    """weights[family, bin] and bias give a score; slope and shift turn it into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, texts: list[str | None]) -> np.ndarray:
        score = np.full(len(texts), self.bias)
        long = [i for i, t in enumerate(texts) if t and len(t) > PIECE]
        short = [None if t and len(t) > PIECE else t for t in texts]
        for family, (bins, bounds) in enumerate(grams(short)):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[family][bins])))
            score += (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        for i in long:
            counts = long_counts(texts[i])
            score[i] += ((counts * self.weights).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)).sum()
        return _sigmoid(self.slope * score + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns (family x bin) and shares of one text."""
    counts = long_counts(text) if text and len(text) > PIECE else np.stack([_counted(bins) for bins, _ in grams([text])])
    family, found = np.nonzero(counts)
    shares = counts[family, found] / np.maximum(counts.sum(axis=1), 1)[family]
    return (family * BINS + found).astype(np.uint16), shares.astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = [features(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "y": part.column("y"),
                "cols": pa.array([c.tobytes() for c, _ in rows], pa.binary()), "shares": pa.array([s.tobytes() for _, s in rows], pa.binary()),
            })


def _newton_sigmoid(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift, with his targets in place of 0 and 1; rows count by their weight."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(a * score + b)
        w = weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(weight * (p - target) * score).sum(), (weight * (p - target)).sum()])
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[tuple[int, int, bytes, bytes]], good: float | None = None, rounds: int = 200, decay: float = 0.05) -> Model | None:
    """(doc_id, 0 or 1, columns, shares) -> a model, or None without rows of both kinds. A fifth of the rows is for calibration.

    good is the share of good documents that probabilities are calibrated for; that of the rows if it is not given.
    """
    rows = sorted(rows)
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or min(y.sum(), (1 - y).sum()) < 5:
        return None
    held = np.zeros(len(rows), bool)
    for kind in (0, 1):
        held[np.flatnonzero(y == kind)[::5]] = True
    n_cols = FAMILIES * BINS

    def matrix(which: np.ndarray):
        """Column, share and row of each entry, and the rows' labels."""
        at = np.flatnonzero(which)
        cols = np.frombuffer(b"".join(rows[i][2] for i in at), np.uint16)
        return cols, np.frombuffer(b"".join(rows[i][3] for i in at), np.float32), np.repeat(np.arange(len(at), dtype=np.int32), [len(rows[i][2]) // 2 for i in at]), y[at]

    c, v, r, t = matrix(~held)
    scale = 1 / (np.sqrt(np.bincount(c, v * v, n_cols) / len(t)) + 1e-3)
    v = v * scale[c].astype(np.float32)
    even = float(np.sqrt(np.bincount(r, v * v, len(t))).mean())  # rows of about length one
    scale, v = scale / even, v / np.float32(even)
    w, bias = np.zeros(n_cols), float(np.log(t.mean() / (1 - t.mean())))
    weight = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    seen, old_w, old_b, rate = 1.0, w, bias, 2.0
    for _ in range(rounds):  # Nesterov's accelerated descent
        new = (1 + np.sqrt(1 + 4 * seen * seen)) / 2
        step = (seen - 1) / new
        aw, ab = w + step * (w - old_w), bias + step * (bias - old_b)
        err = weight * (_sigmoid(np.bincount(r, v * aw.astype(np.float32)[c], len(t)) + ab) - t) / len(t)
        old_w, old_b, seen = w, bias, new
        w = aw - rate * (np.bincount(c, v * err.astype(np.float32)[r], n_cols) + decay * aw / len(t))
        bias = ab - rate * err.sum()
    w = w * scale
    del c, v, r
    hc, hv, hr, ht = matrix(held)
    good = ht.mean() if good is None else good
    weight = np.where(ht > 0, good / ht.mean(), (1 - good) / (1 - ht.mean()))
    slope, shift = _newton_sigmoid(np.bincount(hr, hv * w[hc], len(ht)) + bias, ht, weight)
    return Model(w.reshape(FAMILIES, BINS), bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most so many labelled documents; None if there are too few of a kind.

    Labels without doc_id or quality are left out; a document with several labels has the lowest; quality above 0 is good.
    """
    known = labels.select(column(labels, "doc_id", "long"), column(labels, "quality", "int")).dropna()
    each = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    n = {r.y: r.n for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = lambda y: min(n.get(y, 0), max(sample // 2, sample - n.get(1 - y, 0)))
    first = lambda y: each.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take(y))
    if not take(0) or not take(1):
        return None
    texts = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most sample rows
    found = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = found.mapInArrow(_featured, "doc_id long, y int, cols binary, shares binary")
    return fit([(r.doc_id, r.y, bytes(r.cols), bytes(r.shares)) for r in rows.collect()], n[1] / (n[0] + n[1]))


def _verdicts(model: Model | None, threshold: float, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, kept and the probability of quality."""
    remembered("quality", dict)
    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
    p = model.probability(texts) if model else np.ones(len(texts))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
    return counts, failed, ~failed & (p >= threshold), p


def _judge(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, failed, keep, p = _verdicts(model, threshold, part.column("text").to_pylist())
                out = {"doc_id": part.column("doc_id")}
                out |= {n: pa.array(counts[:, i]) for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
                yield pa.RecordBatch.from_pydict(out | {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(keep)})

    return run


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, the probability of quality and kept of each row of docs.

    A null text has no words and fails; repeated rows and null ids stay; an empty table gives none; extra columns are not read.
    Without labels of both kinds the base counts decide alone (quality 1).
    """
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    return rows.mapInArrow(_judge(train(docs, labels, sample), threshold), f"doc_id long, {_OUT}")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that judged() keeps, with their columns as they are; scored where they are read, without a shuffle."""
    model = train(docs, labels, sample)
    return kept_rows(docs, lambda texts: _verdicts(model, threshold, texts)[2].tolist())
