"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with k errors, 8 per cent of m. Cut into k + 1 pieces, at least one piece occurs unchanged
in any such occurrence. An automaton finds all pieces of all items in one pass over a document; where a piece of an item
occurs, Myers' bit-parallel search computes the least edit distance of the whole item to any part of the text around it.
Texts and items are compared in lower case, with each run of characters that are no letters or digits as one space.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, kept_rows, remembered, saved, slices

PERCENT = 8
#: Items of fewer characters than this, which any text may nearly hold by chance, must occur as they are and as whole words.
LEAST = 20
#: Bytes of items that are broadcast at once; more are searched slice by slice.
SLICE_BYTES = 2 << 20
_words = re.compile(r"[^\W_]+").findall
#: Characters of scripts that put no space between words (Thai, Lao, Myanmar, Khmer, kana, Han, half-width kana): each borders on a word.
_unspaced = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]").match


def normal(text: str | None) -> str:
    return " ".join(_words((text or "").lower()))


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of item to any part of text, and where the first such part ends; None if above most."""
    m = len(item)
    if not m:
        return (0, 0)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, most + 1, 0
    if m <= most:
        best = m
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, at = score, j + 1
        xv = eq | mv
        ph <<= 1
        pv = ((mh << 1) | (full & ~(xv | ph))) & full
        mv = ph & xv & full
    return (best, at) if best <= most else None


def whole_words(item: str, text: str) -> tuple[int, int] | None:
    """No errors, and where item first ends in text, both normalised, without cutting a word; None if it does not occur so."""
    apart = lambda i: not 0 < i < len(text) or any(c == " " or _unspaced(c) for c in text[i - 1 : i + 1])
    at = text.find(item)
    while at >= 0:
        if apart(at) and apart(at + len(item)):
            return (0, at + len(item))
        at = text.find(item, at + 1)
    return None


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, len(t) * PERCENT // 100 if len(t) >= LEAST else 0) for i, x in items if (t := normal(x))]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, errors) in enumerate(self.items):
            cuts = [len(text) * j // (errors + 1) for j in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _spans(self, text: str) -> dict[int, list[list[int]]]:
        """For each item, the parts of the text that hold all its possible occurrences, apart from each other."""
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                starts[n].append(end - length + 1 - offset)
        out = {}
        for n, found in starts.items():
            _, item, errors = self.items[n]
            spans: list[list[int]] = []
            for s in sorted(set(found)):
                a, b = max(0, s - errors), s + len(item) + errors
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            out[n] = spans
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, least errors, end of that occurrence in the normalised text) of each item that occurs, by item."""
        if not self.items:
            return []
        text = normal(text)
        out = []
        for n, spans in self._spans(text).items():
            item_id, item, errors = self.items[n]
            best = None
            if len(item) < LEAST:
                best, spans = whole_words(item, text), []
            for a, b in spans:
                part = text[a:b]
                at = part.find(item)
                found = (0, at + len(item)) if at >= 0 else myers(item, part, errors if best is None else best[0] - 1)
                if found:
                    best = (found[0], a + found[1])
                if best and best[0] == 0:
                    break
            if best:
                out.append((item_id, *best))
        return sorted(out)

    def any(self, text: str | None) -> bool:
        return bool(self.matches(text))


def item_slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> list[DataFrame]:
    """Parts of the items of about so many bytes. Items without id or text are left out; of repeated ones, one counts."""
    items = benchmark.select(column(benchmark, "item_id", "long"), column(benchmark, "text", "string")).dropna().distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most) or 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def _collected(items: DataFrame) -> list[tuple[int, str]]:
    return sorted((r.item_id, r.text) for r in items.collect())


def _matcher(items) -> Matcher:
    """The matcher of a broadcast of items."""
    return remembered(("items", tuple(items.value)), lambda: Matcher(items.value))


def _pairs(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items)
        for batch in batches:
            for part in slices(batch):
                rows = [(d, *m) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text")) for m in matcher.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "errors", "match_end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, errors, match_end of each row of docs and item that occurs in its whole text.

    errors is the least edit distance of any occurrence, match_end where the first of these ends in the normalised text. A null
    text holds no item. Items of fewer than LEAST characters occur only without errors and as whole words. Rows of repeated documents each have theirs; null ids stay; an empty table on either side gives none;
    extra columns are not read. Items that are the same text each match.
    """
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    parts = item_slices(benchmark)
    out = None
    for part in parts:
        items = docs.sparkSession.sparkContext.broadcast(_collected(part))  # at most about SLICE_BYTES
        found = rows.mapInArrow(_pairs(items), "doc_id long, item_id long, errors long, match_end long")
        if len(parts) > 1:
            found = saved(found, "contaminated")
            items.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item occurs, with their columns as they are."""
    for part in item_slices(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(_collected(part))
        docs = kept_rows(docs, _clean(items))
    return docs


def _clean(items):
    def keep(texts: list) -> list[bool]:
        matcher = _matcher(items)
        return [not matcher.any(t) for t in texts]

    return keep
