"""Near copies by SimHash: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits if and only if the balls of radius r around them meet. Every fingerprint
therefore emits all its variants within r = 2 bits (1 + 64 + 2016), variants meet in a shuffle, and fingerprints that share one
are linked. The variants are not sent one by one: the shuffle key is a variant's prefix of k bits, and the receiving task makes
the variants that have this prefix from the fingerprint and the bits that remain to be spent. The same variants meet as if each
were a row, for 1 + k + k(k-1)/2 rows of two numbers a fingerprint in place of 2081.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, join_small, remembered, saved, slices
from skein.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Variants that a task holds at once; more are divided by their next bit.
VARIANTS = 1 << 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"


def shingle_hashes(text: str | None, n: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of n lower-cased words, repeats included; of the whole sequence if it has fewer words; none without words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    words = data.split()  # bytes split at exactly space and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    starts = np.concatenate(([0], ends[: len(words) - n] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; without hashes, zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 17):
        part = np.ascontiguousarray(hashes[at : at + (1 << 17)]).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered("simhash", dict)
    for batch in batches:
        for part in slices(batch):
            out = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in part.column("text")), np.uint64, part.num_rows)
            keep = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(out.view(np.int64))], names=[*keep, "fp"])


def fingerprints(docs: DataFrame, keys: list[F.Column]) -> DataFrame:
    """keys and fp, the fingerprint as a signed long, of each whole text; a null text has no words and so fingerprint zero."""
    rows = docs.select(*keys, column(docs, "text", "string"))
    return rows.mapInArrow(_fingerprints, rows.drop("text").schema.add("fp", "long"))


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers below 2**bits with at most so many ones."""
    out = [sum(1 << b for b in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)]
    return np.array(out, np.uint64)


def _meet(fps: np.ndarray, left: np.ndarray, bits: int, out: list[np.ndarray]) -> None:
    """Links among fps, each of which may change so many (left) of its low bits; the bits above are the task's own."""
    if len(np.unique(fps)) < 2:
        return
    counts = np.array([sum(comb(bits, i) for i in range(n + 1)) for n in range(int(left.max()) + 1)])
    if counts[left].sum() > VARIANTS and bits:
        bit = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            spent = (bit != side).astype(left.dtype)
            ok = left >= spent
            _meet(fps[ok], (left - spent)[ok], bits - 1, out)
        return
    low = np.uint64((1 << bits) - 1 if bits < 64 else 0xFFFFFFFFFFFFFFFF)
    made, owner = [], []
    for n in np.unique(left):
        own, change = fps[left == n], masks(bits, int(n))
        made.append(((own & low)[:, None] ^ change[None, :]).ravel())
        owner.append(np.repeat(own, len(change)))
    variants, owners = np.concatenate(made), np.concatenate(owner)
    order = np.sort(variants)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, variants)
    hit = twice[np.minimum(at, len(twice) - 1)] == variants
    group, own = at[hit], owners[hit]
    order = np.lexsort((own, group))
    group, own = group[order], own[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    lowest = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    pairs = np.stack([lowest, own], axis=1)[lowest != own]
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]  # what shares a variant is as near as this
    if len(pairs):
        out.append(np.unique(pairs, axis=0))


def _links(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        _meet(rows["fp"].to_numpy(np.int64).view(np.uint64), rows["left"].to_numpy(np.int64), bits, out)
        pairs = np.unique(np.concatenate(out), axis=0).view(np.int64) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def links(fps: DataFrame, count: int) -> DataFrame:
    """(u, v) of distinct fingerprints (fp): for each variant that several emit, the lowest of them with each other one."""
    half = RADIUS // 2
    k = max(4, min(32, (max(1, count) * 2081 // VARIANTS).bit_length() + 1))
    spend = F.array(*[F.struct(F.lit(int(m)).alias("mask"), F.lit(half - int(m).bit_count()).alias("left")) for m in masks(k, half)])
    rows = fps.select("fp", F.explode(spend).alias("s")).select(
        "fp", F.shiftrightunsigned("fp", 64 - k).bitwiseXOR(F.col("s.mask")).alias("prefix"), F.col("s.left").cast("long").alias("left")
    )
    return rows.groupBy("prefix").applyInPandas(_links(64 - k), "u long, v long").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """Rows with fp -> (fp, root): each distinct fingerprint with the root of its component, itself if it has no link."""
    fps = saved(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(fps, fps.count())).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    Null or empty texts have fingerprint zero and are linked like any other; repeated rows stay; an empty table gives none.
    Extra columns are not read.
    """
    rows = saved(fingerprints(docs, [column(docs, "doc_id", "long")]), "simhash")
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    named = saved(classes(rows).join(lowest, "fp"), "roots")
    names = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    ids = named.join(names, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(docs: DataFrame) -> DataFrame:
    """docs with file and row, where a row stands in the files it is read from; what is not read from such files is written first."""

    def placed(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.withColumns({"file": F.xxhash64(place["file_path"]), "row": place["row_index"]})

    try:
        return placed(docs)
    except AnalysisException:  # no row numbers
        return placed(saved(docs, "rows"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component, the one with the smallest doc_id stays.

    Null ids come last; of rows with one doc_id, or with none, the one with the smallest hash of the text stays, then the first in the
    files; so of equal rows one stays. Nulls and values of other columns play no part. Columns stay as they are; an empty table gives
    none. Rows are known by their place, and those that go are joined by it: texts move only if too many go to be broadcast.
    """
    names = docs.columns
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    placed = _placed(docs.toDF(*(f"c{i}" for i in range(len(names))))).withColumn("id", F.coalesce(doc_id.cast("long"), F.lit(0)))
    keyed = placed.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), "file", "row", "id", text.cast("string").alias("text"))
    place = ["file", "row", "id"]
    rows = saved(fingerprints(keyed, [F.col(c) for c in ("doc_id", "content", *place)]), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "id", "content", "file", "row")
    roots = saved(classes(rows).join(rows.groupBy("fp").agg(F.min(rank).alias("best")), "fp"), "roots")
    first = roots.groupBy("root").agg(F.min("best").alias("best"))
    stays = roots.select("fp", "root").join(first, "root").select("fp", "best")
    gone = saved(rows.join(stays, "fp").filter(rank != F.col("best")).select(place), "gone")
    return join_small(placed, gone, place, "left_anti").drop(*place).toDF(*names)
