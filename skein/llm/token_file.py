"""Token ids in binary files of patched frame-of-reference blocks.

A file is a row of frames, each ended by a line feed. A data frame holds the ids of whole runs of documents in blocks of 1024:

    "PFR1" ids blocks exceptions                 4 x 4 bytes, numbers little-endian
    start of each block in the packed part       4 bytes each
    minimum of each block                        4 bytes each
    exceptions of each block                     2 bytes each
    bit width of each block                      1 byte each, then zeros up to a multiple of 8
    packed part                                  128 x width bytes a block
    exceptions: place in the block, value        2 bytes each, then 4 bytes each

A block stores its ids less their minimum in as many bits as the 95th percentile of these differences takes; differences that
need more are exceptions with their full value. The index frame comes last: "PFIX", the file's number, the offset and number of
ids of each data frame, and doc_id (with a null flag) and number of ids of each document; 8 bytes with the index frame's offset
and "PFEN" end it.

Spark's own text writer writes the frames (a row each, bytes as they are) and its committer puts the files in place, so any
store that Spark writes to will do and a lost executor's files are written again.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.bpe import CUT, Pieces, piece
from skein.llm.common import column, new_path, remembered, saved, slices

BLOCK = 1024
PERCENTILE = 95
#: A data frame is closed when it has so many ids or more.
FRAME_IDS = 1 << 19
#: Bytes of text that go to a file, about.
FILE_BYTES = 32 << 20


def _shifts(width: int) -> list[tuple[int, int, int]]:
    """For each of 64 numbers of a lane: its number, its first word and its bit there."""
    return [(j, *divmod(j * width, 64)) for j in range(64)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) -> (blocks, 16 x width) words of 64 bits."""
    lanes = values.reshape(-1, BLOCK // 64, 64)
    out = np.zeros((*lanes.shape[:2], width), np.uint64)
    for j, word, bit in _shifts(width):
        v = lanes[:, :, j].astype(np.uint64)
        out[:, :, word] |= v << np.uint64(bit)
        if bit + width > 64:
            out[:, :, word + 1] |= v >> np.uint64(64 - bit)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), BLOCK // 64, width)
    out = np.empty((len(words), BLOCK // 64, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j, word, bit in _shifts(width):
        v = lanes[:, :, word] >> np.uint64(bit)
        if bit + width > 64:
            v |= lanes[:, :, word + 1] << np.uint64(64 - bit)
        out[:, :, j] = v & mask
    return out.reshape(len(words), BLOCK)


def frame(ids: np.ndarray) -> bytes:
    """A data frame of unsigned 32-bit ids."""
    n = len(ids)
    blocks = np.pad(ids, (0, -n % BLOCK), mode="edge").reshape(-1, BLOCK) if n else np.empty((0, BLOCK), np.uint32)
    low = blocks.min(axis=1) if n else np.empty(0, np.uint32)
    rest = blocks - low[:, None]
    kth = BLOCK * PERCENTILE // 100
    chosen = np.partition(rest, kth, axis=1)[:, kth] if n else low
    widths = np.array([int(x).bit_length() for x in chosen.tolist()], np.uint8)
    starts = np.concatenate(([0], np.cumsum(widths.astype(np.int64) * (BLOCK // 8)))).astype(np.int64)
    packed = np.empty(starts[-1] // 8, np.uint64)
    limit = (np.uint64(1) << widths.astype(np.uint64))[:, None]
    over = rest >= limit
    for width in np.unique(widths):
        if width:
            at = np.flatnonzero(widths == width)
            words = _pack(rest[at] & np.uint32((1 << int(width)) - 1), int(width))
            packed[(starts[at] // 8)[:, None] + np.arange(words.shape[1])] = words
    block, place = np.nonzero(over)
    counts = np.bincount(block, minlength=len(blocks)).astype("<u2")
    head = struct.pack("<4sIII", b"PFR1", n, len(blocks), len(block))
    tables = starts[:-1].astype("<u4").tobytes() + low.astype("<u4").tobytes() + counts.tobytes() + widths.tobytes()
    return head + tables + bytes(-len(tables) % 8) + packed.astype("<u8").tobytes() + place.astype("<u2").tobytes() + rest[block, place].astype("<u4").tobytes()


def read_frame(data: bytes, at: int = 0, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids start to stop of the data frame at an offset; only the blocks that hold them are unpacked."""
    magic, n, blocks, n_over = struct.unpack_from("<4sIII", data, at)
    if magic != b"PFR1":
        raise ValueError("no data frame here")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    at += 16
    starts = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
    low = np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    counts = np.frombuffer(data, "<u2", blocks, at + 8 * blocks)
    widths = np.frombuffer(data, np.uint8, blocks, at + 10 * blocks)
    at += (11 * blocks + 7) // 8 * 8
    size = int(widths.astype(np.int64).sum()) * (BLOCK // 8)
    packed = np.frombuffer(data, "<u8", size // 8, at)
    first, last = start // BLOCK, (stop - 1) // BLOCK + 1
    out = np.zeros((last - first, BLOCK), np.uint32)
    for width in np.unique(widths[first:last]):
        if width:
            own = np.flatnonzero(widths[first:last] == width)
            words = packed[(starts[first + own] // 8)[:, None] + np.arange(BLOCK // 64 * int(width))]
            out[own] = _unpack(words, int(width))
    ends = np.cumsum(counts, dtype=np.int64)
    a, b = int(ends[first] - counts[first]), int(ends[last - 1])
    place = np.frombuffer(data, "<u2", n_over, at + size)[a:b]
    values = np.frombuffer(data, "<u4", n_over, at + size + 2 * n_over)[a:b]
    out[np.repeat(np.arange(last - first), counts[first:last]), place] = values
    return (out + low[first:last, None]).reshape(-1)[start - first * BLOCK : stop - first * BLOCK]


def _index(number: int, frames: list[tuple[int, int]], docs: list[int | None], sizes: list[int], at: int) -> bytes:
    null = bytes(d is None for d in docs)
    body = struct.pack("<4sQQQ", b"PFIX", number, len(frames), len(docs)) + np.array(frames, "<u8").tobytes()
    body += np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + null
    return body + struct.pack("<Q4s", at, b"PFEN")


def read_index(data: bytes) -> tuple[int, np.ndarray, list[int | None], np.ndarray]:
    """The number of a file, (offset, ids) of its data frames, and the id and number of ids of its documents."""
    at, magic = struct.unpack_from("<Q4s", data, len(data) - 13)
    if magic != b"PFEN":
        raise ValueError("no index at the end of this file")
    magic, number, n_frames, n_docs = struct.unpack_from("<4sQQQ", data, at)
    at += 28
    frames = np.frombuffer(data, "<u8", 2 * n_frames, at).reshape(-1, 2).astype(np.int64)
    at += 16 * n_frames
    docs = np.frombuffer(data, "<i8", n_docs, at).tolist()
    sizes = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    null = data[at + 16 * n_docs : at + 17 * n_docs]
    return number, frames, [None if e else d for d, e in zip(docs, null)], sizes


class Tokens:
    """Ids of whole texts as the tokenizers library gives them without special tokens around."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())  # which the library takes out of a text first
        cut = self.tokenizer.model.tokenize
        self.pieces = Pieces(pattern, lambda tokens: [[x.id for x in cut(piece(t))] for t in tokens], added)

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and where each text's end."""
        flat, ends = self.pieces.arrays(texts, lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        ends = ends[1:] + np.arange(1, len(ends))
        out = np.full(len(flat) + len(ends), end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[own] = flat
        return out, ends


def _frames(path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered(("tokens", path, pattern), lambda: Tokens(path, pattern))
        held, n, at, frames, docs, sizes = [], 0, 0, [], [], []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, at
            data = frame(np.concatenate(held))
            frames.append((at, n))
            held, n, at = [], 0, at + len(data) + 1
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])

        for batch in batches:
            for part in slices(batch, most=CUT):
                ids, ends = tokens.ended(part.column("text"), end_id)
                docs += part.column("doc_id").to_pylist()
                sizes += np.diff(ends, prepend=0).tolist()
                start = 0
                while start < len(ids):
                    last = int(np.searchsorted(ends, start + FRAME_IDS - n))  # the first document that fills the frame
                    stop = int(ends[min(last, len(ends) - 1)])
                    held.append(ids[start:stop])
                    n += stop - start
                    start = stop
                    if n >= FRAME_IDS:
                        yield from closed()
        if docs:
            if n:
                yield from closed()
            yield pa.RecordBatch.from_arrays([pa.array([_index(TaskContext.get().partitionId(), frames, docs, sizes, at)], pa.binary())], names=["frame"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_buffer()
            if not len(data):
                continue
            number, frames, docs, sizes = read_index(data)
            ends = np.cumsum(sizes)
            crcs, frame_at, first = [], 0, 0
            have, k = b"", 0
            for n in sizes.tolist():
                while len(have) - k < 4 * n:
                    have, k = have[k:] + read_frame(data, int(frames[frame_at][0])).astype("<u4").tobytes(), 0
                    frame_at += 1
                crcs.append(zlib.crc32(have[k : k + 4 * n]))
                k += 4 * n
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([number] * len(docs), pa.int64()), "doc_id": pa.array(docs, pa.int64()), "before": pa.array(ends - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
            })


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, pattern: str = public_tokenizers.PATTERN, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every whole text, each document ended by end_id, in ascending order of doc_id, to files in path.

    Null ids come first; equal ids are in order of their texts' hashes; a null text has the end id only. The files' numbers
    ascend with doc_id. Rows are dealt by ranges of doc_id, hash of the text and partition read from, so that no id fills a file.
    """
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.withColumn("from", F.spark_partition_id()).repartitionByRange(-(-total // file_bytes) or 1, *keys, "from").sortWithinPartitions(*keys).drop("from")
    framed = dealt.mapInArrow(_frames(tokenizer, pattern, end_id), "frame binary")
    framed.select(F.col("frame").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the files alone. start counts the ids of all documents before it."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    rows = saved(files.mapInArrow(_documents, "file long, doc_id long, before long, n_tokens long, ids_crc32 long"), "tokens")
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    bases = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
