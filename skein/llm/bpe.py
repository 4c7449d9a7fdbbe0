"""Byte-level BPE by sentencepiece: a model written straight from a rank file, encoding and decoding.

The vocabulary's byte strings become pieces by mapping each byte to a printable character; a piece's score is its negative rank,
so sentencepiece merges in rank order; normalisation is the identity. Pre-tokens are encoded separately, and ids are decoded by
the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from skein.llm.common import column, remembered, slices

#: Bytes of parts of texts and their ids that a Python worker remembers, and the most of one part.
LIMIT = 96 << 20
LONG = 64
#: Bytes that a part takes beside its characters and ids, about.
ENTRY = 160
#: Bytes of text that are cut at once.
CUT = 2 << 20
_SPACES = (" ", "\n")
_BETWEEN = re.compile(r"(?<=\w)[ \n](?=\w)")
_MARK_BEHIND_WORD = r"(\pL)([.,!?;:#%$&*])"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


BYTE_CHARACTERS = byte_characters()
_TO_PIECE = dict(enumerate(BYTE_CHARACTERS))


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_PIECE)


def piece(text: str) -> str:
    """The printable characters that stand for a text's bytes."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _TO_PIECE[32])
    return mapped(text.encode("utf-8"))


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank, by rank, of a file with a base64 string and a rank on each line."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(data) for data, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protobuf message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model of type BPE whose piece i is pieces[i]; the unknown piece comes last and is never used."""
    if not {bytes([b]) for b in range(256)} <= set(pieces):
        raise ValueError("a byte is not in the vocabulary")
    body = b"".join(_field(1, _field(1, mapped(p).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, p in enumerate(pieces))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(24, 0) + _field(35, 0) + _field(40, len(pieces))
    trainer += b"".join(_field(n, none) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normalizer)


class Pieces:
    """Encodes texts to unsigned 32-bit ids, remembering the ids of what it has met.

    pattern divides a text into pre-tokens; encode gives the ids of each of a list of pre-tokens. A text is cut before each space and
    line end, and before a mark that follows a letter. No match of the pattern holds a character that is not white space followed by
    one that is, or a letter followed by a mark, and of a run of white space only the last character joins what follows. So what lies
    between two cuts has the same ids wherever it stands, unless it begins or ends with other white space or two cuts with nothing
    between them follow each other; texts with these, with the cutting mark itself or with one of apart are divided as a whole.

    Cutting, finding the distinct parts and gathering ids are Arrow and NumPy operations over all parts of a batch of texts; Python
    looks up distinct parts only. Beyond LIMIT bytes, the parts met longest ago and all long ones are forgotten.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]], apart: tuple[str, ...] = ()):
        self.find, self.encode, self.apart = regex.compile(pattern).findall, encode, apart
        self.turn = self.bytes = 0
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        #: At the place of each part: where its ids begin, how many there are, 1 if it is one blank and 2 if it must not stand alone,
        #: and when it was last met.
        self.table = np.empty((4, 0), np.int32)

    def _put(self, parts: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        if not parts:
            return
        starts = len(self.flat) + np.cumsum(counts) - counts
        kinds = np.fromiter((0 if p.isalpha() or p[1:].isalpha() and p[0] in _SPACES else _kind(p) for p in parts), np.int32, len(parts))
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts))))
        self.bytes += sum(map(len, parts)) + 4 * len(flat) + ENTRY * len(parts)
        self.flat = np.concatenate([self.flat, flat])
        self.table = np.concatenate([self.table, np.stack([starts, counts, kinds, np.full(len(parts), self.turn)]).astype(np.int32)], axis=1)

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where each of some parts is in the table, -1 for unknown ones."""
        return np.fromiter(map(self.place.get, parts, repeat(-1)), np.int32, len(parts))

    def _tokens(self, tokens: list[str]) -> np.ndarray:
        """Places of distinct pre-tokens, encoding those that are not known."""
        at = self._places(tokens)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(new)) + len(self.place)
            missing = [tokens[i] for i in new]
            ids = self.encode(missing)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(missing, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)
        return at

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at some places one after another, and where each part's end, with 0 before."""
        counts = self.table[1][places].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[np.repeat(self.table[0][places] - ends[:-1], counts) + np.arange(ends[-1])], ends

    def _learn(self, parts: list[str]) -> None:
        """Divides new parts into pre-tokens and adds them. Most are a word, which needs no pattern."""
        words = [p for p in parts if p.isalpha() or p[1:].isalpha() and p[0] == " "]
        self._tokens(words)
        found = [(p, self.find(p)) for p in set(parts).difference(words)]
        number = {t: i for i, t in enumerate(set().union(*(f for _, f in found)))}
        places = self._tokens(list(number))
        found = [(p, f) for p, f in found if p not in number]
        sequence = np.fromiter((number[t] for _, f in found for t in f), np.int64)
        flat, ends = self._gathered(places[sequence])
        bounds = ends[np.cumsum([0, *(len(f) for _, f in found)])]
        self._put([p for p, _ in found], flat, np.diff(bounds))

    def _forget(self) -> None:
        if self.bytes <= LIMIT:
            return
        parts = list(self.place)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        short, sizes = sizes <= LONG, sizes + 4 * self.table[1] + ENTRY
        order = np.argsort(-self.table[3], kind="stable")
        order = order[short[order]]
        keep = np.sort(order[np.cumsum(sizes[order]) <= LIMIT * 3 // 4])
        self.flat, ends = self._gathered(keep)
        self.table = np.stack([ends[:-1].astype(np.int32), *self.table[1:, keep]])
        self.place = {parts[i]: n for n, i in enumerate(keep.tolist())}
        self.bytes = int(sizes[keep].sum())

    def whole(self, text: str) -> np.ndarray:
        found = self.find(text)
        number: dict[str, int] = {}
        sequence = np.fromiter((number.setdefault(t, len(number)) for t in found), np.int64, len(found))
        return self._gathered(self._tokens(list(number))[sequence])[0] if found else np.empty(0, np.uint32)

    def arrays(self, texts: pa.Array, whole: Callable[[str], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end, with 0 before. A null text has none.

        Texts of more than CUT characters are taken in pieces, cut at blanks between word characters. whole encodes the texts that hold
        one of apart.
        """
        texts = texts.cast(pa.string()).fill_null("")
        longest = pc.max(pc.binary_length(texts)).as_py() or 0
        if not longest:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if longest > CUT:
            return self._long(texts, whole)
        self.turn += 1
        special = np.zeros(len(texts), bool)
        for mark in self.apart:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        odd = special | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        marked = pc.replace_substring_regex(plain, _MARK_BEHIND_WORD, "\\1\0\\2")
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n"), " ", "\0 "), "\0")
        first, parts = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        distinct = _strings(parts.dictionary)
        places = self._places(distinct)
        if len(new := np.flatnonzero(places < 0)):
            self._learn(missing := [distinct[i] for i in new])
            places[new] = self._places(missing)
        self.table[3][places] = self.turn
        every = places[parts.indices.to_numpy()]
        flat, ends = self._gathered(every)
        bounds = ends[first]
        kinds = self.table[2][places]
        if kinds.any():
            kinds = kinds[parts.indices.to_numpy()]
            bad = kinds == 2
            pair = (kinds[1:] == 1) & (kinds[:-1] == 1)
            pair[first[1:-1] - 1] = False  # of two texts
            bad[1:] |= pair
            odd = odd | (np.add.reduceat(bad, first[:-1]) > 0)
        if odd.any():
            out, last, sizes = [], 0, np.diff(bounds)
            for i in np.flatnonzero(odd):
                text = texts[i].as_py()
                ids = whole(text) if special[i] and whole else self.whole(text)
                out += [flat[bounds[last] : bounds[i]], ids]
                sizes[i], last = len(ids), i + 1
            flat, bounds = np.concatenate([*out, flat[bounds[last] :]]), np.concatenate(([0], np.cumsum(sizes)))
        self._forget()
        return flat, bounds

    def _long(self, texts: pa.Array, whole: Callable[[str], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], []
        for text in texts.to_pylist():
            if whole and any(a in text for a in self.apart):
                ids = whole(text)
            else:
                ids = np.concatenate([self.whole(p) if len(p.encode()) > CUT else self.arrays(pa.array([p]))[0] for p in _cut(text, CUT // 4)])
            out.append(ids)
            sizes.append(len(ids))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        flat, ends = self.arrays(pa.array(texts, pa.string()))
        return [flat[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]


def _blank(c: str) -> bool:
    """White space of any kind, as Python, Unicode or the C library has it."""
    return c.isspace() or c in "\x1c\x1d\x1e\x1f\x85᠎​﻿"


def _kind(part: str) -> int:
    """1 for a blank alone, 2 for what begins, after the blank it was cut at, or ends with a blank, 0 for all else."""
    body = part[1:] if part[:1] in _SPACES else part
    if not body:
        return 1 if part else 0
    return 2 if _blank(body[0]) or _blank(body[-1]) else 0


def _strings(values: pa.Array) -> list[str]:
    """One or more strings without the cutting mark, faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values), "\0")[0].as_py().split("\0")


def _cut(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about so many characters, cut at blanks between word characters."""
    at = 0
    while len(text) - at > size and (found := _BETWEEN.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encoder(proto: bytes, pattern: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return Pieces(pattern, lambda tokens: model.encode(list(map(piece, tokens)), num_threads=1))


class Decoder:
    """Ids to bytes by the inverse of the byte mapping, over the pieces that the model itself holds."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        back = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
        self.piece = [bytes(back[c] for c in model.id_to_piece(i)) for i in range(model.vocab_size() - 1)].__getitem__

    def __call__(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.piece, ids.tolist()))


def _work(proto: bytes, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = remembered(("bpe", hash(proto.value), pattern), lambda: (encoder(proto.value, pattern).arrays, Decoder(proto.value)))
        for batch in batches:
            for part in slices(batch, most=CUT):
                flat, ends = encode(part.column("text"))
                texts = [flat[a:b] for a, b in zip(ends, ends[1:])]
                cols = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(np.diff(ends)),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in texts], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(decode(x)).hexdigest() for x in texts], pa.string()),
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def encoded(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids as little-endian unsigned 32-bit integers and of the bytes that they decode to.

    with_ids adds the ids themselves. A null text is an empty one, with no ids; repeated rows and null ids stay; an empty table
    gives none; extra columns are not read. Special tokens are ordinary text. Texts of any length are encoded whole.
    """
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    proto = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(rank_file)))  # as large as the vocabulary
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_work(proto, pattern, with_ids), schema)
