import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from skein.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
PROTO = bpe.model_proto(RANKS)
ODD = [
    "", " ", "a", "\n", "  two  spaces ", "a\n\nb", "a \n b\n", "tab\tx\t y", "a\r\nb", "it's I'll '", "' s", "\0a b\0", "x y z", "　a b  c",
    "<|endoftext|> a<|endoftext|>", "ÀÉ ß ſ İ", "²③ Ⅷ 一二 12a", "😀 👨‍👩‍👧 a😀", "a\x1c b \x85 c", "x" * 3000, "ab" * 2000 + " " * 300, "​ a​ b", "�",
    "a᠎ b", "...!!! ,,, a.b", " \n a", "a \x0b b\x0c c", "é" * 500,
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})


def test_ids_equal_tiktoken(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LIMIT", 2000)
    encode, decode = bpe.encoder(PROTO, P.PATTERN), bpe.Decoder(PROTO)
    for text, ids in zip(ODD * 2, encode.ids(ODD) + [encode.ids([t])[0] for t in ODD]):
        want = reference.encode_ordinary(text)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), text
        assert decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_encoded(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    out = bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    for row, (i, text) in zip(out, rows):
        want = reference.encode_ordinary(text or "")
        data = b"".join(x.to_bytes(4, "little") for x in want)
        assert tuple(row) == (i, len(want), hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), want)
    assert bpe.encoded(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op5_against_tiktoken(spark, sf, reference):
    from skein.llm.queries import op5_byte_level_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_byte_level_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
