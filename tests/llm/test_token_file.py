import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import token_file

ODD = ["", None, " ", "a", "two  spaces ", "a\n\nb", "<|endoftext|>", "x <|endoftext|> y", "it's", "²③ Ⅷ 一二", "😀 é", "\0a b", "word " * 5000, "ab" * 4000]
JSON = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=3000), st.integers(0, 3000), st.integers(0, 3000))
def test_frames(ids, a, b):
    ids = np.array(ids, np.uint32)
    data = b"12345678" + token_file.frame(ids)
    assert (token_file.read_frame(data, 8) == ids).all()
    assert (token_file.read_frame(data, 8, a, b) == ids[a:b]).all()


def test_exceptions_are_few_and_widths_small():
    ids = np.arange(4096, dtype=np.uint32) % 7 + 1000
    ids[5], ids[2000] = 4_000_000_000, 0
    assert (token_file.read_frame(token_file.frame(ids)) == ids).all()
    assert len(token_file.frame(ids)) < 3 * 4096 // 2 + 2048


def brute(rows):
    t = Tokenizer.from_file(JSON)
    out, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [1 << 20, 3000])
def test_written_and_read(spark, tmp_path, monkeypatch, file_bytes):
    monkeypatch.setattr(token_file, "FRAME_IDS", 700)
    rows = [(i * 3 % 100, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, `file` long")
    token_file.write(docs, str(tmp_path / "x"), JSON, 2, file_bytes=file_bytes)
    assert sorted(map(tuple, token_file.read(spark, str(tmp_path / "x")).collect())) == sorted(brute(rows))


def test_ties_nulls_and_none(spark, tmp_path):
    rows = [(None, "null id"), (5, "same"), (5, "same"), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, token_file.written_and_read(docs, JSON, 2).collect())) == sorted(map(str, spark.createDataFrame(brute(rows), "doc_id long, start long, n_tokens long, ids_crc32 long").collect()))
    assert token_file.written_and_read(docs.limit(0), JSON, 2).count() == 0


def test_op10_against_the_library(spark, sf):
    from skein.llm.queries import op10_token_file

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_token_file(spark, sf).collect())) == brute(rows)
