"""The pipeline against its stages' brute-force versions."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from skein.llm import bpe, decontamination, quality
from tests.llm.test_simhash import brute_classes


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    for d in good:
        n, *_, repeat = quality.base_counts(texts[d])
        assert n >= 10 and 100 * repeat <= 20 * n
    first = {d for d, _, c in brute_classes([(d, texts[d]) for d in sorted(good)]) if d == c}
    items = {r.item_id: decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaks = {d for d in first if any(decontamination.myers(x, decontamination.normal(texts[d]), len(x) * decontamination.PERCENT // 100) for x in items.values())}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == first - leaks and len(out) == len(first - leaks)
    for r in out:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark, sf, tmp_path):
    rows = [(1, None, "en", "s", 0, "x"), (None, "", None, None, None, None), (2, "word " * 30, "en", "s", 5, "x"), (3, "some quite plain words that make up a text of more than ten words here", "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 8
