import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t#é\x1c\x85", max_size=120), st.text(max_size=60)))
def test_base_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def test_many_words():
    words = [str(i % 9000) for i in range(20000)]
    assert quality.repeated_words(words) == 20000
    assert quality.repeated_words([str(i) for i in range(20000)]) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \néx", max_size=12)), min_size=1, max_size=6))
def test_grams_of_each_text_stand_alone(texts):
    together = list(quality.grams(texts))
    for i, t in enumerate(texts):
        for (bins, bounds), (own, _) in zip(together, quality.grams([t])):
            assert bins[bounds[i] : bounds[i + 1]].tolist() == own.tolist()
    words = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert np.diff(together[-2][1]).tolist() == words
    assert np.diff(together[-1][1]).tolist() == [max(0, n - 1) for n in words]


def test_weights_by_features_and_by_lookup_agree():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=(quality.FAMILIES, quality.BINS)), 0.3, 1.0, 0.0)
    for text in ["", "a", "Some words and some words", "x" * 50 + " y"]:
        cols, shares = quality.features(text)
        score = 0.3 + (model.weights.ravel()[cols.astype(int)] * shares).sum()
        assert abs(model.probability([text])[0] - 1 / (1 + np.exp(-score))) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "w " * 40, "c"), (3, "one two", "d"), (3, "one two", "d")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels).collect()
    assert [(r.doc_id, *r[1:6]) for r in out] == [(d.doc_id, *brute_counts(d.text)) for d in docs.collect()]
    assert not any(r.kept for r in out)
    assert quality.kept(docs, labels).columns == docs.columns
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy_and_counts(spark):
    from skein.llm.queries import op1_quality_rules

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = op1_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in out} == {d: brute_counts(t) for d, t in texts.items()}
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= quality.THRESHOLD)
    even = quality.judged(docs, labels.filter("doc_id % 2 = 0")).collect()
    odd = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    found = [(r.kept, odd[r.doc_id]) for r in even if r.doc_id in odd and not r.base_failed]
    assert sum(k == bool(q) for k, q in found) >= 0.93 * len(found)
    assert {tuple(r) for r in quality.kept(docs, labels).select("doc_id").collect()} == {(r.doc_id,) for r in out if r.kept}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \né\t", min_size=1, max_size=80), st.integers(1, 30))
def test_long_texts_have_the_grams_of_uncut_ones(text, piece):
    want = np.stack([np.bincount(bins, minlength=quality.BINS) for bins, _ in quality.grams([text])])
    old, quality.PIECE = quality.PIECE, piece
    try:
        assert (quality.long_counts(text) == want).all()
    finally:
        quality.PIECE = old


def test_a_long_text_scores_as_if_uncut(monkeypatch):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=(quality.FAMILIES, quality.BINS)), 0.3, 1.0, 0.0)
    text = "".join(rng.choice(list("abcdefgh  \n"), 3_000_000))
    cut = model.probability(["x", text, None])
    monkeypatch.setattr(quality, "PIECE", 1 << 30)
    assert np.allclose(cut, model.probability(["x", text, None]), atol=1e-9)


def test_rare_labels_are_drawn(spark, monkeypatch):
    """30 bad documents among 3000: a sample of 100 has them all, and probabilities are those of the whole table."""
    rows = [(i, ("bad junk " if i % 100 == 0 else "good text ") * 3 + str(i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 100 > 0 as int) as quality")
    model = quality.train(docs, labels, 100)
    p = model.probability(["bad junk bad junk bad junk 7", "good text good text good text 7"])
    assert p[0] < 0.5 and p[1] > 0.9
