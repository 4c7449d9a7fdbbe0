import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import decontamination as d


def brute(item, text):
    """Least edit distance of item to any part of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", max_size=60), st.integers(0, 12))
def test_myers(item, text, most):
    want = brute(item, text)
    got = d.myers(item, text, most)
    assert got == (want if want[0] <= most else None)


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice([[], [rng.choice("abcdef")], [text[i], rng.choice("abcdef")]])
    return "".join(text)


def made(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))
    items = [(i, prose(rng.randrange(4, 40))) for i in range(12)] + [(50, "tiny one"), (51, ""), (None, prose(20)), (52, None)]
    rows = []
    for i in range(60):
        text = prose(rng.randrange(0, 150))
        if i % 2:
            item = items[rng.randrange(12)][1]
            text += " " + changed(rng, item, rng.randrange(0, len(item) // 8)).upper() + ",  " + prose(30)
        rows.append((i, text))
    return items, rows + [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1])]


def expected(items, rows):
    out = []
    for doc, text in rows:
        text = d.normal(text)
        for i, item in items:
            item = d.normal(item)
            if i is None or len(item) < d.LEAST:
                continue
            errors, end = brute(item, text)
            if errors <= len(item) * d.PERCENT // 100:
                out.append((doc, i, errors))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    items, rows = made(4)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = expected(items, rows)
    assert len(want) > 20
    for size in (1 << 20, 300):  # at once, and slice by slice
        monkeypatch.setattr(d.item_slices, "__defaults__", (size,))
        assert sorted((tuple(r[:3]) for r in d.contaminated(docs, bench).collect()), key=str) == want
        left = d.clean(docs, bench)
        assert left.columns == docs.columns
        assert sorted(map(str, left.select("doc_id").collect())) == sorted(f"Row(doc_id={a})" for a, _ in rows if not any(w[0] == a for w in want))
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == len(rows)


def test_op4_against_brute_force(spark, sf):
    """All documents that hold an item; brute force over the parts of documents that share a word pair's start with it."""
    from skein.llm.queries import op4_benchmark_decontamination

    docs = {r.doc_id: d.normal(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: d.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {tuple(r[:3]) for r in op4_benchmark_decontamination(spark, sf).collect()}
    want = {(a, i, m[0]) for a, t in docs.items() for i, x in items.items() if (m := d.myers(x, t, len(x) * d.PERCENT // 100))}
    assert got == want


def test_short_items(spark):
    items = [(1, "What is 17 x 23?"), (2, "日本の首都はどこですか"), (3, "art"), (4, "?"), (5, "")]
    rows = [(1, "Q: what is 17 x 23 ... 391"), (2, "問題。次の日本の首都はどこですか答えよ"), (3, "a party, an artist, smart"), (4, "party of ART"), (5, "what is 17 x 234? what is 17 x 2"), (6, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.contaminated(docs, bench).collect())) == [(1, 1, 0, 17), (2, 2, 0, 16), (4, 3, 0, 12)]
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [3, 5, 6]
