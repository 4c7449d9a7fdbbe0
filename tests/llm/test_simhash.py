import random

import numpy as np
import pytest
import xxhash

from skein.llm import simhash
from skein.llm.components import components


def brute_fingerprint(text):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        data = data.replace(c, " ")
    words = [w for w in data.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """Smallest id reachable over links of at most 4 bits, by comparing all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def test_fingerprint():
    for text in ["", None, "One", "a b c", "A b\tC d", "x y z w " * 50, "é ü ö İ ſ w", "\x1c a \x85 b"]:
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_meet_finds_all_links(seed, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS", 5000)
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b for b in base} | {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(6)}
    fps = sorted(fps)
    out = []
    simhash._meet(np.array(fps, np.uint64), np.full(len(fps), 2), 64, out)
    got = {tuple(map(int, p)) for o in out for p in o}
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40) if i % 13] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(30)] + [(7, 7)] + [(500, i) for i in range(501, 560)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if want[a] is not want[b]:
            both = want[a] | want[b]
            for x in both:
                want[x] = both
    assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def table(spark, rows):
    return spark.createDataFrame([(d, t, "src0", d) for d, t in rows], "doc_id long, text string, fp string, `__skein` long")


def cases():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    long = [rng.choice(words) for _ in range(3000)]
    rows = [(10, " ".join(long)), (11, " ".join(long[:-1] + ["other"])), (12, " ".join(rng.sample(words, 200)))]
    rows += [(20, None), (21, ""), (22, " \n"), (None, "a b"), (30, "a b"), (30, "a b"), (31, "A  B"), (None, "zz yy xx ww vv")]
    return rows + [(40 + i, "same text in many rows of this table here") for i in range(30)]


def test_near_copies(spark):
    got = simhash.near_copies(table(spark, cases())).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes_safe(cases()), key=key)
    assert simhash.near_copies(table(spark, [])).count() == 0


def brute_classes_safe(rows):
    """As brute_classes, for ids that may be null."""
    marked = [(i, t) for i, (_, t) in enumerate(rows)]
    root = {i: c for i, _, c in brute_classes(marked)}
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(d, low.get(root[i], d))
    return [(d, f"{brute_fingerprint(t):016x}", low.get(root[i])) for i, (d, t) in enumerate(rows)]


def test_one_of_each(spark):
    docs = table(spark, cases())
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in got.collect()) == [(False, 10), (False, 12), (False, 20), (False, 30), (False, 40), (True, 0)]


def test_one_of_each_and_nulls(spark, tmp_path):
    """Nulls in other columns, equal rows, clashing names, and a table read from files."""
    rows = [(1, None, "x y z", 1), (7, None, "x y z", None), (7, "x y z", None, 2), (7, "x y z", None, 2), (None, None, None, None), (None, "q", "x y z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string, row long")
    docs.write.parquet(str(tmp_path / "docs"))
    for table, want in ((docs.withColumnRenamed("a", "text"), [1, 7, None]), (spark.read.parquet(str(tmp_path / "docs")).withColumnRenamed("b", "text"), [1, 7])):
        got = simhash.one_of_each(table)
        assert got.columns == table.columns
        assert [r.doc_id for r in got.orderBy(got.doc_id.asc_nulls_last()).collect()] == want


def test_op6_against_brute_force(spark, sf):
    from skein.llm.queries import op6_simhash_near_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_simhash_near_dedup(spark, sf).collect())) == brute_classes(rows)
