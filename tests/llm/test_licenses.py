import re
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq

from skein.llm import licenses


def brute(rows):
    best = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        units = [(i + 1, x) for i, x in enumerate(lines)] + ([(0, text)] if text and "\n" in text else [])
        for line, unit in units:
            words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in unit))
            own = set(zip(words, words[1:]))
            for _, name, pairs in licenses.template_bigrams():
                theirs = {tuple(p.split()) for p in pairs}
                dice = Fraction(2 * len(own & theirs), len(own) + len(theirs))
                if dice >= licenses.THRESHOLD:
                    key = (-round(float(dice), 6), line)
                    best[doc, name] = min(key, best.get((doc, name), key))
    return sorted(((d, n, -a, b) for (d, n), (a, b) in best.items()), key=str)


def cases():
    notices = [" ".join(lines) for _, lines in licenses.TEMPLATES]
    rows = [(i, f"prose of the text\n{n.upper()}.\nmore of the same prose") for i, n in enumerate(notices)]
    rows += [(50 + i, "\n".join(lines)) for i, (_, lines) in enumerate(licenses.TEMPLATES)]
    rows += [(80 + i, n + " and one two three") for i, n in enumerate(notices)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "mit"), (104, "é" * 2000 + "\n" + "the of " * 3000), (None, notices[0]), (None, notices[2]), (5, notices[0]), (5, notices[0])]
    return rows


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(a, b, "x") for a, b in cases()], "doc_id long, text string, license string")
    assert sorted((tuple(r) for r in licenses.scanned(docs).collect()), key=str) == brute(cases())
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_bounds_and_probes_lose_nothing():
    t = licenses.THRESHOLD
    for _, _, pairs in licenses.template_bigrams():
        m = len(pairs)
        low, high = licenses.bounds(m)
        for n in range(1, 4 * m):
            assert (Fraction(2 * min(n, m), n + m) >= t) == (low <= n <= high)
        without = m - len(licenses.probes(pairs))
        assert Fraction(2 * without, without + m) < t


def test_op2(spark, sf):
    from skein.llm.queries import op2_license_scan

    frame = op2_license_scan(spark, sf)
    assert "Python" not in frame._jdf.queryExecution().toString()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == brute(rows) and got


def runs(rows, by_word):
    """Every run of lines, or of words, of at most high bigrams."""
    best = {}
    for doc, text in rows:
        words = [(w, i + 1) for i, x in enumerate(text.split("\n")) for w in re.findall("[a-z0-9]+", x.lower())]
        starts = [i for i in range(len(words)) if by_word or not i or words[i - 1][1] != words[i][1]]
        stops = {i for i in range(len(words)) if by_word or i + 1 == len(words) or words[i + 1][1] != words[i][1]}
        for _, name, pairs in licenses.template_bigrams():
            theirs = {tuple(p.split()) for p in pairs}
            low, high = licenses.bounds(len(theirs))
            for a in starts:
                for b in range(a + low, a + high + 1):
                    if b in stops:
                        only = [w for w, _ in words[a : b + 1]]
                        own = set(zip(only, only[1:]))
                        dice = Fraction(2 * len(own & theirs), len(own) + len(theirs))
                        if dice >= licenses.THRESHOLD:
                            key = (-round(float(dice), 6), words[a][1])
                            best[doc, name] = min(key, best.get((doc, name), key))
    return best


def test_runs_against_brute_force(spark):
    prose = lambda k, n: "\n".join(f"line {i} of {k} text\n" for i in range(n))
    rows = [(i, prose(i, i * 9) + "\n" + "\n".join(f" * {x}" for x in lines) + "\n" + prose(i, 40)) for i, (_, lines) in enumerate(licenses.TEMPLATES)]
    rows += [(50 + i, "one two " * (5 + i) + " ".join(lines) + " and three four of it" * 30) for i, (_, lines) in enumerate(licenses.TEMPLATES)]
    rows += [(80 + i, "some words " * 3 + "Released\nunder the " * i + "MIT License for " + str(i) + " more\n" * 3) for i in range(3)]
    rows += [(90, ("x y\n" * 250 + "Released under\nthe MIT License\n") * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for by_word in (False, True):
        best = runs(rows, by_word)
        for doc, name, dice, line in brute(rows):
            best[doc, name] = min((-dice, line), best.get((doc, name), (0, 0)))
        got = licenses.scanned(docs, by_word)
        assert "Python" not in got._jdf.queryExecution().toString()
        got = {(r.doc_id, r.license): (-r.dice, r.line) for r in got.collect()}
        assert got == best
        for i, (name, _) in enumerate(licenses.TEMPLATES):  # wrapped as in the table, in a longer text; inside a paragraph
            assert got[i, name][0] == -1
            assert not by_word or got[50 + i, name] == (-1, 1)


def test_texts_left_out_hold_no_licence():
    """A unit that reaches a template has so many of its bigrams that one of them holds a telling word."""
    words = licenses.telling()
    for _, _, pairs in licenses.template_bigrams():
        without = [p for p in pairs if not any(w in x for x in p.split() for w in words)]
        assert len(without) < licenses.bounds(len(pairs))[0]


def test_sql_has_runs_of_lines(spark, tmp_path):
    from tests.oracle import compare

    notices = [lines for _, lines in licenses.TEMPLATES]
    rows = [(i, "first line\n\n" + "\n".join(lines) + "\nlast line of it\n" + "words and words\n" * 30) for i, lines in enumerate(notices)] + cases()
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), tmp_path / "documents.parquet")
    scan = lambda s, d: licenses.scanned(s.read.parquet(f"{d}/documents.parquet"))
    assert compare(spark, str(tmp_path), scan, licenses.sql()) > 60
