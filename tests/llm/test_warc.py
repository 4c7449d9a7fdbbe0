import hashlib
from collections import Counter

import pytest

from skein.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows):
    low = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            low[h] = min(p, low.get(h, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        first = low.get(h) if len(data) >= 100 else None
        again = first is not None and first != p
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def cases():
    big = "same payload é " * 20
    rows = [(i, f"http://a.example/{i}", big) for i in (5, 3, 9, 3)] + [(20, None, None), (21, "x\r\ny", ""), (22, "u", "short"), (23, "u", "short")]
    rows += [(None, "u", big), (None, "u", "only without id " * 20), (None, "u", "only without id " * 20)]
    rows += [(30 + i, "u", t) for i, t in enumerate([FAKE, "x" * 50 + FAKE * 3 + "y" * 80, "WARC/1.", "WWARC/1.WARC/WARC/1.1\r\n" * 9, "WARC/1.1\r\n\r\n", FAKE + "z" * 3000 + FAKE, "﻿WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + "q" * 200])]
    return rows + [(100 + i, f"http://b.example/{i}", f"<p>{i}</p>" * (i % 7 * 40)) for i in range(120)]


@pytest.mark.parametrize("split", [None, "5k"])
def test_written_and_read(spark, split):
    rows = cases()
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert Counter(map(tuple, warc.written_and_read(pages).collect())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_none(spark):
    assert warc.written_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_chain_ends(spark, tmp_path):
    record = lambda n, body, extra=0: f"WARC/1.1\r\nWARC-Type: resource\r\nX-Page: {n}\r\nContent-Length: {len(body) + extra}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "one") + record(2, "two") + record(3, "three", 7) + record(4, "four")).encode())
    (tmp_path / "b.warc").write_bytes((record(5, "five") + record(6, "six"))[:-12].encode())
    (tmp_path / "c.warc").write_bytes(b"no magic at the start " + record(7, "seven").encode())
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert {1, 2, 5} <= set(got) <= {1, 2, 3, 5, 6} and got[2].payload_bytes == 3


def test_op9(spark, sf):
    from skein.llm.queries import op9_warc

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert Counter(map(tuple, op9_warc(spark, sf).collect())) == brute(rows)


def test_long_ids_stay_exact(spark):
    n = 2**53 + 1
    rows = [(n, "u", "x" * 200), (n + 2, "u", "x" * 200), (n + 4, "u", "WARC/1." + "y" * 200), (None, "u", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted(((r.page_id, r.refers_to) for r in warc.written_and_read(pages).collect()), key=str)
    assert got == sorted([(n, None), (n + 2, n), (n + 4, None), (None, None)], key=str)
