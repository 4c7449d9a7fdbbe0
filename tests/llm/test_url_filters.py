import datetime as dt

from skein.llm import url_filters as u


def test_intervals(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = [("A.b", "domain", day(1), "add"), ("a.b", "domain", day(3), "add"), ("a.b", "domain", day(5), "remove"), ("a.b", "domain", day(5), "add"), ("a.b", "domain", day(9), "add"), ("c", "domain", day(2), "remove"), (None, "domain", day(2), "add"), ("c", "domain", None, "add")]
    entries += entries[:1]
    got = u.intervals(spark.createDataFrame(entries, "pattern string, kind string, day date, action string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a.b", "domain", day(1), day(3)), ("a.b", "domain", day(3), day(5)), ("a.b", "domain", day(9), None)]


def test_evaluated(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("b.c", "domain", day(2), "add"), ("a.b.c", "domain", day(3), "add"), ("b.c", "domain", day(4), "remove"), ("x.y/p/", "prefix", day(1), "add")], "pattern string, kind string, day date, action string")
    rows = [(1, "http://a.b.c/", day(1)), (2, "http://A.B.c:80/x", day(2)), (3, "https://u@a.b.c./", day(3)), (4, "http://b.c", day(4)), (5, "http://zb.c", day(3)), (6, "http://x.y/p/q", day(1)), (7, "http://x.y/pq", day(1)), (8, None, day(3)), (9, "/rel", day(3)), (10, "http://a.b.c/", None), (1, "http://a.b.c/", day(3)), (None, "http://z.x.y/p/", day(3))]
    captures = spark.createDataFrame([(*r, "o") for r in rows], "page_id long, url string, fetched date, spans string").drop("spans")
    got = {(r.page_id, r.fetched): (r.host, r.blocked, r.n_entries, r.pattern) for r in u.evaluated(captures, entries).collect()}
    assert got == {
        (1, day(1)): ("a.b.c", False, 0, None), (2, day(2)): ("a.b.c", True, 1, "b.c"), (3, day(3)): ("a.b.c", True, 2, "a.b.c"), (4, day(4)): ("b.c", False, 0, None),
        (5, day(3)): ("zb.c", False, 0, None), (6, day(1)): ("x.y", True, 1, "x.y/p/"), (7, day(1)): ("x.y", False, 0, None), (8, day(3)): (None, False, 0, None), (9, day(3)): (None, False, 0, None),
        (10, None): ("a.b.c", False, 0, None), (1, day(3)): ("a.b.c", True, 2, "a.b.c"), (None, day(3)): ("z.x.y", False, 0, None),
    }
    assert u.evaluated(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in u.evaluated(captures, entries.limit(0)).collect())


def test_prefix_paths_keep_their_case(spark):
    entries = u.values(spark, [("X.y/Blog/", "prefix", "2024-01-01", "add"), ("x.y/Blog/2", "prefix", "2024-01-01", "add"), ("X.Y", "domain", "2024-02-01", "add")])
    rows = [("http://x.Y/Blog/1", 2), ("http://x.y/blog/1", 2), ("http://x.y/Blog/22", 2), ("http://x.y/Blog/22", 40), ("http://a.x.y/", 40), ("http://x.y", 2)]
    captures = spark.createDataFrame(rows, "url string, n int").selectExpr("url", "date_add(date'2024-01-01', n) as fetched")
    got = {(r.url, r.fetched.timetuple().tm_yday - 1): (r.n_entries, r.pattern) for r in u.evaluated(captures, entries).collect()}
    assert got == {("http://x.Y/Blog/1", 2): (1, "x.y/Blog/"), ("http://x.y/blog/1", 2): (0, None), ("http://x.y/Blog/22", 2): (2, "x.y/Blog/2"), ("http://x.y/Blog/22", 40): (3, "x.y/Blog/2"), ("http://a.x.y/", 40): (1, "x.y"), ("http://x.y", 2): (0, None)}


def test_clashing_names(spark):
    captures = spark.sql("select 'http://casino-win.example.com/' as url, date'2024-02-01' as fetched, 1 as spans, 2 as `a.b`, 3 as HOST, 4 as pattern, 5 as best, 6 as c0, 7 as day, 8 as address")
    out = u.evaluated(captures, u.values(spark))
    assert out.columns == ["url", "fetched", "spans", "a.b", "best", "c0", "day", "address", "host", "blocked", "n_entries", "pattern", "since"]
    assert [tuple(r)[2:-1] for r in out.collect()] == [(1, 2, 5, 6, 7, 8, "casino-win.example.com", True, 1, "casino-win.example.com")]
    assert u.evaluated(captures, u.values(spark).limit(0)).first().blocked is False
