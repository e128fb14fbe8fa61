import datetime as dt

from trajframe.llm import url_lists as ul


def day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(n)


def run(spark, captures, entries):
    c = spark.createDataFrame([(i, u, day(d), "h", "p") for i, u, d in captures], "page_id long, url string, fetched_on date, host string, place string")
    e = spark.createDataFrame([(p, a, day(d), k, "x") for p, a, d, k in entries], "pattern string, action string, listed_on date, category string, ask string")
    return sorted(map(tuple, ul.temporal_filter(c, e).collect()), key=repr)


def slow(captures, entries):
    out = []
    for i, url, d in captures:
        best = []
        if url and d is not None and "://" in url:
            rest = url.split("://", 1)[1].lower()
            for c in "?#":
                rest = rest.split(c)[0]
            host, _, path = rest.partition("/")
            labels, parts = host.split("."), path.split("/")
            asked = {".".join(labels[k:]) for k in range(len(labels) - 1)} | ({host + "/" + "".join(x + "/" for x in parts[:k]) for k in range(len(parts))} if "/" in rest else set())
            for p in asked if host else ():
                events = sorted({(e[2], e[1] == "remove") for e in entries if e[0] and e[0].lower() == p and e[2] is not None and e[1] in ("add", "remove") and e[2] <= d})
                if events and not events[-1][1]:
                    since = events[-1][0]
                    for day_, off in reversed(events):
                        if off:
                            break
                        since = day_
                    kinds = [e[3] for e in entries if e[0] and e[0].lower() == p and e[2] == since]
                    best.append((-len(p), p, min(kinds), day(since)))
        m = min(best, default=None)
        out.append((i, url, day(d), m is not None, len(best), m and m[1], m and m[2], m and m[3]))
    return sorted(out, key=repr)


ENTRIES = [("b.com", "add", 10, "spam"), ("b.com", "remove", 20, "spam"), ("B.com", "add", 30, "adult"), ("b.com", "add", 35, "later"),
           ("x.b.com/en/", "add", 5, "phish"), ("x.b.com/", "add", 12, "root"), ("c.org", "add", 5, "a"), ("c.org", "remove", 5, "a"),
           (None, "add", 1, "n"), ("d.org", "add", None, "n"), ("d.org", "odd", 3, "n"), ("com", "add", 1, "tld"), ("e.net", "remove", 3, "x"), ("e.net", "add", 9, "x")]


def test_equals_slow_version(spark):
    urls = ["http://b.com/", "https://x.b.com/en/1?q=1", "https://X.b.com/en", "http://x.b.com", "http://notb.com/", "http://c.org/a/b/c", "http://d.org/", "http://e.net/?/en/", None, "", "b.com", "http:///x"]
    captures = [(i * 100 + d, u, d) for i, u in enumerate(urls) for d in (0, 4, 5, 9, 10, 19, 20, 29, 30, 36)]
    captures += [(7777, "http://b.com/", None), (7778, "http://b.com/p", 15), (7778, "http://b.com/p", 15), (None, "http://b.com/p", 15), (8, "http://b.com/" + "a/" * 400, 15)]
    assert run(spark, captures, ENTRIES) == slow(captures, ENTRIES)


def test_empty_sides(spark):
    got = run(spark, [(1, "http://b.com/", 12)], ENTRIES[:1])
    assert got[0][3] is True
    c = spark.createDataFrame([(1, "http://b.com/", day(1))], "page_id long, url string, fetched_on date")
    e = spark.createDataFrame([], "pattern string, action string, listed_on date, category string")
    assert [r.blocked for r in ul.temporal_filter(c, e).collect()] == [False]
    assert ul.temporal_filter(c.where("page_id > 1"), e).collect() == []
