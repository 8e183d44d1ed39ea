import datetime as dt
import random

import pytest

from strata.llm.list_asof import filter_captures, host_of, path_of, validity_intervals

EVENTS = "list string, verdict string, kind string, pattern string, day date, action string, row string"
CAPTURES = "page_id long, url string, fetched date, host string, month string"
D = dt.date


def day(n):
    return D(2020, 1, 1) + dt.timedelta(days=n)


def events(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], EVENTS).repartition(2)


def captures(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], CAPTURES).repartition(2)


def brute(events, captures):
    """Every capture against every key's state on its day."""
    out = []
    for page, url, fetched in captures:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].lower()
            path = "/" + rest.split("/", 1)[1] if "/" in rest else ""
        labels = host.split(".")
        asked = {("host", host)} if host else set()
        asked |= {("domain", ".".join(labels[i:])) for i in range(len(labels))} if host else set()
        segs = path.split("/")
        asked |= {("prefix", host + "/".join(segs[:i + 1])) for i in range(1, len(segs))} if host and path else set()
        best, n = None, 0
        for key in {e[:4] for e in events if None not in e}:
            if key[2:] not in asked or fetched is None:
                continue
            own = [e for e in events if e[:4] == key and None not in e and e[5] in ("add", "remove") and e[4] <= fetched]
            if own:
                last = max(e[4] for e in own)
                if all(e[5] == "add" for e in own if e[4] == last):
                    n += 1
                    best = max(best or (-1,), (len(key[3]), key[2], key[1], key[0], key[3], last))
        out.append((page, n, best[4] if best else None, best[5] if best else None, bool(best) and best[2] == "block"))
    return sorted(out, key=repr)


def run(spark, ev, cap):
    got = filter_captures(captures(spark, cap), events(spark, ev)).collect()
    return sorted(((r.page_id, r.n_active, r.ruling, r.listed_from, r.blocked) for r in got), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org"]
    patterns = [("host", h) for h in hosts] + [("domain", h) for h in [*hosts, "com"]] + [("prefix", h + p) for h in hosts for p in ("/x", "/x/y", "/z")]
    ev = []
    for _ in range(120):
        kind, p = r.choice(patterns)
        v = r.choice(["block", "allow"])
        ev.append((f"list {v}", v, kind, p, day(r.randrange(200)), r.choice(["add", "remove"])))
    cap = [(i, f"https://{r.choice(hosts)}{r.choice(['', '/', '/x', '/x/y/w', '/xx', '/z/1'])}", day(r.randrange(-5, 220))) for i in range(80)]
    assert run(spark, ev, cap) == brute(ev, cap)


def test_awkward_rows(spark):
    e = ("l", "block", "domain", "a.com")
    ev = [(*e, day(5), "add"), (*e, day(5), "add"), (*e, day(9), "remove"), (*e, day(9), "add"), (*e, day(20), "listed"), (*e, None, "add"), ("l", None, "host", "a.com", day(1), "add"),
          ("l", "block", "host", None, day(1), "add")]
    cap = [(1, "http://a.com/", day(5)), (1, "http://a.com/", day(5)), (2, "http://a.com", day(4)), (3, "http://x.a.com", day(9)), (4, None, day(6)), (5, "http://a.com", None), (None, "http://a.com", day(8)),
           (6, "nothing", day(6)), (7, "http://a.com/" + "p/" * 20_000, day(7)), (8, "http://nota.com", day(6))]
    got = run(spark, ev, cap)
    assert got == brute(ev, cap) and sum(g[4] for g in got) == 4


def test_no_rows(spark):
    cap = [(1, "http://a.com/", day(5))]
    assert run(spark, [], cap) == [(1, 0, None, None, False)]
    assert run(spark, [("l", "block", "host", "a.com", day(1), "add")], []) == []


def test_intervals_cross_months(spark):
    e = ("l", "block", "host", "a.com")
    got = validity_intervals(events(spark, [(*e, D(2020, 1, 3), "add"), (*e, D(2020, 1, 9), "add"), (*e, D(2020, 4, 1), "remove"), (*e, D(2021, 2, 1), "add")])).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to) for r in got] == [(D(2020, 1, 3), D(2020, 1, 9)), (D(2020, 1, 9), D(2020, 4, 1)), (D(2021, 2, 1), None)]


def test_hosts_and_paths(spark):
    urls = ["HTTPS://User:pw@Www.A.com.:8080/p/q?x#y", "http://a.com?x=/y", "http://a.com#/y", "ftp://h", "//h/p", "", "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(host_of(df.url), path_of(df.url)).collect()]
    assert got == [("www.a.com", "/p/q"), ("a.com", ""), ("a.com", ""), ("h", ""), ("", ""), ("", ""), ("", "/p")]
