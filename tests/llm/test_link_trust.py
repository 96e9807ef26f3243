import re
from collections import defaultdict

import duckdb

from quern.llm import link_trust as lt

SCHEMA = "page_id long, url string, html string"


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in lt.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, said = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
    return host, path, rule, said


def brute(rows):
    pages = [(i, *judged(u), x or "") for i, u, x in rows]
    seed = [defaultdict(int), defaultdict(int)]
    for kind, verdict in enumerate(("allow", "block")):
        hosts = [h for _, h, _, _, said, _ in pages if h and said == verdict]
        for h in set(hosts):
            seed[kind][h] = lt.MASS * hosts.count(h) // len(hosts) * 15 // 100
    links = set()
    for _, host, _, _, _, text in pages:
        for dst in re.findall(r"""<a\s[^<>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", text, re.I):
            if host and host != dst.lower():
                links.add((host, dst.lower()))
    ranks = [dict(s) for s in seed]
    for _ in range(lt.ROUNDS):
        new = [defaultdict(int, s) for s in seed]
        for a, b in links:
            new[0][b] += ranks[0].get(a, 0) * 85 // (100 * sum(x == a for x, _ in links))
            new[1][a] += ranks[1].get(b, 0) * 85 // (100 * sum(y == b for _, y in links))
        ranks = new
    bad = {h for h in ranks[1] if ranks[1][h] > lt.RATIO * ranks[0].get(h, 0)}
    return sorted(str((i, h, p, rule, said or ("block" if h in bad else "allow"))) for i, h, p, rule, said, _ in pages)


def check(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as host", "0L as trust", "'x' as rule", "'y' as src")
    got = sorted(map(str, map(tuple, lt.op12(pages).collect())))
    assert got == brute(rows)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    assert got == sorted(map(str, con.execute(lt.ORACLE).fetchall()))
    return {r.page_id: r for r in lt.op12(pages).collect()}


def link(*to):
    return "<html>" + "".join(f'<a class=x href="{t}">t</a>' for t in to) + "</html>"


WEB = [
    (1, "http://good.org/x", link("http://friend.net/", "//Second.NET:80/p", "/own", "mailto:a@b.c")),
    (2, "http://bad.com/de/1", link("http://good.org/")),
    (3, "http://farm.net/a", link("https://bad.com/de/1", "http://bad.com/de/2")),
    (4, "http://ring.net/a", "<A title='a' HREF = 'http://farm.net/a?x'>t</A>"),
    (5, "http://friend.net/y#top", link("http://third.net", "http://friend.net/z")),
    (6, "http://third.net?q", None),
    (7, "http://lone.net/", link("http://")),
    (8, "http://bad.com/en/1", "<link href='http://farm.net/'>"),
]


def test_trust_and_distrust_spread(spark):
    got = check(spark, WEB)
    assert {i for i, r in got.items() if r.verdict == "block"} == {2, 3, 4, 8}  # distrust goes back over two links, and to pages beside the seed
    assert got[1].rule == "org/" and got[5].verdict == got[6].verdict == got[7].verdict == "allow"


def test_rules_and_hosts(spark):
    urls = [
        "https://WWW.Example.ORG/es/a?b", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://a.org", "http://fake.xorg/",
        "http://x.com/fr/1#f", "http://x.com/de/1", "http://x.com/DE/1", "HTTP://ÄB.com/de/\n1", None, "", "no scheme.org/", "://org/x", "a://b://c.org/", "http://u:p@h.com:8/fr/?/de/", "http:///x",
    ]
    got = check(spark, [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], None)])
    assert got[0].rule == "example.org/es/" and got[0].host == "www.example.org" and got[1].rule == "example.org/en/1" and got[2].rule == got[3].rule == "org/"
    assert [got[i].rule for i in (5, 6, 11, 13)] == [None] * 4 and got[11].host == "" and got[11].verdict == "allow"


def test_many_links_and_a_hub(spark):
    rows = [(i, f"http://h{i % 37}.net/{i}", link(*[f"http://h{(i * k) % 37}.net/" for k in (2, 3, 5)], "http://hub.net/")) for i in range(90)]
    rows += [(100 + i, f"http://s{i}.com/{'de' if i % 3 else 'fr'}/", link(f"http://h{i}.net")) for i in range(9)] + [(200 + i, f"http://h{i}.net/bad", link(f"http://s{i}.com/de/")) for i in range(9)]
    check(spark, rows)


def test_table_and_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    check(spark, [tuple(r) for r in pages.collect()])
    assert lt.op12(spark.createDataFrame([], SCHEMA)).count() == 0
