import re

import pytest

from mailshift.llm import queries, url_filters
from mailshift.llm.url_filters import Rule

RULES = (Rule("allow", "good.example", "/"), Rule("block", "good.example", "/bad"), Rule("block", "bad.example", "/"))
SCHEMA = "page_id bigint, url string, html string, host string, verdict string, trust int"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute(pages, rules, rounds=20, damping=0.85):
    """host -> trust and distrust, and the rows, by loops over dictionaries."""
    rows, links = [], {}
    for page_id, url, html in pages:
        host, path = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
        rows.append((page_id, host, path, best))
        for to in {parts("x://" + x)[0] for x in re.findall(r"""<a [^>]*?href=["']?(?:https?:)?//([^"'\s>]+)""", re.sub(r"(?s)<!--.*?-->|<script.*?</script", "", html or ""))}:
            if host and to and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    hosts = {}
    for _, host, _, _ in rows:
        if host:
            hosts[host] = hosts.get(host, 0) + 1
    for host, n in hosts.items():
        above = [o for o in hosts if host.endswith("." + o)]
        if above:
            top = max(above, key=len)
            links[host, top] = links.get((host, top), 0) + n
            links[top, host] = links.get((top, host), 0) + n
    everyone = set(hosts) | {x for e in links for x in e}
    seed = {h: [0.0, 0.0] for h in everyone}
    for _, host, _, best in rows:
        if host and best:
            seed[host][best.verdict == "block"] += 1
    rank = {h: list(v) for h, v in seed.items()}
    out, into = {}, {}
    for (a, b), w in links.items():
        out[a], into[b] = out.get(a, 0) + w, into.get(b, 0) + w
    for _ in range(rounds):
        new = {h: [(1 - damping) * v[0], (1 - damping) * v[1]] for h, v in seed.items()}
        for (a, b), w in links.items():
            new[b][0] += damping * rank[a][0] * w / out[a]
            new[a][1] += damping * rank[b][1] * w / into[b]
        rank = new
    told = {h: "block" if d > 0.500000001 * (t + d) else "allow" for h, (t, d) in rank.items()}
    return rank, [(p, h, x, b.text if b else None, b.verdict if b else told.get(h, "allow")) for p, h, x, b in rows]


def judged(spark, pages, rules=RULES):
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    hosts = url_filters.host_verdicts(table, rules)
    return hosts, url_filters.with_verdicts(table, hosts, rules)


def web():
    link = '<p>x <a class=c href="{}">y</a>'
    pages = [(k, f"http://www.good.example/{'bad' if k == 3 else 'p'}{k}", link.format("https://friend.example/x?y") + link.format("/home") + link.format("https://friend.example/z")) for k in range(6)]
    pages += [(10 + k, f"https://friend.example/{k}", link.format(f"//site{k}.example/a")) for k in range(3)]
    pages += [(20 + k, f"http://farm{k}.example/", link.format("http://BAD.example#x") + "<script>'<a href=\"http://no.example\">'</script><!-- <a href='http://no.example'> -->") for k in range(4)]
    pages += [(30, "http://feeder.example/a", link.format("http://farm2.example/")), (31, "http://bad.example/q", ""), (32, "http://shop.farm1.example/q", None),
              (33, "http://lonely.example", link.format("mailto:a@b")), (34, "http://site1.example/", link.format("http://bad.example/1"))]
    return pages


def test_query_against_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.op13_url_filters(spark, sf)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(brute(pages, queries.URL_RULES)[1], key=lambda r: r[0])


def test_trust_and_distrust_travel_along_links(spark):
    pages = web()
    hosts, rows = judged(spark, pages)
    rank, expected = brute(pages, RULES)
    got = {r.host: r for r in hosts.collect()}
    assert set(got) == set(rank)
    for host, (t, d) in rank.items():
        assert got[host].trust == pytest.approx(t, abs=1e-9) and got[host].distrust == pytest.approx(d, abs=1e-9)
    told = {r.page_id: tuple(r)[1:] for r in rows.select("page_id", "host", "path", "rule", "verdict").collect()}
    assert told == {r[0]: r[1:] for r in expected}
    # Who links to the blocked host shares its blame, further away too; whom trusted hosts link to is allowed.
    assert told[22][3] == told[30][3] == "block" and told[10][3] == "allow" and told[33][3] == "allow" and told[3][2:] == ("good.example/bad", "block")
    assert "no.example" not in got and "site2.example" in got


def test_hosts_and_paths(spark):
    from pyspark.sql import functions as F

    urls = ["HTTP://A.Example.COM/x/Y?q#f", "https://b.example?q/r", "x://c.example#f/g", "nothing", None, "", "a://b://c", "://", "http://É.example/\nz", "http://h"]
    table = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = url_filters.host_and_path(F.col("u"))
    assert [tuple(r) for r in table.select(host, path).collect()] == [parts(u) for u in urls]


def test_rules(spark):
    rules = (Rule("allow", "org", "/"), Rule("block", "a.org", "/x"), Rule("block", "org", "/yy"), Rule("allow", "b.org", "/y"))
    urls = ["http://org/", "http://z.org/x", "http://a.org/x1", "http://q.a.org/x", "http://nota.org/x", "http://b.org/yy", "http://org", "http://a.orgs/x"]
    _, rows = judged(spark, [(k, u, "") for k, u in enumerate(urls)], rules)
    # Two rules of six letters fit the sixth: then it is blocked only if the longest says so.
    assert [r.rule for r in sorted(rows.collect(), key=lambda r: r.page_id)] == ["org/", "org/", "a.org/x", "a.org/x", "org/", "b.org/y", None, None]


def test_hard_rows(spark):
    rows = [(1, None, None, "h", "v", 1), (None, "http://good.example/a", "", None, None, None), (2, "odd", "<a href=", "h", "v", 1), (2, "odd", "<a href=", "h", "v", 1),
            (3, "http://bad.example/", "<a href='http://x.example'>" * 20_000, "h", "v", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = url_filters.with_verdicts(table, url_filters.host_verdicts(table, RULES), RULES)
    assert out.columns == ["page_id", "url", "html", "trust", "host", "path", "rule", "verdict"]
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "bad.example", "/", "bad.example/", "block"),
                   ("None", "good.example", "/a", "good.example/", "allow")]
    empty = table.limit(0)
    assert url_filters.with_verdicts(empty, url_filters.host_verdicts(empty, RULES), RULES).count() == 0
