"""Distrust on graphs with in-degrees over one, and from blocked hosts that aren't crawled."""

from millrace.llm import url_filter


def link(*hosts):
    return "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)


def judged(spark, rows):
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    return {r.host: r for r in url_filter.filter_urls(pages).collect()}


def brute(edges, seeds):
    """Scores by plain loops; edges (src, dst), seeds host: (t, d)."""
    hosts = {x for e in edges for x in e} | set(seeds)
    to = {h: [b for a, b in edges if a == h] for h in hosts}
    first = {h: [(1 - url_filter.DAMPING) * x for x in seeds.get(h, (0.0, 0.0))] for h in hosts}
    rank = first
    for _ in range(url_filter.ROUNDS):
        rank = {h: (first[h][0] + url_filter.DAMPING * sum(rank[a][0] / len(to[a]) for a in hosts if h in to[a]), first[h][1] + url_filter.DAMPING * sum(rank[b][1] for b in to[h]) / max(1, len(to[h]))) for h in hosts}
    return rank


def test_every_linker_of_a_hub_is_caught(spark):
    out = judged(spark, [("http://bad.net/", ""), *[(f"http://f{k}.test/", link("bad.net")) for k in range(40)], ("http://wide.test/", link("bad.net", *[f"f.ok{k}.test" for k in range(9)]))])
    assert {out[f"f{k}.test"].verdict for k in range(40)} == {"block"} and out["wide.test"].verdict == "allow"


def test_blocked_host_without_pages_is_a_seed(spark):
    out = judged(spark, [*[(f"http://f{k}.test/", link("bad.net", "Bad.net")) for k in range(4)], ("http://ok.test/", link("fine.test")), ("http://example.com/fr/", link("example.net/en"))])
    assert {out[f"f{k}.test"].verdict for k in range(4)} == {"block"} and out["ok.test"].verdict == "allow" and out["example.com"].verdict == "allow"


def test_scores_equal_brute_force(spark):
    rows = [("http://a.test/", link("bad.net", "b.test")), ("http://b.test/", link("bad.net", "a.test", "worse.net")), ("http://c.org/fr/", link("b.test", "a.test")), ("http://c.org/de/", ""), ("http://bad.net/", link("c.org"))]
    edges = [("a.test", "bad.net"), ("a.test", "b.test"), ("b.test", "bad.net"), ("b.test", "a.test"), ("b.test", "worse.net"), ("c.org", "b.test"), ("c.org", "a.test"), ("bad.net", "c.org")]
    want, out = brute(edges, {"bad.net": (0.0, 1.0), "worse.net": (0.0, 1.0), "c.org": (0.5, 0.0)}), judged(spark, rows)
    for host, r in out.items():
        assert abs(r.trust - want[host][0]) < 1e-9 and abs(r.distrust - want[host][1]) < 1e-9, host
