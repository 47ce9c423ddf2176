"""Rules on hand-made urls; ranks against a plain power iteration."""

from meshscope.llm import url_filter as u

PAGES = "page_id long, url string, html string, host string, rule string"


def links(*hosts):
    return "".join(f'<a class="x" href="https://{x}/p">t</a> <a href=/local>l</a>' for x in hosts)


def test_rules(spark):
    cases = {
        "http://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.example.org/es/": ("a.example.org", "/es/", "example.org/es/", "block"),
        "http://a.example.org/en/123?x": ("a.example.org", "/en/123", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.com/fr/#a": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://x.net:80/a://b": ("x.net:80", "/a://b", None, "allow"),
        "http://?q": ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, url, None, "h", "r") for k, url in enumerate(cases)], PAGES)
    found = {r["row"]["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge_urls(pages).collect()}
    want = dict(cases)
    # hosts with a blocked page and no allowed one are distrusted seeds themselves
    want["http://x.com/DE/"] = ("x.com", "/DE/", None, "allow")
    assert found == want


def plain_ranks(seed, edges, rounds):
    out = {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
    rank = dict(seed)
    for _ in range(rounds):
        new = {h: (1 - u.DAMPING) * s for h, s in seed.items()}
        for a, b, n in edges:
            if a in rank:
                new[b] = new.get(b, 0.0) + u.DAMPING * rank[a] * n / out[a]
        rank = new
    return rank


def test_propagation(spark):
    rows = [
        (1, "http://good.org/", links("friend.net", "friend.net", "mixed.net")),
        (2, "http://friend.net/", links("second.net", "good.org")),
        (3, "http://bad.com/de/", links("victim.net")),
        (4, "http://spam.net/", links("bad.com", "bad.com", "spam2.net")),
        (5, "http://spam2.net/", links("spam.net")),
        (6, "http://mixed.net/", links("bad.com", "good.org")),
        (7, "http://victim.net/", None),
        (8, "http://lonely.net/", "<a href='//friend.net/x'>x</a>"),
        (None, None, links("good.org")),
        (4, "http://spam.net/", links("bad.com", "bad.com", "spam2.net")),
    ]
    rows += [(100 + k, f"http://c{k}.net/", links(f"c{k + 1}.net" if k < 40 else "bad.com")) for k in range(41)]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], PAGES)
    found = u.judge_urls(pages).collect()
    assert len(found) == len(rows)
    by_host = {r["host"]: r for r in found}
    edges = [(r["src"], r["dst"], r["links"]) for r in u.host_edges(pages).collect()]
    assert ("spam.net", "bad.com", 4) in edges and ("lonely.net", "friend.net", 1) in edges
    trust = plain_ranks({"good.org": 1.0}, edges, 500)
    distrust = plain_ranks({"bad.com": 1.0}, [(b, a, n) for a, b, n in edges], 500)
    for host, r in by_host.items():
        assert abs(r["trust"] - trust.get(host, 0.0)) < 1e-8
        assert abs(r["distrust"] - distrust.get(host, 0.0)) < 1e-8
    verdicts = {h: r["verdict"] for h, r in by_host.items()}
    assert verdicts["friend.net"] == verdicts["victim.net"] == verdicts["good.org"] == verdicts[""] == "allow"
    assert verdicts["spam.net"] == verdicts["spam2.net"] == verdicts["bad.com"] == "block"
    assert verdicts["c0.net"] == verdicts["c40.net"] == "block"  # 41 and one link from the seed


def test_empty_table(spark):
    assert u.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
