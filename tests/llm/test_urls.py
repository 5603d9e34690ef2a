from lattix.llm import urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id bigint, url string, html string, host string, node string, rule string"


def judged(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, RULES, **more).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.ORG/es/x", ""), (2, "https://example.org/en/12?x#y", None), (3, "http://x.org/", ""), (4, "http://x.org", ""), (5, "http://www.x.com/de/1", ""), (6, "http://x.com/fr/1", ""),
        (7, None, None), (8, "no scheme", ""), (9, "http://notorg/es/", ""), (10, "http://x.net/?a://b/de/", ""), (11, "HTTP://com/de/", ""), (12, "", ""),
    ])
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("x.org", "/", "org/", "allow") and got[4] == ("x.org", "", None, "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == got[8] == got[12] == ("", "", None, "allow")
    assert got[9] == ("notorg", "/es/", None, "allow") and got[10] == ("x.net", "/", None, "allow") and got[11][2:] == ("com/de/", "block")


def test_aliases(spark):
    link = '<link href="{0}" class=x rel="canonical">'
    refresh = '<META http-equiv="refresh" content="0; url={0}">'
    rows = [
        (1, "http://a.net/1", link.format("http://b.net/2")), (2, "http://b.net/2", refresh.format("http://c.com/de/3")), (3, "http://c.com/fr/4", link.format("http://b.net/2")),
        (4, "http://www.a.net/1/?utm_source=x#top", ""), (5, "http://other.net/", link.format("/rel")), (6, "http://other.net/rel", ""), (7, "http://d.net/x", ""), (7, "http://d.net/x", ""),
    ]
    got = judged(spark, rows)
    assert [got[i][3] for i in (1, 2, 4)] == ["block"] * 3
    assert got[3][2:] == ("com/fr/", "allow")  # an explicit allow comes first
    assert [got[i][3] for i in (5, 6, 7)] == ["allow"] * 3
    more = spark.createDataFrame([("http://d.net/x", "http://a.net/1")], "from_url string, to_url string")
    assert judged(spark, rows, redirects=more)[7][3] == "block"


def test_many_rules_of_one_host(spark):
    """The longest of very many rules, of which some are there twice, once as a block and once as an allow."""
    rules = [("block", "com", f"/{i}/") for i in range(3000)] + [("allow", "com", f"/{i}/x") for i in range(0, 3000, 2)] + [("allow", "com", "/7/"), ("block", "x.com", "/8")]
    rows = [(i, f"http://x.com/{i}/{'x' if i % 3 else 'y'}{'z' * 50}", "") for i in range(40)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules).collect()}
    for i, url, _ in rows:
        path = url.removeprefix("http://x.com")
        fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if h in ("com", "x.com") and path.startswith(p)]
        assert got[i] == (max(fits)[2], max(fits)[3]), url


def test_empty(spark):
    assert judged(spark, []) == {}
