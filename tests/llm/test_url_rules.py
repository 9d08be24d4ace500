from kindred.llm.url_rules import judge

RULES = "rule string, action string"


def test_hosts_paths_and_precedence(spark):
    rules = [
        ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("a.example.org/en/", "allow"),
        (None, "block"), ("net/", None), ("twice.com/", "allow"), ("twice.com/", "block"), ("bare", "block"),
    ]
    want = {
        "http://EXAMPLE.org/es/x?q=/en/1#f": ("example.org", "/es/x", "example.org/es/", "block"),
        "http://a.b.example.org/en/14": ("a.b.example.org", "/en/14", "example.org/en/1", "block"),
        "http://a.example.org/en/14": ("a.example.org", "/en/14", "a.example.org/en/", "allow"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://example.org?x=1/": ("example.org", "", None, "allow"),
        "http://ÄB.org:80/": ("Äb.org:80", "/", None, "allow"),
        "http:///path": ("", "/path", None, "allow"),
        "http://..org/": ("..org", "/", "org/", "allow"),
        "https://m.twice.com/": ("m.twice.com", "/", "twice.com/", "block"),
        "http://x.bare/any": ("x.bare", "/any", "bare", "block"),
        "http://x.net/": ("x.net", "/", None, "allow"),
        "first://a.org/x://example.org/es/": ("a.org", "/x://example.org/es/", "org/", "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "l." * 3000 + "org/" + "p" * 5000: ("l." * 3000 + "org", "/" + "p" * 5000, "org/", "allow"),
    }
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(want)] + [(None, "http://a.org/", "c", "c", "c"), (0, None, "c", "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")
    got = judge(pages, spark.createDataFrame(rules, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == (want[r.url] if r.page_id is not None else ("a.org", "/", "org/", "allow"))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [r.verdict for r in judge(pages, none, default="block").collect()] == ["block"]
    assert judge(pages.where("false"), none).count() == 0


def test_many_rows_without_a_host(spark):
    rows = [(i, None if i % 2 else "no scheme/a") for i in range(500)] + [(None, None), (500, "http://a.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = judge(pages, spark.createDataFrame([("org/", "block")], RULES), "allow").collect()
    assert len(got) == len(rows)
    assert {(r.host, r.rule, r.verdict) for r in got} == {("", None, "allow"), ("a.org", "org/", "block")}
