from epiloom.llm.url_reputation import url_filter


def run(spark, pages, outcomes):
    p = spark.createDataFrame(pages, "page_id long, url string, rule string")
    o = spark.createDataFrame(outcomes, "page_id long, good int")
    return {r.page_id: r for r in url_filter(p, o).collect()}


def test_rules_and_parts(spark):
    got = run(
        spark,
        [
            (1, "http://A.Example.org/es/1?x", ""), (2, "http://example.org/en/12", ""), (3, "http://notexample.org/es/", ""), (4, "https://x.com/fr/", ""), (5, "https://x.com/de/1#a", ""),
            (6, None, ""), (7, "mailto:x", ""), (8, "http://h.net?q=/es/", ""), (9, "http://org/", ""), (10, "http://example.org", ""),
        ],
        [],
    )
    told = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert told[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert told[2][2:] == ("example.org/en/1", "block")
    assert told[3][2:] == ("org/", "allow")
    assert told[4][2:] == ("com/fr/", "allow") and told[5][2:] == ("com/de/", "block")
    assert told[6][:3] == ("", "", None) and told[7][:3] == ("", "", None)
    assert told[8][:3] == ("h.net", "", None) and told[9][2] == "org/" and told[10][:3] == ("example.org", "", None)


def test_shrinkage(spark):
    pages = [(i, f"http://good.net/{i}", "") for i in range(60)] + [(100 + i, f"http://bad.net/{i}", "") for i in range(60)] + [(300, "http://new.net/", "")]
    got = run(spark, pages, [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(5, None), (None, 1), (999, 1)])
    assert got[0].verdict == "allow" and got[100].verdict == "block" and got[300].verdict == "block"
    assert got[100].bound < got[300].bound < got[0].bound


def test_empty(spark):
    p = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(p, spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_sites_domains_and_suffixes(spark):
    from epiloom.llm.url_reputation import parts

    urls = ["http://me@A.b.Example.CO.uk:8080/x", "http://example.com:80", "http://10.0.0.7:99/", "http://co.uk/", "http://single/", "http://", "http://a..b/"]
    got = parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.host, r.site, r.domain, r.suffix) for r in got] == [
        ("me@a.b.example.co.uk:8080", "a.b.example.co.uk", "example.co.uk", "co.uk"), ("example.com:80", "example.com", "example.com", "com"), ("10.0.0.7:99", "10.0.0.7", "10.0.0.7", "10.0.0.7"),
        ("co.uk", "co.uk", "co.uk", "co.uk"), ("single", "single", "single", "single"), ("", "", "", ""), ("a..b", "a..b", ".b", "b"),
    ]


def test_clashing_columns_repeated_pages_and_long_urls(spark):
    p = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000, "h"), (1, "http://a.org/" + "x" * 200_000, "h"), (None, "http://a.net", "h"), (None, None, None)], "page_id long, url string, host string")
    o = spark.createDataFrame([(1, 1, "s"), (1, 0, "s"), (None, 1, "s")], "page_id long, good int, site string")
    got = url_filter(p, o).collect()
    assert len(got) == 4 and sum(r.page_id == 1 and len(r.path) == 200_001 for r in got) == 2
