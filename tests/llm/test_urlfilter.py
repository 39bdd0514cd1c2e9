import random

from reuselens.llm import urlfilter


def brute(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            rest = rest[cut:]
            path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules
                if None not in (v, h, p) and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def rule_table(spark, rules):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = brute([(r.page_id, r.url) for r in pages.collect()], urlfilter.RULES)
    assert len({w[3] for w in want}) > 3
    assert got(urlfilter.judge(pages, rule_table(spark, urlfilter.RULES))) == want


def test_nested_rules_over_many_ranges(spark):
    rng = random.Random(4)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", "", "ORG", "é.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/b"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts).lower(), rng.choice(paths)) for _ in range(30)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values()) + [(None, "org", "/q"), ("block", None, "/")]
    rows = [(i, f"http://{rng.choice(['', 'w.', 'b.', 'a.'])}{rng.choice(hosts)}{rng.choice(paths)}"
                f"{rng.choice(['', '?a/b', '#x', '/é', '\n/z'])}") for i in range(400)]
    rows += [(500, None), (501, "no scheme/a"), (502, ""), (503, "://"), (504, "x://y://z/a"), (None, "http://a.org/a"),
             (505, "http://a.org/a"), (505, "http://a.org/a"), (506, "http://org/" + "a/" * 100_000), (507, "http://xorg/a")]
    pages = spark.createDataFrame([(a, b, "r", 7) for a, b in rows], "page_id long, url string, rule string, depth int")
    for parts in ("1", "37"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert got(urlfilter.judge(pages, rule_table(spark, rules))) == brute(rows, rules)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got(urlfilter.judge(pages, rule_table(spark, rules[:0]))) == brute(rows, [])
    assert got(urlfilter.judge(pages.limit(0), rule_table(spark, rules))) == []


def test_of_equal_rules_block_counts(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for rules in ([("allow", "org", "/"), ("block", "org", "/")], [("block", "org", "/"), ("allow", "ORG", "/")]):
        assert got(urlfilter.judge(pages, rule_table(spark, rules))) == [(1, "a.org", "/", "org/", "block")]
