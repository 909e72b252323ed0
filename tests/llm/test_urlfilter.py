from driftscope.llm.queries import RULES
from driftscope.llm.urlfilter import judge, rule_table

CASES = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "example.com/en/": ("", "", None, "allow"),
    "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "http://www.example.com/en/?x": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"),
    "http://a.net/es/1#x": ("a.net", "/es/1", "net/es/", "block"), "http://a.net/ES/": ("a.net", "/ES/", None, "allow"),
    "http://a.net?/es/": ("a.net", "", None, "allow"), "x://y://z.com/": ("y:", "//z.com/", None, "allow"),
    "http://com": ("com", "", None, "allow"), "http://com/": ("com", "/", "com/", "allow"),
    "http://.com/": (".com", "/", "com/", "allow"), "http://ÉX.com/" + "a/" * 3000: ("Éx.com", "/" + "a/" * 3000, "com/", "allow"),
}


def test_cases(spark):
    urls = [u for u in CASES for _ in range(2)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr(
        "*", "1 AS host", "2 AS rule", "3 AS digest", "4 AS prefix")
    rows = judge(pages, rule_table(spark, RULES)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.url], r.url
        assert (r.digest, r.prefix) == (3, 4)
    assert judge(pages.where("false"), rule_table(spark, RULES)).count() == 0


def test_equal_rules_block_and_ends_differ(spark):
    rules = rule_table(spark, [("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/xyz/")])
    pages = spark.createDataFrame([("h://a.b/x",), ("h://a.b/xyz/",), ("h://c.b/xyz/1",), ("h://b/x",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in judge(pages, rules, default="deny").collect()}
    assert got == {"h://a.b/x": ("a.b/x", "block"), "h://a.b/xyz/": ("b/xyz/", "allow"),
                   "h://c.b/xyz/1": ("b/xyz/", "allow"), "h://b/x": (None, "deny")}
