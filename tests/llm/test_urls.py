from tessera.llm import url_filter
from tests.llm.cases import as_set, workspace

SCHEMA = "page_id long, url string, html string, note string"


def judge(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x") if len(r) == 3 else (*r, "", "x") for r in rows], SCHEMA)
    for name in ("host", "path", "rule", "verdict", "component", "target"):
        pages = pages.selectExpr("*", f"'clash' AS {name}")
    return {r["page_id"]: r for r in url_filter.url_verdicts(pages, workspace(spark), **options).collect()}


def test_hosts_paths_and_rules(spark):
    got = judge(
        spark,
        [
            (1, "http://A.Example.NET/en/x?q#f"),
            (2, "https://x.net"),
            (3, "https://x.net/"),
            (4, "https://example.com/de/1"),
            (5, "https://badexample.com/de/1"),
            (6, "https://m.example.com/fr/1"),
            (7, None),
            (8, "no scheme/net/"),
            (9, "http://w.org/fr/"),
            (10, "http://example.net/EN/"),
            (11, "http://"),
            (12, "http://u://v.net/"),
            (13, "x://y\nz.net/a\nb"),
        ],
    )
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(1, 14)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("x.net", "", None, "block"),  # an alias of the next
        ("x.net", "/", "net/", "block"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("badexample.com", "/de/1", None, "allow"),
        ("m.example.com", "/fr/1", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("w.org", "/fr/", "org/fr/", "allow"),
        ("example.net", "/EN/", "net/", "block"),
        ("", "", None, "allow"),
        ("u:", "//v.net/", None, "allow"),
        ("y\nz.net", "/a\nb", "net/", "block"),
    ]


def test_aliases_carry_decisions(spark):
    link = '<html><link href="{}" rel=x><LINK REL="canonical" HREF="{}">'
    refresh = "<meta http-equiv=refresh content='0; url={}'>"
    got = judge(
        spark,
        [
            (1, "http://a.io/1", link.format("/no", "http://b.io/2")),
            (2, "http://b.io/2", refresh.format("https://c.net/3")),  # blocked at the end of the chain
            (3, "http://d.io/1", link.format("", "http://e.org/fr/9")),
            (4, "http://d.io/1?utm_source=z", refresh.format("http://f.net/q")),  # an allow among the aliases
            (5, "http://g.io/1", link.format("", "/2")),
            (6, "http://g.io/2", ""),
            (7, "http://h.net/1", link.format("", "http://e.org/fr/9")),  # its own rule stands
        ],
    )
    assert [got[i]["verdict"] for i in range(1, 8)] == ["block", "block", "allow", "allow", "allow", "allow", "block"]


def test_entities_in_links_are_read(spark):
    rows = spark.createDataFrame([("http://h.io/a", "<link rel=canonical href='http://k.io/?a=1&amp;b=2&#38;c=3'>")], "url string, html string")
    assert as_set(url_filter.page_links(rows), "target") == [("http://k.io/?a=1&b=2&c=3",)]


def test_redirect_table_and_hub(spark):
    hub = [(i, f"http://site{i}.io/{i}") for i in range(300)] + [(999, "http://hub.net/")]
    redirects = spark.createDataFrame([(f"http://site{i}.io/{i}", "http://hub.net/") for i in range(0, 300, 2)] + [(None, "x")], "url string, target string")
    got = judge(spark, hub, redirects=redirects)
    assert all(got[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(300))


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", "", "n"), (1, "http://x.net/", "", "n"), (2, "http://y.io/", "z" * 300000, "n")], SCHEMA)
    assert as_set(url_filter.url_verdicts(pages, workspace(spark)), "page_id", "verdict") == [(1, "block"), (1, "block"), (2, "allow")]
    assert url_filter.url_verdicts(pages.limit(0), workspace(spark)).count() == 0


def test_relative_links(spark):
    rows = spark.createDataFrame([("http://h.io/a/b.html", f"<link rel=canonical href={x}>") for x in ("c.html", "/d", "//k.io/e", "https://q.io")], "url string, html string")
    assert as_set(url_filter.page_links(rows), "target") == [("http://h.io/a/c.html",), ("http://h.io/d",), ("http://k.io/e",), ("https://q.io",)]
