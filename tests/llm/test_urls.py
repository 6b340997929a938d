from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm import urls
from quillon.llm.queries import URL_RULES

URLS = {
    "http://x.example.net/en/1": ("x.example.net", "/en/1", "example.net/en/", "allow"),
    "https://X.Example.NET/de/1?q=/en/": ("x.example.net", "/de/1", "net/", "block"),
    "http://bare.net": ("bare.net", "", None, "allow"),
    "http://example.net/": ("example.net", "/", "net/", "block"),
    "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
    "http://a.example.com/de/x#y": ("a.example.com", "/de/x", "example.com/de/", "block"),
    "ftp://site.org/fr/a": ("site.org", "/fr/a", "org/fr/", "allow"),
    "http://site.org?x=://net/": ("site.org", "", None, "allow"),
    "no scheme.net/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://net/x://y": ("net", "/x://y", "net/", "block"),
    None: ("", "", None, "allow"),
}


def frame(spark, values):
    return spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(values)], "page_id long, url string, host string, n string")


def test_rules(spark):
    values = [*URLS, *URLS]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame(spark, values), URL_RULES).collect()}
    assert got == {i: URLS[u] for i, u in enumerate(values)}
    assert urls.judge(frame(spark, []), URL_RULES).collect() == []


def test_templates_learn_from_labels(spark):
    values = [(f"http://h.com/spam/offer-{i}.html", "block" if i % 3 else None) for i in range(60)]
    values += [(f"http://h.com/news/{2000 + i}/story{i}", "allow" if i % 2 else None) for i in range(60)]
    values += [(f"http://h.com/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/page", None) for i in range(60)]
    rows = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(values)], "page_id long, url string, label string")
    got = urls.judge(rows, [], "label").collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(values)
    assert all(by[i]["verdict"] == "block" for i in range(60) if not values[i][1])
    assert all(by[i]["verdict"] == "allow" for i in range(60, 180))
    assert {by[i]["template"] for i in range(60)} == {"spam/offer-{n}.html"}
    assert {by[i]["template"] for i in range(120, 180)} == {"u/*/page"}  # variable names are one branch


def test_alike_branches_merge(spark):
    rows = [(f"http://h.com/{lang}/{i}", "block" if i % 5 else None) for lang in ("aa", "bb") for i in range(40)] + [(f"http://h.com/cc/{i}", None) for i in range(3)]
    rows += [(f"http://h.com/ok/{i}", "allow") for i in range(20)]
    frame = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "page_id long, url string, label string")
    got = {r["path"].split("/")[1]: r for r in urls.judge(frame, [], "label").collect()}
    assert got["aa"]["template"] == got["bb"]["template"] == got["cc"]["template"]
    assert got["cc"]["verdict"] == "block" and got["ok"]["template"] != got["aa"]["template"]


def test_segments(spark):
    row = spark.createDataFrame([("/a/2020-01-02//7x/0123456789abcdef0123/b/c/d",)], "p string").select(urls.segments(F.col("p")).alias("s")).first()
    assert row["s"] == ["a", "{date}", "{n}x", "{hash}", "b", "c", "d"]
    deep = spark.createDataFrame([("/x" * 40,)], "p string").select(urls.segments(F.col("p")).alias("s")).first()
    assert deep["s"] == ["x"] * 40


def test_branches_at_any_depth(spark, monkeypatch):
    """Branches of one path that part at its 201st segment get templates and verdicts of their own,
    in one round for each depth at which nodes branch."""
    depths = []
    plain = urls.generalised
    monkeypatch.setattr(urls, "generalised", lambda counts, depth: depths.append(depth) or plain(counts, depth))
    deep = "/x" * 200
    values = [(f"http://h.com{deep}/bad/{i}", "block" if i % 2 else None) for i in range(40)] + [(f"http://h.com{deep}/good/{i}", "allow" if i % 2 else None) for i in range(40)]
    rows = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(values)], "page_id long, url string, label string")
    got = {r["page_id"]: r for r in urls.judge(rows, [], "label").collect()}
    assert [got[i]["verdict"] for i in range(80)] == ["block"] * 40 + ["allow"] * 40
    assert {got[i]["template"] for i in range(40)} == {"x/" * 200 + "bad/{n}"}
    assert depths == [201]


def test_templates_reject_what_no_rule_names(spark):
    """Rules that end inside a segment label a part of a template's URLs: the template judges the
    rest, which `the rule's verdict, else allow` would let through."""
    rules = [urls.rule("block", f"shop.net/item/{d}") for d in range(1, 6)] + [urls.rule("allow", "shop.net/help/1"), urls.rule("block", "shop.net/x/1")]
    values = [f"http://www.shop.net/item/{i}.html?ref=a" for i in range(100, 1000, 7)] + [f"http://shop.net/help/{i}" for i in range(10, 60)] + [f"http://shop.net/x/{i}" for i in range(1, 300)]
    rows = spark.createDataFrame(list(enumerate(values)), "page_id long, url string")
    got = urls.judge(rows, rules).collect()
    plain = {r["page_id"]: "allow" if r["rule"] is None else "block" if "item" in r["rule"] or "/x/" in r["rule"] else "allow" for r in got}
    changed = [r for r in got if r["verdict"] != plain[r["page_id"]]]
    assert {r["template"] for r in changed if r["path"].startswith("/item")} == {"item/{n}.html"}
    assert all(r["verdict"] == "block" for r in got if r["path"].startswith("/item"))
    assert all(r["verdict"] == "allow" for r in got if r["path"].startswith("/help"))


def test_rare_blocked_branches_keep_their_class(spark):
    names = [f"n{a}{b}" for a in "abcdef" for b in "ghijkl"]
    values = [(f"http://h.com/{n}/page", "allow") for n in names for _ in range(4)] + [("http://h.com/bad/page", "block")] * 6 + [("http://h.com/bad/page", None)]
    frame = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(values)], "page_id long, url string, label string")
    got = urls.judge(frame, [], "label").collect()
    assert {r["verdict"] for r in got if r["path"] == "/bad/page"} == {"block"} and {r["verdict"] for r in got if r["path"] != "/bad/page"} == {"allow"}
