import random
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from hindsight.llm import oracles, url_filters
from hindsight.llm.queries import RULES

LABELS = "page_id long, bad boolean"


def judge(spark, urls, labels=(), ids=None):
    rows = list(zip(ids or range(len(urls)), urls, strict=True))
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, bad int")
    out = url_filters.judge_urls(pages, spark.createDataFrame(list(labels), LABELS), RULES)
    return sorted(out.collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.path))


CASES = [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme/com/", "", "", None, "allow"),
        ("http://A.Example.COM/en/1?x=/fr/#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://b.www.example.com/en/1", "b.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://www.example.com/fr/", "www.example.com", "/fr/", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com?/en/", "example.com", "", None, "allow"),
        ("ftp://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
        ("ftp://x.net/es", "x.net", "/es", None, "allow"),
        ("a://b://net/fr/", "b:", "//net/fr/", None, "allow"),
        ("x://É.net/fr/q", "É.net", "/fr/q", "net/fr/", "block"),
    ]


def test_hosts_paths_and_rules(spark):
    out = judge(spark, [url for url, *_ in CASES])
    for row, (url, *expected) in zip(out, CASES, strict=True):
        assert [row.host, row.path, row.rule, row.verdict] == expected, url


def test_shapes(spark):
    paths = ["/a/12/x.html", "/7.html", "/2024-01-02/b", "/a//b/", "/1/2/3/4/5/6", "/deadbeefdeadbeef00", "", "/" + "y" * 70]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(url_filters.shape_of(F.col("path")).alias("s"))
    assert [r.s for r in df.collect()] == [
        ["a", "*", "x.html"], ["*.html"], ["*", "b"], ["a", "b"], ["*", "*", "*", "*", "*", "*"], ["*"], [], ["*"],
    ]


def test_impure_templates_are_rejected_and_clean_siblings_stay(spark):
    bad = [f"http://h.org/spam/{i}" for i in range(40)]
    good = [f"http://h.org/news/{i}" for i in range(40)]
    labels = [(i, i < 40) for i in range(0, 80, 2)]
    out = judge(spark, bad + good, labels)
    assert {(r.template, r.verdict) for r in out} == {("/spam/*", "block"), ("/news/*", "allow")}


def test_branches_differ_at_any_depth(spark):
    urls = [f"http://h.org/a/b/c/d/{x}/e/{kind}/{i}" for kind in ("spam", "news") for x in ("x", "y") for i in range(40)]
    alone = ["http://lone.org/" + "/".join("abcdefghijklmnopqrstuvwxyz"), "http://k.org/a/b/c", "http://l.org"]
    out = judge(spark, urls + alone, [(i, i < 80) for i in range(160)])
    assert {(r.template, r.verdict) for r in out[:80]} == {("/a/b/c/d/*/e/spam/*", "block")}
    assert {(r.template, r.verdict) for r in out[80:160]} == {("/a/b/c/d/*/e/news/*", "allow")}
    assert [r.template for r in out[160:]] == ["/" + "/".join("abcdefghijklmnopqrstuvwxyz"), "/a/b/c", ""]


def test_a_heavy_bad_branch_stands_out_of_many_rare_ones(spark):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(400)]
    urls = [f"http://h.org/{name}/1" for name in names] + [f"http://h.org/spam/{i}" for i in range(300)]
    out = judge(spark, urls, [(i, i >= 400) for i in range(700)])
    assert {(r.template, r.verdict) for r in out[:400]} == {("/*/*", "allow")}
    assert {(r.template, r.verdict) for r in out[400:]} == {("/spam/*", "block")}


def test_similar_branches_merge_and_many_rare_ones_are_variable(spark):
    similar = [f"http://s.org/{a}/{i}" for a in ("a", "b", "c") for i in range(20)]
    rare = [f"http://r.org/user{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    out = judge(spark, similar + rare, [(i, i % 2 == 0) for i in range(60)])
    assert {r.template for r in out} == {"/*/*", "/*"}


def test_ties_repeats_nulls_and_empty(spark):
    urls = ["http://h.org/a"] * 3 + [None, None]
    out = judge(spark, urls, [(1, True), (1, False), (None, True), (2, None)], ids=[1, 1, None, 3, None])
    assert len(out) == 5 and {r.verdict for r in out} <= {"allow", "block"}
    assert judge(spark, []) == []


def plain_templates(shapes):
    """The template of each shape of one host from ``{shape: (pages, labelled, bad)}``, node by node."""
    out = {}

    def node(some, level, template):
        if len(some) == 1:
            out[some[0]] = template + "".join("/" + s for s in some[0][level:])
            return
        branches = defaultdict(list)
        for shape in some:
            branches[shape[level] if level < len(shape) else ""].append(shape)
        sums = {b: [sum(shapes[s][i] for s in of) for i in range(3)] for b, of in branches.items()}
        pages, labelled, bad = (sum(x[i] for x in sums.values()) for i in range(3))
        share = (bad + 0.5) / (labelled + 1)
        below = defaultdict(list)
        for branch, of in branches.items():
            n, judged, wrong = sums[branch]
            differs = judged > 0 and abs(wrong - judged * share) > 1.96 * (judged * share * (1 - share)) ** 0.5
            variable = len(branches) > 16 and pages < 4 * len(branches)
            own = branch == "" or len(branches) == 1 or differs and (not variable or n >= 4)
            step = template + ("" if branch == "" else "/" + branch if own else "/*")
            for shape in of:
                if len(shape) <= level + 1:
                    out[shape] = step
                else:
                    below[step].append(shape)
        for step, of in below.items():
            node(of, level + 1, step)

    node(list(shapes), 0, "")
    return out


def test_deep_random_paths_against_plain_tree_and_sql(spark):
    rng = random.Random(12)
    names = ["news", "spam", "a", "b", "42", "x.html"] + [f"user{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    weights = [30, 30, 20, 20, 10, 5] + [1] * 40
    paths = [rng.choices(names, weights, k=rng.choice([0, 1, 2, 2, 3, 4, 6, 9, 12])) for _ in range(1500)]
    paths += [["deep", *"abcdefgh", x, str(i)] for x in ("bad", "good") for i in range(30)]
    bad = {i: "spam" in p or "bad" in p if rng.random() < 0.9 else rng.random() < 0.5 for i, p in enumerate(paths) if rng.random() < 0.7}
    hosts = [rng.choice(["h.org", "k.org"]) if "deep" not in p else "d.org" for p in paths]
    urls = [f"http://{h}/" + "/".join(p) for h, p in zip(hosts, paths, strict=True)]
    out = judge(spark, urls, list(bad.items()))
    assert {r.verdict for r in out} == {"allow", "block"}
    counts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    shapes = [tuple("*" if s == "42" else s for s in p) for p in paths]
    for i, (host, shape) in enumerate(zip(hosts, shapes, strict=True)):
        count = counts[host][shape]
        count[0] += 1
        count[1] += i in bad
        count[2] += bad.get(i, False)
    templates = {host: plain_templates(of) for host, of in counts.items()}
    assert [r.template for r in out] == [templates[h][s] for h, s in zip(hosts, shapes, strict=True)]
    purity = {}
    overall = (len(bad) - sum(bad.values()) + 1) / (len(bad) + 1)
    for host, of in counts.items():
        def smoothed(some, towards):
            judged, wrong = (sum(x[i] for x in some) for i in (1, 2))
            return (judged - wrong + 8 * towards) / (judged + 8)

        whole = smoothed(of.values(), overall)
        for template in set(templates[host].values()):
            purity[host, template] = smoothed([x for s, x in of.items() if templates[host][s] == template], whole)
    for row in out:
        expected = purity[row.host, row.template]
        assert abs(row.purity - expected) < 1e-9
        assert row.rule or row.verdict == ("block" if expected < 0.5 else "allow")
    with duckdb.connect() as db:
        db.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
        db.register("labels", pd.DataFrame({"doc_id": list(bad), "toxic": [int(b) for b in bad.values()], "quality": 1}))
        rows = db.sql(oracles.sql(RULES)["op10_url_template_filter"]).df().sort_values("page_id")
    assert rows["template"].tolist() == [r.template for r in out]
    assert rows["verdict"].tolist() == [r.verdict for r in out]
