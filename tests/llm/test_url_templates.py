import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from voltaic.llm import common, queries, url_templates

RULES = queries.URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:cut]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return brute.lower(host), path


def rule_of(host, path, rules=RULES):
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return min(fits, key=lambda r: (-len(r), r), default=None)


def plain(urls, labels, min_pages=5, min_share=0.02, alpha=0.05, max_depth=8):
    """Template of every (host, path) by a tree in one process."""
    rows = [list(split_url(u)) for u in urls]
    segs = [p[1:].split("/") if p else [] for _, p in rows]
    segs = [s if len(s) <= max_depth else [*s[:max_depth - 1], "/".join(s[max_depth - 1:])] for s in segs]
    node = [""] * len(rows)
    for d in range(max(map(len, segs), default=0)):
        level = defaultdict(lambda: defaultdict(list))
        for i, s in enumerate(segs):
            if len(s) > d:
                level[rows[i][0], node[i]][s[d]].append(i)
        for children in level.values():
            total = sum(map(len, children.values()))
            own = {s: m for s, m in children.items() if len(m) >= min_pages and len(m) >= min_share * total and not set(s) & set("*{}|")}
            rest = [i for s, m in children.items() if s not in own for i in m]
            branches = []
            for s, m in [*own.items(), *([("*", rest)] if rest else [])]:
                after = [segs[i][d + 1] if len(segs[i]) > d + 1 else None for i in m]
                branches.append({"seg": s, "n": len(m), "bad": sum(labels[i] == 1 for i in m), "good": sum(labels[i] == 0 for i in m),
                                 "ends": after.count(None), "numbers": sum(bool(a) and a[0] in "0123456789" for a in after)})
            names = url_templates.merged_branches(branches, alpha)
            for s, m in children.items():
                for i in m:
                    node[i] += "/" + (names.get(s, "*") if s in own else "*")
    return [(h, n) for (h, _), n in zip(rows, node, strict=True)]


def purity(places, labels, weight=5.0):
    bad, good, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for (h, t), y in zip(places, labels, strict=True):
        for k in ((h, t), h, None):
            bad[k] += y == 1
            good[k] += y == 0
            n[k] += 1
    share = bad[None] / max(1, bad[None] + good[None])
    smooth = lambda k, prior: (bad[k] + weight * prior) / (bad[k] + good[k] + weight)
    return {k: (smooth(k, smooth(k[0], share)), bad[k], good[k], n[k]) for k in set(places)}


def corpus(n=600):
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://x.net?q=/de/", "http://x.net#/a/", "http://x.org/fr",
            "http://x.org/fr/", "a://net/", "a://inet/", "a://b.net/en/://c", "http://h/" + "d/" * 40, "http://h/*/{a|b}/", "http://h//", "//x.net/"]
    for _ in range(n):
        host = rng.choice(["hot.example.com"] * 4 + ["www.example.net", "x.org", f"h{rng.randrange(30)}.info"])
        kind = rng.choice(["en", "fr", "de", "spam", f"u{rng.randrange(99)}"])
        urls.append(f"http://{host}/{kind}/{rng.randrange(10**6)}{rng.choice(['', '/', '.html', '?x=/1', '#y'])}")
    return urls


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "a", "b", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, node string, n int")


@pytest.mark.parametrize("options", [{}, {"min_pages": 1, "min_share": 0.2, "alpha": 0.5}, {"max_depth": 1}, {"min_share": 0.5, "max_depth": 2}])
def test_templates_against_a_plain_tree(spark, options, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)  # some nodes of this corpus are broadcast, some are not
    urls = corpus()
    labels = [1 if u and "/spam/" in u else (0 if i % 3 == 0 else None) for i, u in enumerate(urls)]
    truth = F.when(F.col("path").contains("/spam/"), 1).when(F.col("row.page_id") % 3 == 0, 0)
    got = url_templates.templates(frame(spark, urls), label=truth, carry=["page_id"], **options).select("row.page_id", "host", "node", "label").collect()
    assert {r["page_id"]: r["label"] for r in got} == dict(enumerate(labels))
    assert {r["page_id"]: (r["host"], r["node"]) for r in got} == dict(enumerate(plain(urls, labels, **options)))


def test_bad_templates_are_rejected_and_generalise_to_unlabelled_pages(spark):
    rng = random.Random(9)
    urls = [f"http://shop.example/{k}/{rng.randrange(10**6)}" for k in ("offers", "guides") for _ in range(200)]
    docs = frame(spark, urls)
    truth = F.when(F.col("row.page_id") % 5 == 0, F.col("path").contains("offers").cast("int"))
    got = url_templates.decide(docs, {}, label=truth, carry=["page_id"]).collect()
    assert len(got) == 400 and {r["node"] for r in got} == {"/offers/*", "/guides/*"}
    assert all((r["verdict"] == "block") == ("/offers/" in r["path"]) for r in got)


def test_branches_that_chance_explains_are_merged():
    a = {"n": 400, "bad": 0, "good": 100, "ends": 0, "numbers": 400}
    named = url_templates.merged_branches([{"seg": "x", **a}, {"seg": "y", **a, "n": 380, "numbers": 378}, {"seg": "z", **a, "bad": 100, "good": 0},
                                           {"seg": "*", **a, "n": 50, "bad": 40, "good": 0, "numbers": 50}], 0.05)
    assert named == {"x": "{x|y}", "y": "{x|y}", "z": "z"}
    assert url_templates.merged_branches([{"seg": "x", **a}, {"seg": "*", **a}], 0.05) == {}


@pytest.mark.parametrize("rules", [RULES, {"b.c/": "allow", "c/": "block", "c/x": "block", "b.c/x/": "allow"}])
def test_hosts_paths_and_longest_rules(spark, rules):
    urls = corpus(80) + ["http://a.b.c/x/1", "http://c/x1", "http://bc/x", "http://b.c/", "http://B.C"]
    got = url_templates.decide(frame(spark, urls), rules, carry=["page_id"]).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split_url(urls[r["row"]["page_id"]])
        rule = rule_of(host, path, rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules[rule] if rule else r["verdict"] in ("allow", "block")


def run(monkeypatch, spark, pages):
    monkeypatch.setattr(queries, "table", lambda s, d, name: pages)
    return queries.op12_url_filters(spark, "unused").collect()


def wanted(urls):
    rules = [rule_of(*split_url(u)) for u in urls]
    labels = [{"block": 1, "allow": 0}.get(RULES.get(r)) for r in rules]
    places = plain(urls, labels)
    known = purity(places, labels)
    out = []
    for u, r, place in zip(urls, rules, places, strict=True):
        p, bad, good, n = known[place]
        own = "block" if bad and p >= 0.8 and bad + good >= 0.5 * n else "allow"
        out.append((*split_url(u), r, RULES[r] if r else own))
    return out


def test_edge_rows_and_repeats(spark, monkeypatch):
    urls = [*corpus(200), "http://x.example.com/de/1", "http://x.example.com/de/1", "http://h/" + "p" * 100_000]
    got = run(monkeypatch, spark, frame(spark, urls).withColumn("page_id", F.expr("IF(page_id < 3, NULL, page_id % 90)")))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=key) == sorted(wanted(urls), key=key)


def test_empty_table(spark, monkeypatch):
    assert run(monkeypatch, spark, frame(spark, ["x"]).where("false")) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op12_url_filters(spark, sf).collect()}
    assert got == dict(zip([r["page_id"] for r in rows], wanted([r["url"] for r in rows]), strict=True))
