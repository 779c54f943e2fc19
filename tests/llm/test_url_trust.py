import pytest

from docloom.llm import url_trust as u

RULES = [u.Rule("org", "/", "allow"), u.Rule("example.org", "/es/", "block"), u.Rule("example.org", "/en/1", "block"), u.Rule("com", "/fr/", "allow"), u.Rule("com", "/de/", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block"), default=None)


def brute_scores(links, seeds, rounds=u.ROUNDS, d=u.DAMPING):
    """Dense power iteration over one direction."""
    nodes = sorted({n for a, b, _ in links for n in (a, b)} | set(seeds))
    out = {n: sum(w for a, _, w in links if a == n) for n in nodes}
    mass = sum(seeds.values())
    score = {n: seeds.get(n, 0.0) for n in nodes}
    for _ in range(rounds):
        moved = {n: sum(score[a] * w / out[a] for a, b, w in links if b == n) for n in nodes}
        lost = mass - sum(moved.values())
        score = {n: d * moved[n] + (1 - d) * seeds.get(n, 0.0) + (d * lost / mass * seeds.get(n, 0.0) if mass else 0.0) for n in nodes}
    return score


URLS = ["http://A.example.org/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "x://com/fr/?q", "http://a.com/fr/é", "http://a.com/fr", "http://a.com?/fr/", "://COM#/de/", "no scheme", "", None, "http://", "a://b.net/x://c", "http://ÄB.com/de/\nx", "http://org", "http://org/"]


def pages(spark, html):
    return spark.createDataFrame([(i, url, h, "extra") for i, (url, h) in enumerate(html)], "page_id bigint, url string, html string, host string")


def test_urls_and_rules_equal_brute_force(spark):
    got = u.judge_urls(pages(spark, [(x, None) for x in URLS + URLS]), RULES)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    rows = got.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = brute_url(r.url)
        best = brute_rule(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        if best:
            assert r.verdict == best.verdict


WEB = [
    ("http://good.org/a", '<a href="http://friend.net/x">f</a><a href=//friend.net/y><A HREF=\'HTTPS://Other.net\'>'),
    ("http://good.org/b", '<a href="/local">x</a><a href="http://good.org/self">'),
    ("http://friend.net/x", '<a href="http://second.net/">'),
    ("http://second.net/", None),
    ("http://bad.com/de/1", '<a href="http://victim.net/">'),
    ("http://farm.net/1", '<a href="http://bad.com/de/1"><a href="http://bad.com/de/2">'),
    ("http://feeder.net/1", '<a href="http://farm.net/1">'),
    ("http://victim.net/", ""),
    ("http://alone.net/", "text only"),
    ("nothing", '<a href="http://bad.com/de/1">'),
]


def test_verdicts_follow_links(spark):
    rows = u.judge_urls(pages(spark, WEB), RULES).collect()
    verdict = {r.host: r.verdict for r in rows}
    assert verdict["farm.net"] == verdict["feeder.net"] == verdict["bad.com"] == "block"
    assert all(verdict[h] == "allow" for h in ("friend.net", "second.net", "victim.net", "alone.net", ""))


def test_scores_equal_power_iteration(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("c", "e", 1.0)]
    seeds = [("trust", "a", 0.5), ("trust", "d", 0.1), ("distrust", "e", 0.4)]
    got = u.propagate(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, node string, mass double"))
    got = {(r.kind, r.node): r.score for r in got.collect()}
    for kind, edges in (("trust", links), ("distrust", [(b, a, w) for a, b, w in links])):
        want = brute_scores(edges, {n: m for k, n, m in seeds if k == kind})
        for n, s in want.items():
            assert got.get((kind, n), 0.0) == pytest.approx(s, abs=1e-6)


def test_empty_table_and_no_links(spark):
    assert u.judge_urls(pages(spark, WEB).limit(0), RULES).count() == 0
    assert {r.verdict for r in u.judge_urls(pages(spark, [("http://x.net/", None)]), RULES).collect()} == {"allow"}


def test_chain_of_more_than_20_hosts_settles(spark):
    hosts = [f"h{i:02}.net" for i in range(25)] + ["bad.com"]
    rows = [(f"http://{a}/", f'<a href="http://{b}/de/1">') for a, b in zip(hosts, hosts[1:], strict=False)] + [("http://bad.com/de/1", None)]
    assert {r.verdict for r in u.judge_urls(pages(spark, rows), RULES).collect()} == {"block"}


def test_scores_equal_converged_power_iteration_or_fail(spark):
    links = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(25)] + [("n25", "n3", 2.0)]
    edges = spark.createDataFrame(links, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "n0", 1.0)], "kind string, node string, mass double")
    got = {r.node: r.score for r in u.propagate(edges, seeds).collect()}
    want = brute_scores(links, {"n0": 1.0}, rounds=2000)
    assert want["n25"] > 0.001 and all(got[n] == pytest.approx(s, abs=1e-8) for n, s in want.items())
    with pytest.raises(RuntimeError, match="settle"):
        u.propagate(edges, seeds, rounds=20)


def test_sql_where_hosts_link(spark, tmp_path):
    """The query against its own SQL on pages whose hosts link: the verdicts of unruled hosts come through propagation."""
    import random

    import duckdb

    from docloom.llm import queries

    rng = random.Random(7)
    names = [f"a{i}.net" for i in range(40)] + [f"b{i}.info" for i in range(40)]
    good, bad = [f"g{i}.org" for i in range(8)], [f"s{i}.com" for i in range(8)]
    rows = []
    for k, host in enumerate([*names, *good, *bad] * 3):
        path = "/de/x" if host in bad else "/about"
        near = good + names[:40] if host in good or host in names[:40] else bad + names[40:]
        links = "".join(f'<a href="https://{rng.choice(near)}/p{i}">x</a>' for i in range(rng.randrange(0, 6)))
        rows.append((k, f"https://{host}{path}", links))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op10_url_trust(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(queries.oracle_sql()["op10_url_trust"])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    unruled = {(dict(zip(columns, r, strict=True))["host"], dict(zip(columns, r, strict=True))["verdict"]) for r in want if dict(zip(columns, r, strict=True))["rule"] is None}
    # seeds alone would allow them all
    assert sum(v == "block" for _, v in unruled) > 10 and sum(v == "allow" for _, v in unruled) > 10
