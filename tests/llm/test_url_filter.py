import random
import re

import pytest

from tidemark.llm.url_filter import DAMPING, MARGIN, Rule, judge_urls, propagate

RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"), Rule("tie.org/aa", "allow"), Rule("b.tie.org/", "block")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), r.verdict == "block"), default=None)


def slow(pages, rounds=200):
    parsed = [(i, *parse(u), h) for i, u, h in pages]
    ruled = [(i, h, p, rule_of(h, p), html) for i, h, p, html in parsed]
    count, allowed, blocked, n = {}, {}, {}, {}
    for _, h, _, r, html in ruled:
        if not h:
            continue
        count[h] = count.get(h, 0) + 1
        allowed[h] = allowed.get(h, 0) + (r is not None and r.verdict == "allow")
        blocked[h] = blocked.get(h, 0) + (r is not None and r.verdict == "block")
        targets = set()
        for link in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)""", html or "", re.I):
            if link.startswith("//"):
                link = "x:" + link
            elif not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", link):
                continue
            targets.add(parse(link)[0])
        for t in targets - {h, ""}:
            n[h, t] = n.get((h, t), 0) + 1
    hosts = set(count) | {h for e in n for h in e}
    out = {h: sum(v for (a, _), v in n.items() if a == h) for h in hosts}
    into = {h: sum(v for (_, b), v in n.items() if b == h) for h in hosts}
    own_t = {h: (1 - DAMPING) * allowed.get(h, 0) / count.get(h, 1) for h in hosts}
    own_d = {h: (1 - DAMPING) * blocked.get(h, 0) / count.get(h, 1) for h in hosts}
    t, d = dict(own_t), dict(own_d)
    for _ in range(rounds):
        t, d = (
            {h: own_t[h] + DAMPING * sum(t[a] * v / out[a] for (a, b), v in n.items() if b == h) for h in hosts},
            {h: own_d[h] + DAMPING * sum(d[b] * v / into[b] for (a, b), v in n.items() if a == h) for h in hosts},
        )
    bad = {h for h in hosts if d[h] - t[h] > MARGIN}
    return [(i, h, p, r and r.text, r.verdict if r else "block" if h in bad else "allow") for i, h, p, r, _ in ruled]


def pages(seed):
    pick = random.Random(seed)
    hosts = ["a.example.net", "example.net", "x.net", "www.example.com", "b.example.com", "c.org", "d.org", "e.info", "f.info", "g.info", "notexample.com", "Xnet", "a.tie.org", "b.tie.org"]
    rows = []
    for i in range(150):
        links = "".join(pick.choice(['<a href="http://%s/x">', "<A class=k HREF='//%s?q'>", '<a href="/%s">', "<a href=https://%s/>"]) % pick.choice(hosts) for _ in range(pick.randint(0, 4)))
        url = pick.choice(["http://", "HTTPS://"]) + pick.choice([str.upper, str])(pick.choice(hosts)) + pick.choice(["", "/", "/en/1", "/de/2", "/fr/3?x=/en/", "#/de/", "?u=http://x.net/", "/aa"])
        rows.append((i, url, links))
    return rows + [(500, None, "<a href='http://c.org/'>"), (501, "no scheme", None), (502, "http://", None), (503, "http:///en/", ""), (504, "http://lone.info/", None), (None, "http://x.net", "y"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = pages(seed)
    frame = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, host string, rules int")
    out = judge_urls(frame, RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(slow(rows), key=str)
    assert {g[4] for g in got if g[3] is None and g[1]} == {"allow", "block"}


def test_empty_and_no_links(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(frame, RULES).count() == 0
    frame = spark.createDataFrame([(1, "http://a.com/", None), (2, "http://a.net/", "")], "page_id long, url string, html string")
    assert sorted(map(tuple, judge_urls(frame, RULES).collect())) == [(1, "a.com", "/", None, "allow"), (2, "a.net", "/", "net/", "block")]


def test_rounds_go_on_until_no_verdict_can_change(spark):
    """Two hosts that link to one another; what the second gets comes over the margin after 40 rounds only."""
    seeds = spark.createDataFrame([("a.info", 0.0, 0.1633), ("b.info", 0.0, 0.0)], "host string, allowed double, blocked double")
    links = spark.createDataFrame([("a.info", "b.info", 1.0), ("b.info", "a.info", 1.0)], "src string, dst string, n double")
    got = {r["host"]: r["distrust"] - r["trust"] for r in propagate(seeds, links).collect()}
    assert got["b.info"] > MARGIN
