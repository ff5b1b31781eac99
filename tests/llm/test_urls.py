from __future__ import annotations

import re
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from landflux.llm import urls  # noqa: E402
from landflux.llm.queries import URL_RULES  # noqa: E402


def parse(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]


def plain_rule(host, path, rules):
    fits = [
        r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.text), default=None)


def plain_templates(rows):
    """Templates of (host, path, verdict) rows, one tree a host, level by level."""
    labelled = [r for r in rows if r[2]]
    prior = (sum(r[2] == "block" for r in labelled) + 1) / (len(labelled) + 2)

    def shape(path):
        return tuple(re.sub(urls.IDENTIFIER, r"*\1", s) if re.search(urls.IDENTIFIER, s) else s for s in path.split("/") if s)

    def counts(members):
        return len(members), sum(m[2] == "block" for m in members), sum(m[2] is not None for m in members)

    def differ(bad, n, other_bad, other_n):
        a, b, n, m = bad + 0.5, other_bad + 0.5, n + 1.0, other_n + 1.0
        p = (a + b) / (n + m)
        return abs(a / n - b / m) > urls.Z * (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    state = {i: "" for i in range(len(rows))}
    shapes = [shape(r[1]) for r in rows]
    for level in range(max(map(len, shapes), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for i, r in enumerate(rows):
            if len(shapes[i]) > level:
                nodes[r[0], state[i]][shapes[i][level]].append(i)
        for (_, template), children in nodes.items():
            total = [sum(x) for x in zip(*(counts([rows[i] for i in c]) for c in children.values()), strict=True)]
            for segment, members in children.items():
                _, bad, labels = counts([rows[i] for i in members])
                apart = labels > 0 and differ(bad, labels, total[1] - bad, total[2] - labels)
                variable = segment.startswith("*")
                for i in members:
                    state[i] = f"{template}/{'*' if variable or not apart else segment}"
    sums = defaultdict(lambda: [0, 0])
    for i, r in enumerate(rows):
        sums[r[0], state[i]][0] += r[2] == "block"
        sums[r[0], state[i]][1] += r[2] is not None
    out = []
    for i, r in enumerate(rows):
        bad, n = sums[r[0], state[i]]
        purity = (bad + urls.SMOOTHING * prior) / (n + urls.SMOOTHING)
        out.append((state[i], purity, "block" if n >= urls.LEAST_LABELS and purity >= urls.REJECT else "allow"))
    return out


def check(spark, addresses, rules=URL_RULES):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(addresses)], "page_id bigint, url string, host string")
    got = sorted(urls.judge_urls(frame, rules).collect(), key=lambda r: r.page_id)
    assert len(got) == len(addresses)
    parsed = [parse(u) for u in addresses]
    ruled = [plain_rule(h, p, rules) for h, p in parsed]
    learnt = plain_templates([(h, p, r and r.verdict) for (h, p), r in zip(parsed, ruled, strict=True)])
    for row, (host, path), rule, (template, purity, verdict) in zip(got, parsed, ruled, learnt, strict=True):
        assert (row.host, row.path) == (host, path)
        assert row.rule == (rule and rule.text)
        assert row.template == template and abs(row.purity - purity) < 1e-9
        assert row.verdict == (rule.verdict if rule else verdict)
    return got


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    check(spark, [r.url for r in pages.select("url").collect()])


def test_odd_urls(spark):
    check(
        spark,
        [None, "", "no scheme", "x://", "http://ORG", "http://a.Example.org/es/", "http://example.org/en/12", "http://notorg/x",
         "http://com/de/1?x#y", "ftp://u@h:80/a//b/", "http://ÄX.com/fr/é", "a://b://c/d", "http://x.com#/de/", "http://x.com?/de/",
         "http://x.com/" + "a/" * 3000, "http://x.com/de/1", "http://x.com/de/1"],
    )


def test_a_blocked_template_spreads_to_unruled_pages(spark):
    """Pages of one template, of which a rule knows only some."""
    rules = [urls.Rule("block", "spam.test", "/offers/1"), urls.Rule("allow", "spam.test", "/news/")]
    addresses = [f"http://spam.test/offers/{i}" for i in range(100, 200)] + [f"http://spam.test/news/{i}" for i in range(60)]
    addresses += [f"http://spam.test/offers/{i}" for i in range(200, 215)] + ["http://spam.test/about"]
    got = check(spark, addresses, rules)
    assert {r.verdict for r in got if r.path.startswith("/offers/2")} == {"block"}
    assert got[-1].verdict == "allow"


def test_branches_that_part_deep_down(spark):
    """Paths that part at the ninth segment, some of them shorter than what others share, and rare children with labels."""
    deep = "/a/b/c/d/e/f/g/h"
    rules = [urls.Rule("block", "t.test", f"{deep}/bad/x"), urls.Rule("allow", "t.test", f"{deep}/good/x")]
    rules += [urls.Rule("block", "r.test", "/rare/"), urls.Rule("allow", "r.test", "/n")]
    addresses = [f"http://t.test{deep}/{kind}/{sub}{i}" for kind in ("bad", "good") for sub in ("x", "y") for i in "abcdefghijklmnopqrstuvwxyz"]
    addresses += ["http://t.test/a/b/c", f"http://t.test{deep}", "http://t.test/"]
    addresses += [f"http://r.test/n{chr(97 + i // 26)}{chr(97 + i % 26)}/p" for i in range(100)] + ["http://r.test/rare/p"] * 2
    got = check(spark, addresses, rules)
    assert {r.verdict for r in got if r.path.startswith(f"{deep}/bad/y")} == {"block"}
    assert {r.verdict for r in got if r.path.startswith(f"{deep}/good/y")} == {"allow"}
    assert got[-1].template == "/rare/*"


def test_empty_table(spark):
    assert check(spark, []) == []
