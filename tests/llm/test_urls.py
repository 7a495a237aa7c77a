import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.llm import queries, urls
from tests.llm.helpers import SF

RULES = queries.URL_RULES
PAGES, OUTCOMES = "page_id bigint, url string", "page_id bigint, bad int"


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def plain_domain(host, suffixes=()):
    if re.fullmatch(r"\d+(\.\d+){3}(:\d*)?", host):
        return "", host
    labels = host.split(".")
    long = [s for s in suffixes if host == s or host.endswith("." + s)]
    count = max((s.count(".") + 1 for s in long), default=1)
    return ".".join(labels[-count:]), ".".join(labels[-count - 1:])


def plain_bounds(pages, outcomes, suffixes=()):
    """The lower bound of each host's rate, level by level."""
    known = {}
    for page, bad in outcomes:
        if page is not None and bad is not None:
            known[page] = max(known.get(page, 0), bad)
    seen = {}
    for page, url in pages:
        host = plain_split(url)[0]
        n, k = seen.get(host, (0, 0))
        seen[host] = (n + (page in known), k + known.get(page, 0))
    parents = {"": (0.5, 1.0, sum(n for n, _ in seen.values()), sum(k for _, k in seen.values()))}
    for level in range(3):
        def key(host, depth):
            return ["", *plain_domain(host, suffixes), host][depth] if depth else ""
        groups, up = defaultdict(lambda: [0, 0]), {}
        for host, (n, k) in seen.items():
            name = (key(host, level + 1), plain_domain(host, suffixes)[0])
            groups[name][0] += n
            groups[name][1] += k
            up[name] = (key(host, level), plain_domain(host, suffixes)[0]) if level else ""
        rows = {}
        for name, (n, k) in groups.items():
            m, w, pn, pk = parents[up[name]]
            rows[name] = ((w * m + pk - k) / (w + pn - n), n, k)
        over = sum((k - n * m) ** 2 / n - m * (1 - m) for m, n, k in rows.values() if n)
        room = sum((n - 1) * m * (1 - m) for m, n, k in rows.values() if n)
        r = min(max(over / room if room else urls.LEAST, urls.LEAST), urls.MOST)
        parents = {name: (m, 1 / r - 1, n, k) for name, (m, n, k) in rows.items()}
    out = {}
    for (host, _), (m, w, n, k) in parents.items():
        rate = (w * m + k) / (w + n)
        out[host] = rate - urls.Z * math.sqrt(rate * (1 - rate) / (w + n + 1))
    return out


def plain(pages, outcomes, rules, suffixes=()):
    bounds = plain_bounds(pages, outcomes, suffixes)
    out = []
    for page, url in pages:
        host, path = plain_split(url)
        rule, verdict = plain_rule(host, path, rules)
        out.append((page, host, path, rule, verdict or ("block" if bounds[host] > urls.THRESHOLD else "allow")))
    return Counter(out)


def got(spark, pages, outcomes, rules=RULES, **options):
    rows = urls.judge(spark.createDataFrame(pages, PAGES), rules, spark.createDataFrame(outcomes, OUTCOMES), **options)
    return Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.collect())


def some_pages():
    pages, outcomes = [], []
    for k in range(600):
        host = ["good.site.org", "spam.farm.org", "a.farm.org", "b.farm.org", f"h{k % 40}.wide.net", "x.y.co.uk",
                "once.farm.org"][k % 7 if k < 590 else 6]
        pages.append((k, f"https://{host}/p/{k}"))
        if k % 3 and host != "once.farm.org":
            outcomes.append((k, int("farm" in host or k % 11 == 0)))
    return pages, outcomes


def test_verdicts_against_plain(spark):
    pages, outcomes = some_pages()
    want = plain(pages, outcomes, RULES, ("co.uk",))
    assert got(spark, pages, outcomes, suffixes=("co.uk",)) == want
    verdicts = {host: v for _, host, _, _, v in want}
    assert verdicts["spam.farm.org"] == "block" and verdicts["good.site.org"] == "allow"
    # No page of it has an outcome: its domain's reputation decides.
    assert verdicts["once.farm.org"] == "block"


def test_bounds_against_plain(spark):
    pages, outcomes = some_pages()
    rows = urls.judge(spark.createDataFrame(pages, PAGES), [], spark.createDataFrame(outcomes, OUTCOMES))
    for r in rows.select("host", "lower").distinct().collect():
        assert r["lower"] == pytest.approx(plain_bounds(pages, outcomes)[r["host"]], abs=1e-9)


def test_given_pages_against_plain(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    outcomes = queries.page_outcomes(pages, spark.read.parquet(f"{SF}/labels.parquet"))
    want = plain([tuple(r) for r in pages.collect()], [tuple(r) for r in outcomes.collect()], RULES)
    found = queries.op12_url_reputation(spark, SF).collect()
    assert Counter(map(tuple, found)) == want and outcomes.count() > 10


ODD = [None, "", "no scheme/at/all", "://", "HTTP://WWW.Example.COM/en/x?q#f", "http://www.example.com/en", "http://com/",
       "http://xcom/", "http://a.com?x", "http://a.com#x", "ftp://u:p@a.b.net:81/es/1?u=://z/", "a://b://c/d", "http://1.2.3.4/es/",
       "http://net/es/", "http://ÀB.NET/fr/é", "http://a.com\n.net/es/\n2", "http://.com/", "http://a..net./fr/"]


def test_odd_urls(spark):
    pages = [(k % 7 if k % 5 else None, u) for k, u in enumerate(ODD * 2)]
    for outcomes in ([], [(1, 1), (1, 0), (None, 1), (2, None), (99, 1)]):
        assert got(spark, pages, outcomes) == plain(pages, outcomes, RULES)


def test_longest_rule_wins(spark):
    pages = [(1, "http://www.example.com/en/1"), (2, "http://m.example.com/en/1"), (3, "http://m.example.com/fr/1"),
             (4, "http://a.net/es/1"), (5, "http://a.net/de/1"), (6, "http://a.com")]
    rules = {p: (r, v) for p, _, _, r, v in got(spark, pages, [])}
    assert rules == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"),
                     4: ("net/es/", "block"), 5: (None, "allow"), 6: (None, "allow")}


def test_empty_clashing_and_bad_rules(spark):
    table = spark.createDataFrame([(1, "http://a.org/1")], PAGES)
    none = spark.createDataFrame([], OUTCOMES)
    assert urls.judge(table.filter(F.lit(False)), RULES, none).collect() == []
    extra = table.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "bad", "pages", "domain", "lower")])
    assert [r["host"] for r in urls.judge(extra, RULES, none).collect()] == ["a.org"]
    for rules in ([urls.Rule("maybe", "a")], [urls.Rule("allow", "a"), urls.Rule("block", "a")]):
        with pytest.raises(ValueError):
            urls.judge(table, rules, none)
