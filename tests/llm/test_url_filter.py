import math
import re
from collections import Counter, defaultdict

from citescope.llm import url_filter as U

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", "z", 1) for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, rule string, "
                                 "gram string, n int")


def brute_parse(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute_rule(host, path):
    fitting = []
    for verdict, rule in RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fitting.append((len(rule), rule, verdict))
    return max(fitting, default=(0, None, None))[1:]


def brute_scores(urls):
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    padded = [U.START * U.ORDER + "".join(brute_parse(u)) + U.END for u in urls]
    for text, url in zip(padded, urls):
        verdict = brute_rule(*brute_parse(url))[1]
        if verdict:
            for i in range(U.ORDER, len(text)):
                for k in range(U.ORDER + 1):
                    counts[verdict][text[i - k:i]][text[i]] += 1

    def log_p(name, context, ch):
        p = 1 / U.ALPHABET
        for k in range(U.ORDER + 1):
            seen = counts[name].get(context[U.ORDER - k:])
            if seen:
                p = (seen[ch] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    return [sum(log_p("allow", t[i - U.ORDER:i], t[i]) - log_p("block", t[i - U.ORDER:i], t[i])
                for i in range(U.ORDER, len(t))) / (len(t) - U.ORDER) for t in padded]


URLS = ["http://example.com/en/1", "https://a.example.com/en/x?q#f", "http://WWW.Example.com/en/a",
        "http://notexample.com/en/", "http://example.net/es/2", "http://x.example.net/fr/3#t",
        "http://example.net/de/4", "http://example.org/en/5", "http://netx/es/", "ftp://com/",
        "http://com", "http://sub.com?x=/en/", "no scheme", "", None, "://", "a://b://c/en/",
        "http://example.com/EN/1", "http://ÄB.example.net/es/ü日", "http://example.com/en/1",
        "http://shop.com/de/" + "deep/" * 3000, "http://example.net./es/1", "http://a..com/x",
        "http://line\nbreak.com/a\nb"]


def test_parts_rules_and_scores_against_brute_force(spark):
    got = sorted(U.judge(frame(spark, URLS).repartition(3), RULES).collect(),
                 key=lambda r: r.page_id)
    assert len(got) == len(URLS)
    scores = brute_scores(URLS)
    for r, url, score in zip(got, URLS, scores):
        host, path = brute_parse(url)
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.score - score) < 2e-6
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        if not host and not path:
            assert r.verdict == "allow"


def test_threshold_separates_best_and_decides_the_rest(spark):
    urls = [f"http://good{i % 7}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)]
    urls += [f"http://x{i % 5}.example.com/en/{i}" for i in range(60)]
    urls += ["http://good3.org/de/5", "http://x3.example.org/en/5"]
    got = sorted(U.judge(frame(spark, urls), RULES).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in got[-2:]] == ["allow", "block"]
    labelled = [(r.verdict, r.score) for r in got[:-2]]
    n = Counter(v for v, _ in labelled)

    def gain(edge):
        return (sum(v == "block" and s < edge for v, s in labelled) / n["block"]
                - sum(v == "allow" and s < edge for v, s in labelled) / n["allow"])

    best = max(gain(s) for _, s in labelled)
    edge = U.threshold(spark.createDataFrame([(*x, 1) for x in labelled],
                                             "rule_verdict string, score double, n int"))
    assert gain(edge) == best
    assert all((r.score >= edge) == (r.verdict == "allow") for r in got[-2:])


def test_one_sided_rules_allow_and_empty_table(spark):
    got = U.judge(frame(spark, ["http://a.com/", "http://b.org/"]), [("allow", "com/")]).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert U.judge(frame(spark, []), RULES).collect() == []


def test_no_python_in_the_plan(spark):
    plan = U.judge(frame(spark, URLS[:4]), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
