import math
import random
import statistics
from collections import defaultdict

from envspark.llm import url_filter as M
from envspark.llm.queries import URL_RULES

UP = {chr(c): chr(c + 32) for c in range(65, 91)}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return "".join(UP.get(c, c) for c in rest[:cut]), path[:end]


def rule_of(host, path):
    fit = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(urls, order=4):
    """verdict of every URL by a literal interpolated character model."""
    label = {u: rule_of(*parts(u))[0] for u in set(urls) if u is not None}
    low = {u: "".join(UP.get(c, c) for c in u) for u in label}
    count = {v: defaultdict(lambda: defaultdict(int)) for v in ("allow", "block")}
    for u, v in label.items():
        s = "\x02" * order + low[u] + "\x03"
        for i in range(order, len(s)):
            for k in range(order + 1):
                if v:
                    count[v][s[i - k:i]][s[i]] += 1

    def prob(v, s, i):
        p = 1 / M.ALPHABET
        for k in range(order + 1):
            c = count[v].get((s[i - k:i]), {})
            # contexts are kept apart by length, which the string shows
            if c:
                p = (c.get(s[i], 0) + len(c) * p) / (sum(c.values()) + len(c))
        return p
    score = {}
    for u in label:
        s = "\x02" * order + low[u] + "\x03"
        score[u] = sum(math.log(prob("allow", s, i)) - math.log(prob("block", s, i)) for i in range(order, len(s))) / (len(s) - order)
    yes, no = ([score[u] for u in label if label[u] == v] for v in ("allow", "block"))
    t = None
    if yes and no:
        ys, ns = statistics.pstdev(yes), statistics.pstdev(no)
        ym, nm = statistics.fmean(yes), statistics.fmean(no)
        t = (ym * ns + nm * ys) / (ys + ns) if ys + ns else (ym + nm) / 2
    out = {}
    for u in label:
        out[u] = label[u] or ("allow" if t is None or score[u] >= t else "block")
    return out, score


def test_parts_rules_and_verdicts(spark):
    rng = random.Random(1)
    urls = [None, "", "example.org/es/", "http://", "http://EXAMPLE.org/es/x?y#z", "https://a.example.org/en/12", "ftp://org/", "x://org",
            "http://borg/", "http://a.com/fr/", "http://a.com/de/", "http://a.com/DE/", "http://a.com?/de/", "http://É.com/fr/é",
            "http://example.org#/es/", "a://b://c.org/d"]
    for _ in range(200):
        urls.append(f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'bb', 'www.c'])}.{rng.choice(['example.org', 'example.net', 'x.com', 'org'])}"
                    f"/{rng.choice(['en', 'es', 'de', 'fr'])}/{rng.randrange(3000)}{rng.choice(['', '.html', '?q=1', '#top'])}")
    urls += [urls[20]] * 30
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[20])], "page_id long, url string")
    want, score = brute(urls)
    rows = M.url_filter(df, URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path = parts(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path)[1])
        assert r.verdict == ("block" if r.url is None else want[r.url]), r
        if r.url is not None:
            assert abs(r.score - score[r.url]) < 1e-9


def test_without_examples_and_empty(spark):
    schema = "page_id long, url string, host string, score int, gram string"
    df = spark.createDataFrame([(1, "http://a.net/x", "h", 1, "g"), (2, None, "h", 1, "g")], schema)
    assert {r.page_id: r.verdict for r in M.url_filter(df, URL_RULES).collect()} == {1: "allow", 2: "block"}
    assert M.url_filter(spark.createDataFrame([], schema), URL_RULES).count() == 0
