"""URL rules against a plain loop: odd urls, no rules, hosts of very many labels."""

import time

from attestlake.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("münchen.net", "/", "block"), ("net", "/", "allow"), ("net", "/", "block")]
URLS = [
    "http://a.Example.COM/en/x?y#z", "https://www.example.com/en/", "x://net/es/a", "x://net", "x://.net/es/", "x://a.net/es", "x://MÜNCHEN.net/", "x://münchen.net/a", "no scheme", "", None,
    "a://b://com/", "x://com?/", "x:///com/", "x://examplecom/en/", "x://com./", "x://u@a.com:80/", "x://a..com/",
]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = {h + p: v for h, p, v in RULES if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)}
    best = max(fits, key=len, default=None)
    return host, slash + path, best, fits.get(best, "allow")


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "again")], "page_id long, url string, verdict string")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert urls.judge(df.where("false"), RULES).count() == 0
    assert {(r.rule, r.verdict) for r in urls.judge(df, []).collect()} == {(None, "allow")}


def test_host_of_many_labels(tmp_path):
    urls.DigestArray.write(RULES, str(tmp_path / "rules"))
    a = urls.DigestArray(str(tmp_path / "rules"))
    start = time.perf_counter()
    assert a.string(a.probe(["a." * 200_000 + "example.com"], ["/en/"])[0]) == b"example.com/en/"
    assert time.perf_counter() - start < 1
