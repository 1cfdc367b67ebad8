import math
import random

from pyspark.sql import functions as F

from voxtally.llm import url_filter as U

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
URLS = {
    "http://A.Example.com/en/1?x=2#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://www.EXAMPLE.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"),
    "ftp://x.net": ("x.net", "", None, "allow"),
    "http://com?/": ("com", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://ÄB.net/es/": ("Äb.net", "/es/", "net/es/", "block"),
}


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good boolean")


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("x"))
    out = U.filter_urls(pages, outcomes(spark, []), RULES).collect()
    assert {r.page_id: tuple(r[1:]) for r in out} == dict(enumerate(URLS.values()))


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk:80": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r[0]: (r[1], r[2]) for r in df.select("h", U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()}
    assert got == hosts


def strength(units):
    n, k = sum(n for n, _ in units), sum(k for _, k in units)
    p = k / n
    if not 0 < p < 1 or n == sum(n * n for n, _ in units) / n:
        return 1000.0
    spread = sum(m * (j / m - p) ** 2 for m, j in units)
    rho = (spread - p * (1 - p) * (len(units) - 1)) / (n - sum(m * m for m, _ in units) / n) / (p * (1 - p))
    return 1000.0 if rho <= 0 else min(1000.0, max(1.0, 1 / rho - 1))


def test_reputation_is_shrunk_level_by_level(spark):
    rng = random.Random(3)
    rates = {f"h{i}.d{i % 3}.{'com' if i % 2 else 'org'}": rng.random() for i in range(12)}
    pages, labels = [], []
    for i in range(600):
        host = rng.choice(list(rates))
        pages.append((i, f"http://{host}/p{i}"))
        if rng.random() < 0.6:
            labels.append((i, rng.random() < rates[host]))
    pages += [(700, "http://new.d0.com/"), (701, None)]
    labels += [(900, True), (5, None)] if 5 not in {p for p, _ in labels} else [(900, True)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.host: r for r in U.host_reputation(df, outcomes(spark, labels)).collect()}
    good = {p: g for p, g in labels if g is not None}
    units = {h: [0, 0] for h in [*rates, "new.d0.com", ""]}
    for p, u in pages:
        if p in good:
            host = u.split("/")[2]
            units[host][0] += 1
            units[host][1] += good[p]
    levels = {}
    for name, key in (("d", lambda h: ".".join(h.split(".")[-2:])), ("s", lambda h: h.split(".")[-1])):
        levels[name] = {}
        for h, (n, k) in units.items():
            if n:
                old = levels[name].get(key(h), (0, 0))
                levels[name][key(h)] = (old[0] + n, old[1] + k)
    top = levels["s"].values()
    rate = sum(k for _, k in top) / sum(n for n, _ in top)
    sh, sd, ss = (strength(list(v)) for v in ([u for u in units.values() if u[0]], levels["d"].values(), levels["s"].values()))
    for h, (n, k) in units.items():
        ns, ks = levels["s"].get(h.split(".")[-1], (0, 0))
        nd, kd = levels["d"].get(".".join(h.split(".")[-2:]), (0, 0))
        mean = (kd + sd * (ks + ss * rate) / (ns + ss)) / (nd + sd)
        mean = (k + sh * mean) / (n + sh)
        assert math.isclose(got[h].mean, mean) and (got[h].n, got[h].k) == (n, k)
        assert math.isclose(got[h].upper, mean + 1.645 * math.sqrt(mean * (1 - mean) / (n + sh + 1)))


def test_bad_hosts_are_blocked_on_evidence_only(spark):
    pages = [(i, f"http://{'bad' if i < 60 else 'good'}.org/{i}") for i in range(120)] + [(200, "http://rare.org/")]
    labels = [(i, i >= 60) for i in range(120)] + [(200, False)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = {r.page_id: r.verdict for r in U.filter_urls(df, outcomes(spark, labels), ()).collect()}
    assert {out[i] for i in range(60)} == {"block"} and {out[i] for i in range(60, 120)} == {"allow"}
    assert U.filter_urls(df.limit(0), outcomes(spark, []), RULES).collect() == []
