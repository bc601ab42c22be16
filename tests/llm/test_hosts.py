import random
import re
from collections import Counter

import duckdb
import pytest

from scriptorium.llm import hosts

PAGES, LABELS, RULES = "page_id long, url string", "doc_id long, quality int, toxic int", "host string, path string, verdict string"


def address(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def best_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:1:-1] if fits else (None, None)


def urls(n, seed=2):
    rng = random.Random(seed)
    part = lambda: rng.choice(["a", "b", "example", "org", "com", "co", "uk"])
    out = [f"{rng.choice(['http', 'https'])}://{'.'.join(part() for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/en', '/en/1', '/es/', '/fr/x', '/de/y'])}{rng.choice(['', '?q=/es/', '#/de/'])}" for _ in range(n)]
    return out + [None, "", "no scheme", "x://", "://HOST.Org/es/1", "http://a://b/c", "http://org/\n/", "http://xorg/", "http://.org/", "http://10.0.0.1:80/en", "http://ORG?x", "http://Ä.ORG/es/"]


def test_addresses(spark):
    given = urls(200)
    rows = hosts.with_address(spark.createDataFrame(list(enumerate(given)), PAGES)).collect()
    assert all((r.host, r.path) == address(given[r.page_id]) for r in rows) and len(rows) == len(given)


@pytest.mark.parametrize("inline", [200, 0])
def test_rules_equal_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(hosts, "INLINE_RULES", inline)
    rules = [*hosts.RULES, ("a.com", "/", "block"), ("com", "/en", "allow"), ("com", "/en", "block"), ("b", "", "allow"), ("co.uk", "/en/1", "block"), ("uk", "/en", "allow"), ("X.ORG", "/", "block"), ("", "", "allow")]
    given = urls(400)
    rows = hosts.ruled(hosts.with_address(spark.createDataFrame(list(enumerate(given)), PAGES)), spark.createDataFrame(rules, RULES)).collect()
    lower = [(h.lower(), p, v) for h, p, v in rules]
    assert len(rows) == len(given)
    for r in rows:
        assert (r.rule, r.rule_verdict) == best_rule(*address(given[r.page_id]), lower), given[r.page_id]


def test_no_rules(spark):
    rows = hosts.ruled(hosts.with_address(spark.createDataFrame([(1, "http://a.b/c")], PAGES)), spark.createDataFrame([], RULES)).collect()
    assert [(r.rule, r.rule_verdict) for r in rows] == [(None, None)]


def test_domains_and_suffixes(spark):
    names = {"www.a.example.com": ("com", "example.com"), "a.co.uk": ("co.uk", "a.co.uk"), "x.a.co.uk": ("co.uk", "a.co.uk"), "co.uk": ("uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "a.b.de": ("de", "b.de")}
    df = spark.createDataFrame([(h,) for h in names], "host string")
    rows = df.withColumn("suffix", hosts.suffix_of(df.host)).withColumn("domain", hosts.domain_of(df.host)).collect()
    assert {r.host: (r.suffix, r.domain) for r in rows} == names


def reputation(counts):
    """The same hierarchy in plain Python, from host -> (n, bad)."""

    def suffix(h):
        return h.split(".")[-1]

    def domain(h):
        return ".".join(h.split(".")[-2:])

    def strength(groups):
        groups = [g for g in groups if g[0]]
        n = sum(g[0] for g in groups)
        if len(groups) < 2:
            return 10.0
        wide = n - sum(g[0] ** 2 for g in groups) / n
        m = sum(g[2] * (1 - g[2]) for g in groups) / len(groups)
        spread = (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - (len(groups) - 1) * m) / wide
        return min(max(m / spread - 1, 1.0), 1e4) if spread > 0 else 1e4

    total = sum(n for n, _ in counts.values()), sum(b for _, b in counts.values())
    prior, weight = dict.fromkeys(counts, (total[1] + 0.5) / (total[0] + 1)), dict.fromkeys(counts, total[0] + 1)
    for of in (suffix, domain):
        groups = {}
        for h, (n, b) in counts.items():
            g = groups.setdefault(of(h), [0, 0, prior[h], weight[h]])
            g[0], g[1] = g[0] + n, g[1] + b
        most = strength(groups.values())
        k = {h: min(most, groups[of(h)][3]) for h in counts}
        prior = {h: (groups[of(h)][1] + k[h] * groups[of(h)][2]) / (groups[of(h)][0] + k[h]) for h in counts}
        weight = {h: groups[of(h)][0] + k[h] for h in counts}
    most = strength([(n, b, prior[h]) for h, (n, b) in counts.items()])
    out = {}
    for h, (n, bad) in counts.items():
        k = min(most, weight[h])
        a, b = bad + k * prior[h], n - bad + k * (1 - prior[h])
        mean, sd = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        out[h] = mean, max(0.0, mean - sd * 19**0.5)
    return out


def labelled(spark, sizes, seed=7):
    """sizes: host -> (pages, labelled, bad)."""
    pages, labels, i = [], [], 0
    for host, (n, known, bad) in sizes.items():
        for k in range(n):
            pages.append((i, f"http://{host}/{k}"))
            if k < known:
                labels.append((i, 0 if k < bad and k % 2 else 1, 1 if k < bad and not k % 2 else 0))
            i += 1
    random.Random(seed).shuffle(pages)
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)


SIZES = {"spam.bad.com": (300, 200, 195), "new.bad.com": (9, 0, 0), "small.bad.com": (3, 2, 2), "good.org": (900, 500, 10), "www.good.org": (50, 40, 1), "lone.net": (5, 1, 1), "x.net": (40, 30, 3)}


def test_reputation_equals_plain_python(spark):
    pages, labels = labelled(spark, SIZES)
    want = reputation({h: (known, bad) for h, (_, known, bad) in SIZES.items()})
    rows = hosts.reputation(hosts.with_address(pages), labels).collect()
    assert {r.host: (r.n_labelled, r.n_bad) for r in rows} == {h: (known, bad) for h, (_, known, bad) in SIZES.items()}
    for r in rows:
        assert abs(r.bad_rate - want[r.host][0]) < 1e-9 and abs(r.bound - want[r.host][1]) < 1e-9


def test_bad_hosts_are_blocked_and_sparse_ones_shrink(spark):
    pages, labels = labelled(spark, SIZES)
    rows = hosts.judged(pages, labels, spark.createDataFrame([], RULES)).collect()
    # Hosts with few labels or none go with their domain, of which nearly all labelled pages are bad.
    assert {h: {r.verdict for r in rows if r.host == h} for h in SIZES} == {h: {"block" if h.endswith("bad.com") else "allow"} for h in SIZES}
    rate = {r.host: r.bad_rate for r in rows}
    assert rate["good.org"] < rate["lone.net"] < rate["new.bad.com"] < rate["spam.bad.com"]
    kept = hosts.allowed(pages, labels, spark.createDataFrame([("x.net", "/", "block")], RULES)).count()
    assert kept == sum(n for n, _, _ in SIZES.values()) - 312 - 40


def test_bound_is_below_the_posterior_quantile():
    """Cantelli's bound never exceeds the 5 % quantile of the beta posterior (by sums over a fine grid)."""
    for a, b in ((0.3, 5.0), (2.0, 2.0), (50.0, 3.0), (195.0, 8.0), (1.0, 1.0)):
        mean, sd = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        bound = max(0.0, mean - sd * ((1 - hosts.RISK) / hosts.RISK) ** 0.5)
        grid = [(i + 0.5) / 20_000 for i in range(20_000)]
        mass = [x ** (a - 1) * (1 - x) ** (b - 1) for x in grid]
        assert sum(m for x, m in zip(grid, mass) if x <= bound) <= hosts.RISK * sum(mass)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/x"), (2, "plain"), (3, "http://" + "s." * 200 + "com/" + "p" * 50_000)], PAGES)
    labels = spark.createDataFrame([(1, None, 1), (1, 1, None), (2, None, None), (None, 1, 1), (77, 0, 0)], LABELS)
    rules = spark.createDataFrame([(None, "/", "block"), ("com", None, "block"), ("a.com", "/", "odd")], RULES)
    rows = Counter((r.page_id, r.host[:5], r.rule, r.verdict, r.n_labelled, r.n_bad) for r in hosts.judged(pages, labels, rules).collect())
    assert rows == Counter({(1, "", None, "allow", 2, 1): 1, (1, "a.com", "com", "block", 4, 2): 2, (None, "a.com", "com", "block", 4, 2): 1, (2, "", None, "allow", 2, 1): 1, (3, "s.s.s", "com", "block", 0, 0): 1})
    empty = spark.createDataFrame([], LABELS)
    assert {r.verdict for r in hosts.judged(pages, empty, spark.createDataFrame([], RULES)).collect()} == {"allow"}
    assert not hosts.judged(spark.createDataFrame([], PAGES), labels, rules).collect()


def test_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", 5)], PAGES + ", host string, bad int")
    labels = spark.createDataFrame([(1, 1, 0, "z")], LABELS + ", host string")
    assert [(r.host, r.verdict) for r in hosts.judged(pages, labels, spark.createDataFrame([], RULES)).collect()] == [("a.com", "allow")]


def test_query_equals_sql_with_blocked_hosts(spark, tmp_path):
    pages, labels = labelled(spark, SIZES | {"a.example.org": (20, 5, 1), "co.uk": (4, 4, 4), "a.b.co.uk": (60, 50, 50)})
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = hosts.op13_host_reputation(spark, str(tmp_path))
    rel = duck.sql(hosts.SQL["op13_host_reputation"])
    at = [list(rel.columns).index(c) for c in found.columns]
    rows = sorted(map(str, (tuple(r) for r in found.collect())))
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert any("'block'" in r for r in rows)
