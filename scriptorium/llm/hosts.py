"""URL filter: rules, and empirical-Bayes host reputation for what no rule fits. DataFrame functions only.

Address. The host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``, ``#`` or the end.

Rules. A rule (host, path, verdict) fits its host and all subdomains of it, if the address's path starts with its path. The longest rule (host
and path together) wins, then the one with the longer host, then ``block``. Up to INLINE_RULES rules are looked through in place; more are joined by
the keys that an address may match: each suffix of its host at a dot with each beginning of its path that is as long as some rule's path.

Reputation. A labelled page is bad if it is of low quality or toxic. Outcomes are counted by host, and hosts are summed up to registered domains and
suffixes. Every level is a beta prior for the next one:

    suffix = (bad + k1 * global) / (n + k1)    domain = (bad + k2 * suffix) / (n + k2)    host ~ Beta(bad + k3 * domain, n - bad + k3 * (1 - domain))

k is a level's prior strength, by the method of moments for beta-binomial counts: the spread of its rates around their priors beyond the binomial
spread; but a prior counts for no more labelled pages than stand behind it. A page is blocked if the host's bad rate is above BAD_RATE with probability 1 - RISK at least: the lower bound is ``mean - sd * sqrt((1 - RISK) /
RISK)`` (Cantelli's inequality, which holds for every beta posterior). Hosts without labels have their domain's posterior as prior, and so on up.

Scale. Labels meet narrow (page, host) counts; all later tables have a row a host at most, and a host with a third of all pages is one row after
partial aggregation. Verdicts come back to the pages by broadcast if the hosts are few, else by a shuffle whose hot hosts adaptive execution splits.

Results for odd rows: a null address or one without ``://`` has the empty host and path, which is a host of its own; an address without dots, or of digits and dots alone, is its
own domain and suffix; null page ids have no labels; repeated labels count once a row, repeated pages too; labels null in both columns don't count, if one is null the other
decides; without any labels nothing is blocked but by rules; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import join_sized, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Second-level labels under which names are registered in country domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
INLINE_RULES = 200
BAD_RATE, RISK = 0.5, 0.05
#: Limits of a level's prior strength, and its value where too few groups tell it.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 10_000.0, 10.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The suffix under which names are registered: the last label, or two if the second one says so."""
    parts = F.split(host, r"\.")
    last, second = F.element_at(parts, -1), F.when(F.size(parts) > 2, F.element_at(parts, -2))
    wide = (F.length(last) == 2) & second.isin(*SECOND)
    own = (F.size(parts) < 2) | host.rlike(r"^[0-9.:]+$")
    return F.when(own, host).when(wide, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    suffix = suffix_of(host)
    before = F.split(F.expr("substring(host, 1, length(host) - length(suffix) - 1)"), r"\.")
    return F.when(host == suffix, host).otherwise(F.concat(F.element_at(before, -1), F.lit("."), F.col("suffix")))


def with_address(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule (host and path of the rule that wins) and rule_verdict to pages with host and path; null where no rule fits.

    rules: rows (host, path, verdict)."""
    own = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where("h is not null and verdict in ('allow', 'block')")
    few = own.limit(INLINE_RULES + 1).collect()
    rank = lambda r: F.struct((F.length(r["h"]) + F.length(r["p"])).alias("size"), F.length(r["h"]).alias("host_size"), r["verdict"].alias("verdict"), F.concat(r["h"], r["p"]).alias("rule"))
    if not few:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(few) <= INLINE_RULES:
        listed = F.array(*[F.struct(F.lit(r["h"]).alias("h"), F.lit(r["p"]).alias("p"), F.lit(r["verdict"]).alias("verdict")) for r in few])
        fits = lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"])
        best = F.array_max(F.transform(F.filter(listed, fits), rank))
        return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")
    best_of = written(own.groupBy("h", "p").agg(F.max("verdict").alias("verdict")), "host-rules")
    sizes = [r[0] for r in best_of.select(F.length("p")).distinct().collect()]  # at most the longest path
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = pages.select("host", "path").distinct().withColumn("h", F.explode(ends)).withColumn("p", F.explode(starts))
    found = join_sized(keys, best_of, ["h", "p"], "inner").groupBy("host", "path").agg(F.max(rank({c: F.col(c) for c in ("h", "p", "verdict")})).alias("_best"))
    joined = join_sized(pages, written(found, "host-ruled"), ["host", "path"])
    return joined.withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def outcomes(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id") -> DataFrame:
    """(host, n, bad) of the hosts with labelled pages."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    known = labels.select(F.col(label_key).alias("_id"), bad.alias("bad")).where("bad is not null and _id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    each = pages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id"), "host").agg(F.count(F.lit(1)).alias("times"))
    return each.join(known, "_id").groupBy("host").agg(F.sum(F.col("times") * F.col("n")).alias("n"), F.sum(F.col("times") * F.col("bad")).alias("bad"))


def strength(groups: DataFrame, prior: Column) -> float:
    """The prior strength k of beta-binomial groups (n, bad) around their priors, by the method of moments:
    the spread between groups is what their rates vary by beyond m (1 - m) / n, and k = m (1 - m) / spread - 1."""
    m = prior
    r = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2)).alias("q"), F.avg(m * (1 - m)).alias("binomial"),
    ).first()
    if not r["n"] or r["groups"] < 2 or not r["binomial"]:
        return UNKNOWN
    n, wide = float(r["n"]), float(r["n"]) - float(r["nn"]) / float(r["n"])
    spread = (float(r["q"]) - (r["groups"] - 1) * r["binomial"]) / wide
    return min(max(r["binomial"] / spread - 1, WEAKEST), STRONGEST) if spread > 0 else STRONGEST


def reputation(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id") -> DataFrame:
    """(host, n_labelled, n_bad, bad_rate, bound): the posterior mean and lower bound of every host's bad rate."""
    counts = written(outcomes(pages, labels, key, label_key), "host-outcomes")
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = (float(total["bad"] or 0) + 0.5) / (float(total["n"] or 0) + 1)
    hosts = pages.select("host").distinct().join(counts, "host", "left").na.fill(0, ["n", "bad"])
    tree = written(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))), "host-tree")
    # prior: the mean from the level above; weight: the labelled pages that stand behind it.
    prior, weight = F.lit(rate), F.lit(float(total["n"] or 0) + 1)
    above = tree
    for level in ("suffix", "domain"):
        # A level's groups know the prior from the level above by their own rows.
        groups = above.withColumns({"prior": prior, "weight": weight}).groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("prior").alias("prior"), F.max("weight").alias("weight"))
        k = F.least(F.lit(strength(groups.where("n > 0"), F.col("prior"))), "weight")
        means = groups.select(level, ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias(f"{level}_mean"), (F.col("n") + k).alias(f"{level}_weight"))
        above = written(join_sized(above, means, [level]), f"host-{level}")
        prior, weight = F.col(f"{level}_mean"), F.col(f"{level}_weight")
    k = F.least(F.lit(strength(above.where("n > 0"), prior)), weight)
    a, b = F.col("bad") + k * prior, F.col("n") - F.col("bad") + k * (1 - prior)
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bound = F.greatest(F.lit(0.0), mean - sd * F.lit(((1 - RISK) / RISK) ** 0.5))
    return above.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean.alias("bad_rate"), bound.alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """(key, host, path, rule, verdict, n_labelled, n_bad, bad_rate, bound) for every page: the rule's verdict, else that of its host's reputation."""
    narrow = with_address(pages.select(key, url), url).drop(url)
    known = reputation(narrow, labels, key, label_key)
    both = join_sized(ruled(narrow, rules), written(known, "host-reputation"), ["host"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("bound") > BAD_RATE, "block").otherwise("allow"))
    return both.select(key, "host", "path", "rule", verdict.alias("verdict"), "n_labelled", "n_bad", "bad_rate", "bound")


def allowed(pages: DataFrame, labels: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """The pages that may stay, with all their columns; pages whose keys repeat stay or go by their own addresses."""
    narrow = with_address(pages.select(key, url).distinct(), url)
    good = join_sized(ruled(narrow, rules), reputation(with_address(pages.select(key, url), url), labels, key, label_key), ["host"])
    kept = good.where(F.coalesce("rule_verdict", F.when(F.col("bound") > BAD_RATE, "block").otherwise("allow")) == "allow").select(F.col(key).alias("_k"), F.col(url).alias("_u"))
    return pages.join(kept, F.col(key).eqNullSafe(F.col("_k")) & F.col(url).eqNullSafe(F.col("_u")), "left_semi")


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bad_rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bound"))


QUERIES = {"op13_host_reputation": op13_host_reputation}


def _strength_sql(groups: str, prior: str) -> str:
    """SQL of a level's prior strength from rows (n, bad, prior)."""
    spread = f"(sum(n * power(1.0 * bad / n - {prior}, 2)) - (count(*) - 1) * avg({prior} * (1 - {prior}))) / (sum(n) - 1.0 * sum(n * n) / sum(n))"
    return f"""SELECT CASE WHEN count(*) < 2 THEN {UNKNOWN} WHEN {spread} > 0 THEN least(greatest(avg({prior} * (1 - {prior})) / ({spread}) - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END AS k FROM {groups} WHERE n > 0"""


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SECOND = ", ".join(f"'{s}'" for s in SECOND)
SQL = {
    "op13_host_reputation": f"""
WITH adr AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) r(h, p, v)),
fits AS (SELECT a.host, a.path, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY a.host, a.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.v DESC) AS place
  FROM (SELECT DISTINCT host, path FROM adr) a JOIN rules r ON (a.host = r.h OR suffix(a.host, '.' || r.h)) AND prefix(a.path, r.p)),
known AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN coalesce(quality, toxic) IS NOT NULL THEN 0 END AS bad FROM labels),
counts AS (SELECT a.host, count(*) AS n, sum(k.bad) AS bad FROM adr a JOIN known k ON a.page_id = k.doc_id WHERE k.bad IS NOT NULL GROUP BY a.host),
rate AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m, coalesce(sum(n), 0) + 1.0 AS mw FROM counts),
hosts AS (SELECT h.host, coalesce(c.n, 0) AS n, coalesce(c.bad, 0) AS bad, string_split(h.host, '.') AS parts FROM (SELECT DISTINCT host FROM adr) h LEFT JOIN counts c ON h.host = c.host),
sized AS (SELECT *, CASE WHEN len(parts) < 2 OR regexp_matches(host, '^[0-9.:]+$') THEN len(parts) WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS own FROM hosts),
named AS (SELECT host, n, bad, array_to_string(list_slice(parts, len(parts) - own + 1, len(parts)), '.') AS suf, array_to_string(list_slice(parts, greatest(1, len(parts) - own), len(parts)), '.') AS dom FROM sized),
suf AS (SELECT suf, sum(n) AS n, sum(bad) AS bad, max(m) AS prior, max(mw) AS weight FROM named, rate GROUP BY suf),
k1 AS ({_strength_sql("suf", "prior")}),
sufm AS (SELECT suf, (bad + least(k, weight) * prior) / (n + least(k, weight)) AS sm, n + least(k, weight) AS sw FROM suf, k1),
dom AS (SELECT dom, sum(n) AS n, sum(bad) AS bad, max(sm) AS prior, max(sw) AS weight FROM named JOIN sufm USING (suf) GROUP BY dom),
k2 AS ({_strength_sql("dom", "prior")}),
domm AS (SELECT dom, (bad + least(k, weight) * prior) / (n + least(k, weight)) AS dm, n + least(k, weight) AS dw FROM dom, k2),
full_hosts AS (SELECT host, n, bad, dm AS prior, dw AS weight FROM named JOIN domm USING (dom)),
k3 AS ({_strength_sql("full_hosts", "prior")}),
ab AS (SELECT host, n, bad, bad + least(k, weight) * prior AS a, n - bad + least(k, weight) * (1 - prior) AS b FROM full_hosts, k3),
rep AS (SELECT host, n, bad, a / (a + b) AS mean, greatest(0.0, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * sqrt({1 - RISK} / {RISK})) AS bound FROM ab)
SELECT a.page_id, a.host, a.path, f.rule, coalesce(f.v, CASE WHEN r.bound > {BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(r.n AS BIGINT) AS n_labelled, CAST(r.bad AS BIGINT) AS n_bad, round(r.mean, 6) AS bad_rate, round(r.bound, 6) AS bound
FROM adr a LEFT JOIN fits f ON a.host = f.host AND a.path = f.path AND f.place = 1 JOIN rep r ON a.host = r.host"""
}
