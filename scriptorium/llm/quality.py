"""Quality classifier with hierarchical empirical Bayes.

Evidence. For each target (``quality``, ``toxic``) a logistic regression gives every document log-odds from the tokens and
statistics of its whole text. It is fitted on the labelled rows, or on SAMPLE_ROWS of them picked by a hash if there are more
(the bound is this parameter; it is the one place where not all rows take part). Grouped aggregation over the sample's tokens counts
documents by token and label; the LEXICON tokens whose log-odds stand out most are the features.

Sites. Labelled rows are counted by host (``source``) and path (``source`` and ``lang``). The spread of the host rates
around the global rate gives the prior's strength (method of moments), so that sparse hosts shrink towards the global rate
and sparse paths towards their host:

    host = (good + k * global) / (n + k)        path = (good + k' * host) / (n + k')

A path without labelled rows has its host's rate, a host without any the global one.

Decision. log-odds = evidence + logit(path) - logit(global); without a model the evidence is logit(global). A document is rejected if it is more likely bad than
good, or more likely toxic than not.

Scale. One pass over the texts with narrow output; the model (LEXICON weights) and the site table (broadcast if small, else a shuffled join
of narrow rows whose hot hosts adaptive execution splits) are all that meets them.

Results for odd rows: a null or empty text has the evidence of its statistics; a null source or lang is a site of its own; ids without label
only take part as documents, labels without document are ignored, a repeated label counts once per row; null labels are left out; without labels of
both kinds for a target its score is 1/2, and nothing is rejected on it; repeated rows repeat; an empty table gives an empty result; other columns pass through
:func:`keep_good`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scriptorium.llm.common import join_sized, table, tune, written

#: Labelled rows that a fit takes at most, and features of a model.
SAMPLE_ROWS, LEXICON = 20_000, 1_000
TARGETS = ("quality", "toxic")
TOKEN = re.compile(r"\w+|[^\w\s]+")


def features_of(text: str | None) -> set[str]:
    """Distinct tokens, and coarse statistics as tokens: share of symbols, of distinct words, mean length, size."""
    found = TOKEN.findall((text or "").lower())
    out, n = set(found), len(found)
    symbols = sum(1 for t in found if not (t[0].isalnum() or t[0] == "_"))
    stats = (("symbols", symbols / max(1, n)), ("distinct", len(out) / max(1, n) ** 0.85), ("length", sum(map(len, found)) / max(1, n) / 10))
    out.update(f" {name}{min(9, int(value * 10))}" for name, value in stats)
    out.add(f" size{int(math.log2(n + 1))}")
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text_col: str) -> DataFrame:
    """Labelled rows with their feature tokens, at most about SAMPLE_ROWS of them, in the shared folder."""
    known = labels.select(key, *TARGETS).where(" or ".join(f"{t} is not null" for t in TARGETS)).where(F.col(key).isNotNull())
    share = SAMPLE_ROWS / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
    # Labelled keys are bounded by the sample, so that they meet the texts by broadcast.
    rows = docs.select(key, text_col).join(F.broadcast(known), key)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features_of(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *batch.columns[1:]], names=["tokens", *TARGETS])

    return written(rows.select(text_col, *[F.col(t).cast("int") for t in TARGETS]).mapInArrow(tokens, "tokens array<string>, " + ", ".join(f"{t} int" for t in TARGETS)), "quality-sample")


def lexicon(rows: DataFrame, target: str) -> list[str]:
    """The tokens whose log-odds between the labels stand out most in standard errors."""
    size = rows.agg(F.sum(target), F.count(F.lit(1))).first()
    good, bad = float(size[0]), float(size[1] - size[0])
    counts = rows.select(target, F.explode("tokens").alias("token")).groupBy("token").agg((F.sum(target) + 0.5).alias("a"), (F.sum(1 - F.col(target)) + 0.5).alias("b"))
    odds = F.log(F.col("a") / (good + 1 - F.col("a"))) - F.log(F.col("b") / (bad + 1 - F.col("b")))
    top = counts.where("a + b > 4").withColumn("z", F.abs(odds) / F.sqrt(1 / F.col("a") + 1 / F.col("b"))).orderBy(F.col("z").desc(), "token").limit(LEXICON)
    return [r["token"] for r in top.select("token").collect()]


def fit(rows: DataFrame, target: str) -> tuple[dict[str, float], float]:
    """Weights by token and the intercept; no weights if a label is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    rows = rows.where(F.col(target).isNotNull())
    if rows.select(target).distinct().count() < 2 or not (tokens := lexicon(rows, target)):
        return {}, 0.0
    vectors = CountVectorizerModel.from_vocabulary(tokens, "tokens", "features").setBinary(True).transform(rows).select("features", F.col(target).cast("double").alias("label")).persist()
    model = LogisticRegression(regParam=0.0003, elasticNetParam=0.5, maxIter=60, standardization=False).fit(vectors)
    vectors.unpersist()
    return {t: float(w) for t, w in zip(tokens, model.coefficients.toArray()) if w}, float(model.intercept)


def site_rates(counts: DataFrame, target: str) -> tuple[DataFrame, float]:
    """(source, lang, <target>_rate) shrunk by two levels of empirical Bayes, and the global rate.

    counts: rows (source, lang, <targets>, count), one a path and pair of labels."""
    paths, _, rate = all_rates(counts, target)
    return paths, rate


def all_rates(counts: DataFrame, target: str) -> tuple[DataFrame, DataFrame, float]:
    """The rates of the paths, those of the hosts (source, <target>_host_rate), and the global rate."""
    rows = counts.where(F.col(target).isNotNull())
    paths = rows.groupBy("source", "lang").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col(target)).alias("good"))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good")).first()
    rate = (float(total["good"] or 0) + 0.5) / (float(total["n"] or 0) + 1)

    def strength(groups: DataFrame, size: str, hits: str, centre: Column) -> float:
        """The prior's strength from the variance of the rates beyond the binomial one."""
        spread = F.col(size) * F.pow(F.col(hits) / F.col(size) - centre, 2)
        r = groups.agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(spread).alias("q"), F.sum(F.col(size) * F.col(size)).alias("nn")).first()
        if not r["n"] or r["sites"] < 2:
            return 10.0
        binomial, wide = rate * (1 - rate), float(r["n"]) - float(r["nn"]) / float(r["n"])
        between = max((float(r["q"]) - (r["sites"] - 1) * binomial) / wide, 1e-4 * binomial)
        return min(max(binomial / between - 1, 1.0), 1e4)

    k = strength(hosts, "hn", "hgood", F.lit(rate))
    hosts = hosts.select(F.col("source").alias("_host"), ((F.col("hgood") + k * rate) / (F.col("hn") + k)).alias("host_rate"))
    both = paths.join(hosts, F.col("source").eqNullSafe(F.col("_host")))
    k2 = strength(both, "n", "good", F.col("host_rate"))
    of_paths = both.select("source", "lang", ((F.col("good") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias(f"{target}_rate"))
    return of_paths, hosts.select(F.col("_host").alias("source"), F.col("host_rate").alias(f"{target}_host_rate")), rate


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """Rows (key, source, lang, quality_score, toxic_score, accepted): posterior probabilities and the decision.

    row: carry the document's columns along in a struct _row."""
    rows = sample(docs, labels, key, text_col)
    models = {t: fit(rows, t) for t in TARGETS}
    known = labels.select(key, *[F.col(t).cast("int").alias(t) for t in TARGETS]).where(F.col(key).isNotNull())
    counts = written(join_sized(docs.select(key, "source", "lang"), known, [key], "inner").groupBy("source", "lang", *TARGETS).count(), "quality-sites")
    return posterior(_evidence(docs, models, key, text_col, row), models, counts)


def _evidence(docs: DataFrame, models: dict[str, tuple[dict[str, float], float]], key: str, text_col: str, row: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)
    narrow = docs.select(F.col(text_col).alias("_text"), key, "source", "lang", *([F.struct(*docs.columns).alias("_row")] if row else []))
    names = [*narrow.columns[1:], *[f"{t}_evidence" for t in TARGETS]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(w, w.keys(), b) for w, b in (shared.value[t] for t in TARGETS)]
        for batch in batches:
            sums: list[list[float]] = [[] for _ in TARGETS]
            for text in batch.column(0).to_pylist():
                found = features_of(text)
                for out, (w, tokens, b) in zip(sums, known):
                    out.append(b + math.fsum(w[t] for t in found & tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, pa.float64()) for x in sums]], names=names)

    fields = [*narrow.schema.fields[1:], *[StructField(f"{t}_evidence", DoubleType()) for t in TARGETS]]
    return narrow.mapInArrow(emit, StructType(fields))


def posterior(evidence: DataFrame, models: dict, counts: DataFrame) -> DataFrame:
    """Adds the site posteriors to the evidence and decides."""
    out = evidence
    # A null site is told from an empty name by its flag.
    flags = {"_s": F.coalesce("source", F.lit("")), "_sn": F.col("source").isNull(), "_l": F.coalesce("lang", F.lit("")), "_ln": F.col("lang").isNull()}
    host_flags = {n: flags[n] for n in ("_s", "_sn")}
    for t in TARGETS:
        score = f"{t}_score"
        if counts.where(F.col(t).isNotNull()).select(t).distinct().count() < 2:
            out = out.withColumn(score, F.lit(0.5)).drop(f"{t}_evidence")
            continue
        paths, hosts, rate = all_rates(counts, t)
        known = math.log(rate / (1 - rate))
        # Without a model a document's evidence is what is known of all of them.
        evidence_of = F.col(f"{t}_evidence") if models[t][0] else F.lit(known)
        out = join_sized(out.withColumns(flags), paths.select(*[c.alias(n) for n, c in flags.items()], f"{t}_rate"), list(flags))
        out = join_sized(out, hosts.select(*[c.alias(n) for n, c in host_flags.items()], f"{t}_host_rate"), list(host_flags)).drop(*flags)
        # A path without labels shrinks wholly to its host, such a host to the global rate.
        site = F.coalesce(f"{t}_rate", f"{t}_host_rate", F.lit(rate))
        prior = F.log(site / (1 - site)) - known
        out = out.withColumn(score, 1 / (1 + F.exp(-(evidence_of + prior)))).drop(f"{t}_rate", f"{t}_host_rate", f"{t}_evidence")
    return out.withColumn("accepted", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") <= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return score(docs, labels, key, text_col, row=True).where("accepted").select("_row.*")


def op3_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_site_bayes": op3_site_bayes}
SQL: dict[str, str] = {}
