import random

from scriptorium.llm import quality

GOOD = "the river runs by the old town and people walk along it every day".split()
BAD = ["%%%", "###", "&&&"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 60))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w + rng.choice(BAD) for w in words]
        if toxic:
            words[3] = rng.choice(["vileword", "nastyword"])
        rows.append((i, " ".join(words), rng.choice(["en", "fr"]), f"src{i % 4}", int(not bad), int(toxic)))
    return rows


def frames(spark, rows, share=2):
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows if r[0] % share == 0], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs, labels = frames(spark, rows, 3)
    found = {r.doc_id: r.accepted for r in quality.score(docs, labels).collect()}
    held = [r for r in rows if r[0] % 3]
    assert len(found) == len(rows)
    assert sum(found[r[0]] == bool(r[4] and not r[5]) for r in held) >= 0.97 * len(held)


def test_table_accuracy_and_clean_documents(spark):
    rows = quality.op3_site_bayes(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    clean = both[(both.quality == 1) & (both.toxic == 0)]
    assert len(rows) == 1000 and clean.accepted.mean() > 0.97
    assert both[both.quality == 0].accepted.mean() < 0.05


def test_sparse_sites_shrink(spark):
    counts = spark.createDataFrame([("big", "en", 1, 0, 900), ("big", "en", 0, 0, 100), ("low", "en", 1, 0, 100), ("low", "en", 0, 0, 900), ("one", "en", 0, 0, 1), ("one", None, 1, 1, 2), (None, "en", 1, 0, 5)], "source string, lang string, quality int, toxic int, count long")
    rates, rate = quality.site_rates(counts, "quality")
    by = {(r.source, r.lang): r.quality_rate for r in rates.collect()}
    assert abs(by["big", "en"] - 0.9) < 0.02 and abs(by["low", "en"] - 0.1) < 0.02
    assert 0.1 < by["one", "en"] < rate < by["one", None] or 0.1 < by["one", "en"] < by["one", None] < 0.95
    assert (None, "en") in by


COUNTS = [("bad", "en", 0, 0, 95), ("bad", "en", 1, 0, 5), ("good", "en", 1, 0, 95), ("good", "en", 0, 0, 5), (None, "en", 0, 0, 50)]
EVIDENCE = [(1, "bad", "fr"), (2, "good", "fr"), (3, "new", "fr"), (4, "bad", "en"), (5, None, "fr"), (6, "", "fr"), (7, "bad", None)]


def site_scores(spark, weights):
    counts = spark.createDataFrame(COUNTS, "source string, lang string, quality int, toxic int, count long")
    evidence = spark.createDataFrame([(*r, 0.0, 0.0) for r in EVIDENCE], "doc_id long, source string, lang string, quality_evidence double, toxic_evidence double")
    rows = quality.posterior(evidence, {t: (weights, 0.0) for t in quality.TARGETS}, counts).collect()
    assert len(rows) == len(EVIDENCE) and all(r.toxic_score == 0.5 for r in rows)
    return {r.doc_id: r for r in rows}


def test_unlabelled_paths_have_their_hosts_rate(spark):
    rows = site_scores(spark, {"x": 1.0})
    assert abs(rows[3].quality_score - 0.5) < 1e-9 and rows[6].quality_score == rows[3].quality_score
    assert rows[1].quality_score < 0.2 and rows[5].quality_score < 0.2 and rows[2].quality_score > 0.8
    assert rows[7].quality_score == rows[1].quality_score and not rows[1].accepted and rows[2].accepted


def test_sites_decide_without_a_model(spark):
    rows = site_scores(spark, {})
    assert abs(rows[3].quality_score - 100.5 / 251) < 1e-9
    assert rows[4].quality_score < 0.1 and rows[1].quality_score < 0.1 < 0.8 < rows[2].quality_score
    assert not rows[4].accepted and rows[2].accepted


def test_odd_rows(spark):
    rows = corpus(60)
    docs, labels = frames(spark, rows)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (99, "w " * 50_000, "", "")], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None), (12345, 1, 1)], labels.schema))
    out = quality.score(docs.unionByName(odd), more).collect()
    assert len(out) == 64 and all(0 <= r.quality_score <= 1 for r in out)
    clash = docs.selectExpr("*", "1 as accepted", "2 as quality_score", "3 as _row")
    assert quality.keep_good(clash, labels).columns == clash.columns
    assert quality.score(docs, labels.limit(0)).where("accepted").count() == 60
    assert quality.score(docs.limit(0), labels).count() == 0
