"""Findings of the third round: queries against their SQL on rows that told them apart, and steps that have to stay small."""

import duckdb
from pyspark.sql import functions as F

from scriptorium.functions import numbers
from scriptorium.operators import phrases, translate
from scriptorium.plans import registry


def against_sql(spark, path, name, **tables):
    """The sorted rows of a query and of its SQL on small tables of one's own."""
    connection = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    df, rel = registry.QUERIES[name](spark, str(path)), connection.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    return sorted(str([r[c] for c in columns]) for r in df.collect()), sorted(str([r[i] for i in at]) for r in rel.fetchall())


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_words_of_mail_addresses_count(spark, tmp_path):
    texts = ["of.92@mail6.example.com 5755", "One a.example.com", "See https://a.example/b c", "https://a\x0bbc de", "", "NASA HQ", None]
    got, wanted = against_sql(spark, tmp_path, "han_needed", documents=documents(spark, texts))
    assert got == wanted


def test_only_lines_that_can_match_are_tried():
    """The lines that a text's grams rule out never match it, and short pairs are compared once."""
    wordings, readings = numbers.rules()
    lines = [*wordings, *readings]
    texts = ["Q3 2021 revenue was 512 million", "2021年第三季度收入51200万", "In the second quarter", "twenty-three of one hundred and five", "DOUBLED to 5", "一百零五", "no numbers here", "the ſixth, ３ and 二手车", "p50 and $1.5bn, World War II"]
    tried = [numbers.met(numbers.grams(x)) for x in texts]
    assert all(i in near for x, near in zip(texts, tried) for i, line in enumerate(lines) if line[1].search(x))
    assert sum(map(len, tried)) < len(texts) * len(lines) / 4
    numbers.remembered_level.cache_clear()
    assert [numbers.level_of("costs 3", x) for x in ("价3", "价4", "价3")] == ["ok", "error", "ok"] and numbers.remembered_level.cache_info().hits == 1


def test_a_function_that_names_the_module_is_dealt_after_comparisons(spark):
    """A comparison leaves no handle of the session in the module, which functions that are sent to tasks refer to."""
    from pyspark import cloudpickle

    from scriptorium.operators import translate

    pair = spark.createDataFrame([("costs 3", "价3")], "a string, b string")
    assert pair.select(numbers.integrity(F.col("a"), F.col("b"))["level"], numbers.level(F.col("a"), F.col("b"))).first() == ("ok", "ok")
    cloudpickle.dumps(lambda: translate.Fatal("limit"))


def test_queries_of_common_words_shuffle_no_postings(spark, tmp_path):
    """Texts that share a query's common words but not its rarest one make no rows, and no text is shuffled."""
    docs = documents(spark, ["the of and rare", "the of and"] + ["the of and other"] * 30 + ["", None])
    asked = spark.createDataFrame([(1, "The rare and the of"), (2, "of the missing"), (3, "..."), (4, "and of")], "item_id long, text string")
    got, wanted = against_sql(spark, tmp_path, "search_index_hits", documents=docs, benchmark=asked)
    assert got == wanted and len(got) == 33
    plan = registry.QUERIES["search_index_hits"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan


def test_parts_are_made_of_few_texts_at_once(spark):
    """A batch of long texts is worked on in slices."""
    import pyarrow as pa

    from scriptorium.operators import packing

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 100_000] * 39 + [None])], names=["k", "t"])
    assert max(p.num_rows for p in packing.pieces(iter([batch]), 1)) <= 11 and sum(p.num_rows for p in packing.pieces(iter([batch]), 1)) == 40
    rows = packing.unit_parts(spark.createDataFrame([(1, "a. " * 400), (2, None), (3, "short")], "k long, t string"), ["k"], "t", 800).collect()
    assert [(r.k, r.part, r.t) for r in rows] == [(k, i, p) for k, t in ((1, "a. " * 400), (2, ""), (3, "short")) for i, p in enumerate(packing.split_text(t, 500))]


def test_queries_of_the_same_words_are_asked_once(spark):
    """The answers of repeated queries are copied, not searched again."""
    from scriptorium.operators import search

    segments = spark.createDataFrame([(d, 0, f"one two w{d}") for d in range(30)], "doc long, seg long, text string")
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in ["one two" if q % 2 else "Two, one"]], "q long, text string")
    rows = search.ranked_hits(segments, asked, "doc", "seg", "q", "text").collect()
    assert len(rows) == 40 * 20 and {(r.q, r.rank, r.doc, r.anchor, r.span) for r in rows} == {(q, k + 1, k, 0, 2) for q in range(40) for k in range(20)}
    assert sorted(rows[0].asDict()) == ["anchor", "doc", "q", "rank", "score", "span"]


def test_phrases_of_odd_texts(spark, tmp_path):
    texts = ["a b c d \r", "a b c d\r", "A  b\nc d e", "a b c", "", " \n ", None, "x y x y x y x y", "p q r s t", "p q r s t", "é 数 ß\tz \u3000 w v", "the the the the the the"]
    got, wanted = against_sql(spark, tmp_path, "unique_phrases", documents=documents(spark, texts))
    assert got == wanted


def test_a_common_pair_leads_no_phrase(spark, tmp_path):
    texts = [f"w{i % 7} of the w{i % 11} v{i} of the v{i % 13}" for i in range(300)] + ["of the of the of the"] * 5
    got, wanted = against_sql(spark, tmp_path, "unique_phrases", documents=documents(spark, texts))
    assert got == wanted


def test_phrases_travel_in_packed_stretches(spark):
    """Before, each run of four words was a row of the shuffle."""
    docs = spark.createDataFrame([(" ".join(f"word{(i * 7919 + j * 104729) % 9973}" for j in range(400)),) for i in range(200)], "text string").coalesce(1)
    rows = phrases.packed(docs, 4, phrases.sketched(docs) > 10**9, 8).collect()
    runs = 200 * 397
    assert len(rows) <= 16 and sum(r["size"] for r in rows) < 0.75 * runs * len("word1234 word1234 word1234 word1234")
    assert sum(len(r["stretches"]) for r in rows) < 15 * runs
    assert phrases.unique_phrases(docs, "text", 4).count() == docs.selectExpr("explode(transform(sequence(1, 397), i -> slice(split(text, ' '), i, 4))) p").groupBy("p").count().where("count = 1").count()


def test_a_run_asks_for_each_unit_once(spark, tmp_path, monkeypatch):
    """Before, the outcomes were made anew wherever they were read."""
    calls, called = spark.sparkContext.accumulator(0), translate.called

    def watched(units, run, most=translate.BATCH_CHARS):
        def counting(texts):
            calls.add(len(texts))
            return run(texts)

        return called(units, counting, most)

    monkeypatch.setattr(translate, "called", watched)
    docs = documents(spark, [f"text {i} of the run" for i in range(40)] + ["text 1 of the run", "twice", "twice"])
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    got, wanted = against_sql(spark, tmp_path, "translation_run", documents=docs, labels=labels)
    assert got == wanted
    assert calls.value == sum("True" in r for r in got)
