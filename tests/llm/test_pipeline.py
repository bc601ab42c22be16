import corpus_pipeline
from scriptorium.llm import bpe, decontaminate, neardup, quality
from scriptorium.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs)
    start, good, single, clean, masked, ids = seen
    assert all(x.columns == columns for x in seen[:-1])
    ids_of = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    accepted = {r.doc_id for r in quality.score(start, table(spark, SF, "labels")).where("accepted").collect()}
    assert ids_of(good) == accepted
    assert ids_of(single) == {r.class_id for r in neardup.classes(good).collect()}
    leaks = {r.doc_id for r in decontaminate.find_leaks(single, table(spark, SF, "benchmark")).collect()}
    assert ids_of(clean) == ids_of(single) - leaks
    before = {r.doc_id: r.text for r in clean.collect()}
    assert ids_of(masked) == set(before) and all(r.text == before[r.doc_id] or "[SECRET]" in r.text for r in masked.collect())
    assert sorted(ids.collect()) == sorted(bpe.digests(masked).collect())


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(q[2:].split("_")[0]) for q in __spark_entry__.queries() if q.startswith("op")) == list(range(1, 14))
