"""Records built and merged, as a batch and as a stream that is stopped and run again."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import build as B
from scriptorium.operators.published import Store
from scriptorium.streaming import records as S

INDEX = "id string, type string, day string, title string, source_url string"


def seg(sid, text, speaker=None):
    return (sid, speaker, 1.0, text)


def built(spark, index, transcripts=(), details=(), before=None, **options):
    before = spark.createDataFrame([], B.RECORD) if before is None else before
    return B.build(spark.createDataFrame(index, INDEX), spark.createDataFrame(list(transcripts), B.FETCHED), spark.createDataFrame(list(details), B.FETCHED), before, options.pop("snapshot", "s1"), "now", **options)


def one(df):
    return {r.id: r for r in df.collect()}


A = ("a", "speech", "2024-01-01", "From index", "https://x.example/a")
T = ("a", "From transcript", None, None, "dialogue", [seg("s1", "one", "Ann"), seg("s2", "two")], "made")
D = ("a", "From page", "About", "https://www.youtube.com/embed/abcdefghijk", "article", [seg("s1", "page")], "page")


def test_precedence(spark):
    row = one(built(spark, [A], [T], [D]))["a"]
    assert (row.outcome, row.origin, row.title_en, row.summary_en, row.kind, row.transcript_source, row.embed_url) == ("written", "transcript", "From transcript", "About", "dialogue", "made", "https://www.youtube-nocookie.com/embed/abcdefghijk")
    assert [s.text_en for s in row.segments] == ["one", "two"] and row.status == "pending" and row.snapshot == "s1" and row.source_missing is False
    empty = ("a", None, None, None, "none", [], None)
    row = one(built(spark, [A], [empty], [D]))["a"]
    assert (row.origin, row.title_en, row.kind) == ("detail", "From page", "article")
    row = one(built(spark, [A], [empty], []))["a"]
    assert (row.origin, row.title_en, row.summary_en, row.kind, row.segments, row.embed_url) == ("none", "From index", "", "none", [], None)


def translated(spark, df, **change):
    zh = F.transform("segments", lambda s: F.struct(s["sid"].alias("sid"), s["speaker_en"].alias("speaker_en"), s["start"].alias("start"), s["text_en"].alias("text_en"), F.concat(F.lit("译"), s["text_en"]).alias("text_zh"), F.when(s["speaker_en"].isNotNull(), "人").alias("speaker_zh")))
    out = df.drop("outcome").withColumns({"segments": zh, "title_zh": F.lit("题"), "summary_zh": F.lit("要"), "status": F.lit("reviewed"), "model": F.lit("m"), "translated_at": F.lit("t"), "reviewed_at": F.lit("r")} | {k: F.lit(v) for k, v in change.items()})
    return spark.createDataFrame(out.collect(), B.RECORD)


def test_unchanged_records_stay_as_they_are(spark):
    old = translated(spark, built(spark, [A], [T], [D]))
    row = one(built(spark, [A], [T], [D], old, snapshot="s2"))["a"]
    assert row.outcome == "unchanged" and row.status == "reviewed" and row.snapshot == "s1" and row.segments[0].text_zh == "译one" and row.segments[0].speaker_zh == "人"


def test_translations_stay_while_their_source_does(spark):
    old = translated(spark, built(spark, [A], [T], [D]))
    changed = (*T[:5], [seg("s1", "one", "Ann"), seg("s2", "TWO"), seg("s3", "three")], "made")
    row = one(built(spark, [A], [changed], [D], old, snapshot="s2"))["a"]
    assert (row.outcome, row.status, row.model, row.reviewed_at, row.title_zh, row.snapshot) == ("written", "pending", "m", None, "题", "s1")
    assert [s.text_zh for s in row.segments] == ["译one", "", ""] and [s.speaker_zh for s in row.segments] == ["人", None, None]
    row = one(built(spark, [A], [(*T[:5], [seg("s1", "one", "Bob"), seg("s2", "two")], "made")], [D], old))["a"]
    assert [s.text_zh for s in row.segments] == ["", "译two"] and row.status == "pending"
    # Another day changes the hash, but nothing that the translation depends on.
    row = one(built(spark, [(A[0], A[1], "2024-02-02", *A[3:])], [T], [D], old))["a"]
    assert (row.outcome, row.status, row.reviewed_at, row.title_zh) == ("written", "reviewed", "r", "题") and [s.text_zh for s in row.segments] == ["译one", "译two"]
    row = one(built(spark, [A], [(T[0], "New title", *T[2:])], [D], old))["a"]
    assert (row.status, row.title_zh, row.summary_zh) == ("pending", "", "要")


def test_missing_and_back_again(spark):
    old = translated(spark, built(spark, [A], [T], [D]))
    b = ("b", "speech", "2024-01-01", "B", "https://x.example/b")
    gone = built(spark, [b], before=old)
    rows = one(gone)
    assert rows["a"].outcome == "missing" and rows["a"].source_missing is True and rows["a"].status == "reviewed" and rows["b"].outcome == "written"
    marked = spark.createDataFrame(gone.drop("outcome").collect(), B.RECORD)
    assert one(built(spark, [b], before=marked))["a"].outcome == "gone"
    back = one(built(spark, [A, b], [T], [D], marked))["a"]
    assert back.outcome == "written" and back.source_missing is False and back.status == "reviewed" and back.segments[1].text_zh == "译two"
    assert one(built(spark, [b], before=old, whole=False))["a"].outcome == "unchanged"


def test_captions_stay_with_the_same_player(spark):
    index = ("a", "speech", "2024-01-01", "t", "https://www.youtube.com/watch?v=abcdefghijk")
    old = translated(spark, built(spark, [index], [("a", None, None, None, "article", [seg("s1", "said")], "https://www.youtube.com/watch?v=abcdefghijk")]))
    assert one(built(spark, [index], before=old))["a"].outcome == "unchanged"
    row = one(built(spark, [(*index[:2], "2024-05-05", *index[3:])], before=old))["a"]
    assert (row.origin, row.kind, row.transcript_source) == ("captions", "article", "https://www.youtube.com/watch?v=abcdefghijk") and row.segments[0].text_zh == "译said"
    other = (*index[:4], "https://www.youtube.com/watch?v=hijklmnopqr")
    assert one(built(spark, [other], before=old))["a"].origin == "none"
    assert one(built(spark, [index], [T], before=old))["a"].origin == "transcript"


def test_empty_tables(spark):
    assert built(spark, []).count() == 0 and one(built(spark, [(None, None, None, None, None)]))[None].outcome == "written"


def payload(t):
    return t[1:]


def test_a_stream_gives_the_result_of_its_batches(spark, tmp_path):
    rows = [
        [(*A, "transcript", 1, payload(T)), ("b", "speech", "2024-01-01", "B", "https://x.example/b", "index", 1, None)],
        [(*A, "detail", 2, payload(D)), (*A, "transcript", 3, payload((*T[:5], [seg("s1", "one", "Ann")], "made"))), (*A, "transcript", 2, payload(T))],
        [("b", "speech", "2024-03-03", "B2", "https://x.example/b", "detail", 4, payload(("b", None, "About b", None, "article", [seg("s1", "text")], None)))],
    ]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, S.ROWS).coalesce(1).write.parquet(f"{tmp_path}/parts/{i}")
    want, published = spark.createDataFrame([], B.RECORD), []
    for n, part in enumerate(rows):
        want = spark.createDataFrame(S.merged(spark.createDataFrame(part, S.ROWS), want, "s1", f"batch {n}").drop("outcome").collect(), B.RECORD)
    plain = lambda df: sorted(map(str, df.select(*B.COLUMNS).collect()))
    store = Store(spark, f"file://{tmp_path}/store")
    source = tmp_path / "source"
    source.mkdir()
    # The second version is published by a run that dies before it has told the stream so: the batch is run again.
    for n in range(3):
        part = next(p for p in (tmp_path / "parts" / str(n)).iterdir() if p.name.startswith("part-"))
        (source / f"{n}.parquet").write_bytes(part.read_bytes())
        if n == 1:
            real = Store.write

            def dying(self, df, **facts):
                real(self, df, **facts)
                raise RuntimeError("died")

            Store.write = dying
            with pytest.raises(Exception, match="died"):
                S.stream_records(spark, str(source), store, f"{tmp_path}/checkpoint", "s1").awaitTermination()
            Store.write = real
        S.stream_records(spark, str(source), store, f"{tmp_path}/checkpoint", "s1").awaitTermination()
        published.append(store.latest())
    assert published == [0, 1, 2] and plain(store.read()) == plain(want)
    assert one(store.read())["a"].segments[0].text_en == "one" and len(one(store.read())["a"].segments) == 1
    S.stream_records(spark, str(source), store, f"{tmp_path}/checkpoint", "s1").awaitTermination()
    assert store.latest() == 2
