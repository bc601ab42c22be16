"""Records built from an index and what was fetched for it, and merged into the snapshot before: content, hash, kept translations, outcomes.

    index        id, type, day, title, source_url                       what there is
    fetched      id, title, summary, embed_url, kind, segments, transcript_source     a transcript or a detail page; segments: array of (sid, speaker_en, start, text_en)
    snapshot     the columns of RECORD; segments hold text_zh and speaker_zh as well

All of it is joins by id and functions of one record's arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import urls
from scriptorium.operators.snapshots import content_hash

SEGMENT = "struct<sid:string,speaker_en:string,start:double,text_en:string,text_zh:string,speaker_zh:string>"
RECORD = f"id string, snapshot string, type string, day string, title_en string, title_zh string, summary_en string, summary_zh string, source_url string, embed_url string, kind string, origin string, transcript_source string, segments array<{SEGMENT}>, status string, model string, translated_at string, reviewed_at string, source_missing boolean, fetched_at string, hash string"
COLUMNS = [x.split(" ")[0] for x in RECORD.split(", ")]
FETCHED = "id string, title string, summary string, embed_url string, kind string, segments array<struct<sid:string,speaker_en:string,start:double,text_en:string>>, transcript_source string"


def has_text(kind: Column, segments: Column) -> Column:
    return F.coalesce((kind != "none") & (F.size(segments) > 0), F.lit(False))


def merged_segments(new: Column, old: Column) -> Column:
    """The new segments with the translations of old ones that have the same id, text and speaker (of several the last)."""
    same = lambda s: F.filter(old, lambda o: (o["sid"] == s["sid"]) & (o["text_en"] == s["text_en"]) & o["speaker_en"].eqNullSafe(s["speaker_en"]))
    pairs = F.transform(new, lambda s: F.struct(s.alias("s"), F.get(F.reverse(same(s)), 0).alias("o")))
    fields = lambda p: [p["s"][f].alias(f) for f in ("sid", "speaker_en", "start", "text_en")]
    return F.transform(pairs, lambda p: F.struct(*fields(p), F.coalesce(p["o"]["text_zh"], F.lit("")).alias("text_zh"), T.present(p["o"]["speaker_zh"]).alias("speaker_zh")))


def bare(segments: Column) -> Column:
    """What a translation depends on."""
    return F.to_json(F.transform(segments, lambda s: F.struct(s["sid"], s["speaker_en"], s["text_en"])))


def build(index: DataFrame, transcripts: DataFrame, details: DataFrame, before: DataFrame, snapshot: str, at: str, whole: bool = True) -> DataFrame:
    """(outcome, and the columns of RECORD): the snapshot after.

    Content comes from the transcript, else the detail page, else from captions that were added to the record before, as long as the record and its player
    are the same. Outcomes: written (new, changed, or back again), unchanged, missing (marked now), gone (marked before). A record keeps its first snapshot, and each
    translation while its source stays; its state stays while all of its sources do, else it is pending with the model kept. An unchanged record
    is left as it is. whole: the index lists all there is, so what it doesn't list is missing; else (a part of it) the rest stays."""
    # Players are read from addresses before the joins, so that each is read once.
    one = lambda df, p, columns, players=(): df.select("id", *[F.col(c).alias(f"{p}{c}") for c in columns], *[urls.player_id(F.col(c)).alias(f"{p}{c}_player") for c in players])
    fetched = [x.split(" ")[0] for x in FETCHED.split(", ")][1:]
    listed_rows = index.select("id", "type", "day", "title", "source_url", urls.player_id(F.col("source_url")).alias("i_player"), F.lit(True).alias("_in"))
    rows = listed_rows.join(one(transcripts, "t_", fetched, ["embed_url"]), "id", "left").join(one(details, "d_", fetched, ["embed_url"]), "id", "left")
    both = rows.join(one(before, "o_", COLUMNS[1:], ["transcript_source", "source_url", "embed_url"]).withColumn("_known", F.lit(True)), "id", "full_outer")
    c = F.col
    player = F.when(T.present(c("t_embed_url")).isNotNull(), c("t_embed_url_player")).otherwise(c("d_embed_url_player"))
    both = both.withColumn("_player", F.coalesce(player, c("i_player")))
    captions, old_player, new_player = c("o_transcript_source_player"), c("o_source_url_player"), c("i_player")
    same_source = F.coalesce(F.when(old_player.isNotNull() & new_player.isNotNull(), old_player == new_player).otherwise(c("o_source_url") == c("source_url")), F.lit(False))
    reuse = same_source & F.coalesce((captions == F.coalesce(c("o_embed_url_player"), old_player)) & (captions == c("_player")), F.lit(False)) & has_text(c("o_kind"), c("o_segments"))
    origin = F.when(has_text(c("t_kind"), c("t_segments")), "transcript").when(has_text(c("d_kind"), c("d_segments")), "detail").when(reuse, "captions").otherwise("none")
    both = both.withColumn("origin", F.when(c("_in"), origin).otherwise(c("o_origin")))
    of = lambda t, d, o, none: F.when(c("origin") == "transcript", t).when(c("origin") == "detail", d).when(c("origin") == "captions", o).otherwise(none)
    shape = lambda x: F.transform(x, lambda s: F.struct(*[s[f].alias(f) for f in ("sid", "speaker_en", "start", "text_en")]))
    none = F.lit(None).cast("array<struct<sid:string,speaker_en:string,start:double,text_en:string>>")
    new = {
        "type": c("type"), "day": c("day"), "title_en": F.coalesce(T.present(c("t_title")), T.present(c("d_title")), c("title")), "summary_en": F.coalesce(T.present(c("t_summary")), T.present(c("d_summary")), F.lit("")),
        "source_url": c("source_url"), "embed_url": F.when(c("_player").isNotNull(), F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), "_player")), "kind": of(c("t_kind"), c("d_kind"), c("o_kind"), F.lit("none")),
        "segments": F.coalesce(of(shape(c("t_segments")), shape(c("d_segments")), shape(c("o_segments")), none), F.array().cast("array<struct<sid:string,speaker_en:string,start:double,text_en:string>>")),
        "transcript_source": F.when(c("origin") == "captions", c("o_transcript_source")).otherwise(F.coalesce("t_transcript_source", "d_transcript_source")),
    }
    both = both.select("id", "_in", "_known", "origin", *[c(f"o_{x}") for x in COLUMNS[1:]], *[v.alias(f"n_{k}") for k, v in new.items()])
    both = both.withColumn("n_hash", content_hash({"id": c("id")} | {k: c(f"n_{k}") for k in new}))
    known, listed, marked = F.coalesce("_known", F.lit(False)), F.coalesce("_in", F.lit(False)), F.coalesce("o_source_missing", F.lit(False))
    outcome = F.when(~listed & marked, "gone").when(~listed & F.lit(whole), "missing").when(~listed, "unchanged").when(known & (c("n_hash") == c("o_hash")) & ~marked, "unchanged").otherwise("written")
    both = both.withColumn("outcome", outcome)
    kept = {x: F.coalesce(c(f"n_{x}_en") == c(f"o_{x}_en"), F.lit(False)) for x in ("title", "summary")}
    zh = {x: F.when(kept[x], F.coalesce(f"o_{x}_zh", F.lit(""))).otherwise("") for x in kept}
    same = known & kept["title"] & kept["summary"] & F.coalesce(bare(c("n_segments")) == bare(c("o_segments")), F.lit(False))
    stay = lambda x: F.when(same, c(f"o_{x}"))
    written = {
        "snapshot": F.coalesce(T.present(c("o_snapshot")), F.lit(snapshot)), "title_zh": zh["title"], "summary_zh": zh["summary"], "segments": merged_segments(c("n_segments"), F.coalesce("o_segments", F.array().cast(f"array<{SEGMENT}>"))),
        "status": F.coalesce(stay("status"), F.lit("pending")), "model": c("o_model"), "translated_at": stay("translated_at"), "reviewed_at": stay("reviewed_at"), "source_missing": F.lit(False), "fetched_at": F.lit(at), "hash": c("n_hash"), "origin": c("origin"),
    }
    value = lambda x: written.get(x, c(f"n_{x}") if x in new else None)
    old = lambda x: F.when(c("outcome") == "missing", F.lit(True)).otherwise(c("o_source_missing")) if x == "source_missing" else c(f"o_{x}")
    return both.select("outcome", "id", *[F.when(c("outcome") == "written", value(x)).otherwise(old(x)).alias(x) for x in COLUMNS[1:]])
