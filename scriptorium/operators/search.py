"""Full-text matching: an inverted index with positions, substring search, anchors and unique titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What stands between words: all but a to z, or all but letters, marks and digits of any script.
NOT_LATIN, NOT_WORD = "[^a-z]+", r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column, between: str = NOT_LATIN) -> Column:
    return F.filter(F.split(F.lower(text), between), lambda w: w != "")


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, position): the inverted index."""
    return docs.select(key, F.posexplode(words(F.col(text))).alias("position", "token")).select("token", key, "position")


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, documents): in how many documents each word of any language is; one shuffle, of partial counts."""
    tokens = docs.select(F.explode(F.array_distinct(words(F.col(text), NOT_WORD))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


#: Queries that are broadcast at once.
BLOCK = 2_000


def rarest_hits(docs: DataFrame, asked: DataFrame, key: str, query_key: str, text: str, between: str = NOT_WORD) -> DataFrame:
    """(query, key): the documents that hold all words of a query. Keys are unique; a query without words finds nothing.

    A query meets only the documents that hold its rarest word, so a common word makes no rows; the others are then verified in the document's word set, in
    the same row. The queries are a stated set: they are broadcast in blocks of about BLOCK, one pass over the documents a block, and no text or word set is
    shuffled."""
    terms = asked.select(query_key, F.array_distinct(words(F.col(text), between)).alias("terms")).where(F.size("terms") > 0)
    each = terms.select(query_key, F.explode("terms").alias("token"))
    held = docs.select(key, F.array_distinct(words(F.col(text), between)).alias("held"))
    counts = held.select(F.explode("held").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # A word that no document holds is the rarest, and finds nothing.
    rarest = each.join(counts, "token", "left").groupBy(query_key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    sought = rarest.join(terms, query_key)
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = sought.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b) if blocks > 1 else sought
        tokens = part.agg(F.collect_set("token").alias("_tokens"))
        met = held.join(F.broadcast(tokens)).select(key, "held", F.array_intersect("_tokens", "held").alias("_met")).where(F.size("_met") > 0)
        found = met.select(key, "held", F.explode("_met").alias("token")).join(F.broadcast(part), "token")
        hits = found.where(F.size(F.array_except("terms", "held")) == 0).select(query_key, key)
        out = hits if out is None else out.unionAll(hits)
    return out


def substring_hits(docs: DataFrame, asked: DataFrame, key: str, query_key: str, haystack: Column) -> DataFrame:
    """(key, query): documents that contain every term of a query as a substring.

    The queries are a stated set: each document filters them as an array, in blocks of about BLOCK, one pass a block, so that no pair is made that
    isn't a hit and the broadcast is bounded."""
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b) if blocks > 1 else asked
        queries = part.agg(F.collect_list(F.struct(query_key, "terms")).alias("_queries"))
        rows = docs.select(key, haystack.alias("_hay")).join(F.broadcast(queries))
        hits = F.filter("_queries", lambda q: F.forall(q["terms"], lambda t: F.contains(F.col("_hay"), t)))
        found = rows.select(key, F.explode(hits).alias("q")).select(key, F.col(f"q.{query_key}").alias(query_key))
        out = found if out is None else out.unionAll(found)
    return out


#: Words of an excerpt, and results of a page.
EXCERPT, PAGE = 30, 20


def positions(segments: DataFrame, doc: str, segment: str, text: str) -> DataFrame:
    """(token, doc, segment, at): where each word stands in its segment, as an array of places; one row a word and segment."""
    rows = segments.select(doc, segment, F.posexplode(words(F.col(text), NOT_WORD)).alias("_at", "token"))
    return rows.groupBy("token", doc, segment).agg(F.array_sort(F.collect_list("_at")).alias("at"))


def covering(found: Column, terms: Column) -> Column:
    """The length in words of the smallest stretch that holds all terms, null if there is none.

    found: array of (at, token) by place. One pass: the last place of each term so far is kept, and a stretch that ends here begins at the least of them."""
    start = F.struct(F.lit(None).cast("int").alias("best"), F.transform(terms, lambda t: F.lit(None).cast("int")).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(terms, lambda t, i: F.when(t == x["token"], x["at"]).otherwise(F.get(acc["last"], i)))
        whole = F.forall(last, lambda p: p.isNotNull())
        return F.struct(F.when(whole, F.least(acc["best"], x["at"] - F.array_min(last) + 1)).otherwise(acc["best"]).alias("best"), last.alias("last"))

    return F.aggregate(found, start, step)["best"]


def ranked_hits(segments: DataFrame, asked: DataFrame, doc: str, segment: str, query: str, text: str, page: int = PAGE, excerpt: int = EXCERPT) -> DataFrame:
    """(query, rank, doc, score, anchor, span): the best documents that hold all words of a query, each with the segment to open.

    Ranking. score = sum over the words of w * ((22000 tf) div (10 tf + 3 + (9 n N) div L)), with w = floor(1000 ln((2 N + 2) / (2 df + 1))) and n words in the
    document, N documents, L words in all: collection statistics over all documents, in whole numbers. Equal scores go by the document's key.
    Anchor. The first segment, in order, with an excerpt (a stretch of at most ``excerpt`` words) that holds all words; else the first
    with any of them. span is the smallest such stretch of the anchor's segment, null if it has none.

    A query meets only the documents of its rarest word; the other words are then looked up in these documents by equi-joins, so that a common
    word makes no rows of its own. Arrays hold one segment's places."""
    postings = positions(segments, doc, segment, text)
    sets = asked.select(query, F.array_sort(F.array_distinct(words(F.col(text), NOT_WORD))).alias("terms")).where(F.size("terms") > 0)
    # Queries of the same words have the same answers: one of them is asked.
    terms = sets.groupBy("terms").agg(F.min(query).alias(query))
    same = terms.select("terms", F.col(query).alias("_one")).join(sets, "terms").select("_one", query)
    each = terms.select(query, F.size("terms").alias("_n"), F.explode("terms").alias("token"))
    held = postings.join(each.select("token").distinct(), "token", "left_semi")
    by_doc = held.groupBy("token", doc).agg(F.sum(F.size("at")).alias("tf"), F.min(segment).alias("_seg"))
    frequency = by_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    lengths = segments.groupBy(doc).agg(F.sum(F.size(words(F.col(text), NOT_WORD))).alias("_len")).where("_len > 0")
    size = lengths.agg(F.count(F.lit(1)).alias("_docs"), F.sum("_len").alias("_words"))  # one row
    known = each.join(frequency, "token", "left")
    rarest = known.groupBy(query).agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "token"))["token"].alias("token"))
    candidates = rarest.join(by_doc.select("token", doc), "token").select(query, doc)
    met = candidates.join(known, query).join(by_doc.select("token", doc, "tf"), ["token", doc])
    weight = F.floor(1000 * F.log((2.0 * F.col("_docs") + 2) / (2 * F.col("df") + 1)))
    share = 10 * F.col("tf") + 3 + F.floor(9 * F.col("_len") * F.col("_docs") / F.col("_words")).cast("long")
    impact = F.floor(F.lit(22000) * F.col("tf") / share).cast("long")
    scored = met.join(lengths, doc).join(F.broadcast(size)).groupBy(query, doc).agg(F.sum(weight * impact).alias("score"), F.count(F.lit(1)).alias("_found"), F.max("_n").alias("_n")).where("_found = _n")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc).asc()))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= page).select(query, doc, "score", "rank")
    hits = best.select(query, doc).join(each.select(query, "token"), query).join(held, ["token", doc])
    places = F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("at"), F.col("token").alias("token"))))))
    subs = hits.groupBy(query, doc, segment).agg(places.alias("_found")).join(terms, query).withColumn("span", covering(F.col("_found"), F.col("terms")))
    anchors = subs.groupBy(query, doc).agg(F.min(F.when(F.col("span") <= excerpt, F.struct(segment, "span"))).alias("_a"), F.min(F.struct(segment, "span")).alias("_b"))
    pick = F.coalesce("_a", "_b")
    answers = best.join(anchors, [query, doc]).select(F.col(query).alias("_one"), F.col("rank").cast("int").alias("rank"), doc, "score", pick[segment].alias("anchor"), pick["span"].cast("int").alias("span"))
    return same.join(answers, "_one").drop("_one")


def first_anchors(docs: DataFrame, key: str, text: str, needle: str, most: int, before: int = 30, size: int = 120) -> DataFrame:
    """(key, anchor, excerpt) of the first lines, in order, that hold the needle."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.contains(F.lower("line"), F.lit(needle)))
    at = F.greatest(F.lit(1), F.instr(F.lower("line"), F.lit(needle)) - before)
    return lines.orderBy(key, "n").limit(most).select(key, (F.col("n") + 1).alias("anchor"), F.substring(F.col("line"), at, F.lit(size)).alias("excerpt"))


def unique_titles(df: DataFrame, key: str, base: str, more: str) -> DataFrame:
    """Titles that are unique: a second field is added on a collision, the key if they still collide.

    Collisions are counted by aggregation and joined back, so that a common title is only a hot join key, which can be split."""
    counted = lambda rows, c: rows.groupBy(c).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(c, F.lit(True).alias(f"_{c}"))
    rows = df.join(counted(df, base), base, "left")
    candidate = F.when(F.col(f"_{base}").isNull(), F.col(base)).otherwise(F.concat(F.col(base), F.lit(" ("), F.col(more), F.lit(")")))
    rows = rows.withColumn("candidate", candidate)
    rows = rows.join(counted(rows, "candidate"), "candidate", "left")
    title = F.when(F.col(f"_{base}").isNull() | F.col("_candidate").isNull(), F.col("candidate")).otherwise(F.concat("candidate", F.lit("["), F.col(key).cast("string"), F.lit("]")))
    return rows.select(key, title.alias("title"))
