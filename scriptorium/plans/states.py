"""Queries of validation, work states and the catalogue's orders over whole records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import audit as A
from scriptorium.operators import states as S
from scriptorium.operators import validate as V
from scriptorium.sources.entities import AUDIT_WITH, WITH, audited, records, segments
from scriptorium.sources.tables import table

QUERIES, SQL = {}, {}
SITE, COUNT = "archive.example", 271
HASH = "CASE WHEN n % 33 = 9 THEN '' WHEN n % 10 = 3 THEN 'x' ELSE md5(title_en || summary_en) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def issue(field: str, message: str, test: str, severity: str = "error", rows: str = "r") -> str:
    return f"SELECT '{severity}' AS severity, id, '{field}' AS field, '{message}' AS message FROM {rows} WHERE {test}"


WEB = r"regexp_matches({0}, '^https?://[^\s/?#]+')"
RULES = [
    *[issue(c, "required", f"trim({c}) = ''") for c in ("id", "slug", "snapshot", "title_en", "hash")],
    issue("type", "unknown type", "type = 'other'"), issue("kind", "unknown content", "kind = 'poem'"), issue("day", "invalid date", "try_cast(day AS DATE) IS NULL"), issue("fetched_at", "not a time stamp", "fetched_at = 'yesterday'"),
    *[issue(c, "not a web address", "NOT " + WEB.format(c)) for c in ("source_url", "archive_url", "embed_url", "thumbnail_url")],
    issue("archive_url", "not of the archive", f"NOT starts_with(archive_url, 'https://{SITE}/items/')"), issue("embed_url", "not the private player", "embed_url LIKE 'https://www.youtube.com/%'"), issue("duration", "negative", "duration < 0"),
    issue("segments", "a text without a kind", "kind = 'none' AND parts IS NOT NULL"), issue("segments", "translation too short", "parts >= 1000 AND zh_parts < 0.08 * parts"), issue("title_zh", "missing translation", "trim(title_zh) = ''"),
    issue("status", "not reviewed", "status <> 'reviewed'"), issue("reviewed_at", "reviewed without a stamp", "status = 'reviewed' AND reviewed_at = ''"), issue("source_missing", "gone from the source", "source_missing", "warning"),
    issue("slug", "duplicate", "slug IN (SELECT slug FROM r GROUP BY slug HAVING count(*) > 1) AND id <> (SELECT min(id) FROM r q WHERE q.slug = r.slug)"), issue("snapshot", "another snapshot", "snapshot <> '2024-02-02'"), issue("hash", "another source", "hash <> md5(title_en || summary_en)"),
    f"SELECT 'error', NULL, 'records', 'expected {COUNT}, found ' || count(*) FROM r HAVING count(*) <> {COUNT}",
    "SELECT 'error', 'c-' || lpad(CAST(doc_id AS VARCHAR), 6, '0'), 'id', 'missing required baseline record' FROM labels WHERE 'c-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') NOT IN (SELECT id FROM r)",
]


@query(f"WITH {WITH}, l AS (SELECT n, sum(length(trim(text_en))) AS parts, sum(length(trim(text_zh))) AS zh_parts FROM segs GROUP BY n), r AS (SELECT *, {HASH} AS hash FROM records JOIN l USING (n)) " + " UNION ALL ".join(RULES))
def record_issues(spark, sf_dir):
    texts = segments(spark, sf_dir).groupBy("n").agg(F.sum(F.length(F.trim("text_en"))).alias("parts"), F.sum(F.length(F.trim("text_zh"))).alias("zh_parts"), F.collect_list(F.struct("sid")).alias("segments"))
    df = records(spark, sf_dir).join(texts, "n", "left").withColumn("hash", F.expr(HASH))
    wanted = table(spark, sf_dir, "labels").select(F.concat(F.lit("c-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("id"))
    sets = [S.repeats(df, "id", "id"), S.repeats(df, "id", "slug"), S.differs(df, "id", "snapshot", F.lit("2024-02-02"), "another snapshot"), S.differs(df, "id", "hash", F.md5(F.concat("title_en", "summary_en")), "another source"), S.wrong_count(df, COUNT), V.absent(wanted, df, "id")]
    out = V.issues(df, "id", S.record_rules(SITE))
    for part in sets:
        out = out.unionByName(part)
    return out


LETTERS = r"len(list_filter(regexp_split_to_array(regexp_replace(text_en, 'https?://\S+', ' ', 'g'), '[^A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Za-z]*[a-z][A-Za-z]*') AND length(w) >= 2)) >= 2"
WORDS = "len(regexp_extract_all(text_en, '[A-Za-z]+(?:''[A-Za-z]+)?'))"
SEGMENT_RULES = [
    ("sid", "duplicate", "times > 1"), ("text_en", "missing source text", "trim(text_en) = ''"), ("text_zh", "missing translation", "text_zh = ''"), ("text_zh", "no Chinese characters", f"starts_with(text_zh, 'only') AND {LETTERS}"),
    ("text_zh", "implausibly short", f"text_zh <> '' AND length(trim(text_zh)) < CASE WHEN length(text_en) >= 80 THEN ceil(length(text_en) * 0.08) WHEN length(text_en) >= 40 AND {WORDS} >= 6 THEN 3 WHEN length(text_en) >= 24 AND {WORDS} >= 5 THEN 2 ELSE 0 END"),
    ("text_zh", "repeats the one before", "trim(text_zh) = trim(prev) AND length(trim(text_zh)) >= 30"), ("speaker_zh", "missing", "speaker_zh = '' AND speaker_en <> ''"), ("start", "negative", "start < 0"), ("start", "decreasing", "start >= 0 AND start < before"),
]


@query(f"""
WITH {WITH}, r AS (SELECT *, n || '/' || turn AS id, count(*) OVER (PARTITION BY n, sid) AS times, lag(text_zh) OVER (PARTITION BY n ORDER BY turn) AS prev,
  coalesce(last_value(CASE WHEN start >= 0 THEN start END IGNORE NULLS) OVER (PARTITION BY n ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM segs) """ + " UNION ALL ".join(issue(*x) for x in SEGMENT_RULES))
def segment_issues(spark, sf_dir):
    rows = S.beside(segments(spark, sf_dir), "n", "turn").withColumn("id", F.concat_ws("/", "n", "turn"))
    return V.issues(rows, "id", S.segment_rules())


UNITS = """u AS (SELECT 'd-' || d.doc_id AS id, d.doc_id % 7 = 2 AS bad_numbers, d.doc_id % 5 = 1 AS settled, l.doc_id IS NOT NULL AS stored, d.text <> '' AS complete, md5(d.text) AS hash, CASE WHEN l.quality = 1 THEN md5(d.text) WHEN l.quality = 0 THEN 'x' END AS reviewed_hash,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'y' WHEN l.quality = 0 THEN 'z' ELSE md5(d.text || d.source) END AS old_hash, md5(d.text || d.source) AS full_hash, CASE WHEN l.toxic = 1 THEN md5(d.text) ELSE 'w' END AS old_text_hash FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""
WITH {UNITS} SELECT id, CASE WHEN bad_numbers THEN true WHEN settled THEN false ELSE NOT stored END AS resumed, CASE WHEN bad_numbers THEN true WHEN settled THEN false ELSE NOT complete END AS afresh, bad_numbers OR reviewed_hash IS DISTINCT FROM hash AS review,
  CASE WHEN old_hash IS NULL THEN 'new' WHEN old_hash = full_hash THEN 'skipped' WHEN old_text_hash = hash THEN 'skipped, stamped anew' ELSE 'changed' END AS change FROM u""")
def work_states(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    d, own, full = F.col("doc_id"), F.md5("text"), F.md5(F.concat("text", "source"))
    rows = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d-"), d.cast("string")).alias("id"), (d % 7 == 2).alias("bad_numbers"), (d % 5 == 1).alias("settled"), F.col("known").isNotNull().alias("stored"), (F.col("text") != "").alias("complete"), own.alias("text_hash"), full.alias("hash"),
        F.when(F.col("quality") == 1, own).when(F.col("quality") == 0, F.lit("x")).alias("reviewed_hash"), F.when(F.col("known").isNull(), None).when(F.col("toxic") == 1, "y").when(F.col("quality") == 0, "z").otherwise(full).alias("old_hash"), F.when(F.col("toxic") == 1, own).otherwise("w").alias("old_text_hash"),
    )
    review = S.pending_review(rows.withColumn("hash", F.col("text_hash")))
    return rows.withColumn("change", S.change_of(rows)).withColumn("hash", F.col("text_hash")).select("id", S.pending(rows).alias("resumed"), S.pending(rows, resume=False).alias("afresh"), review.alias("review"), "change")


@query(f"""
WITH {WITH}, b AS (SELECT n, bool_and(trim(text_zh) <> '' AND (speaker_en = '' OR speaker_zh <> '' OR turn % 3 = 0 AND n % 2 = 0)) AS draft FROM segs GROUP BY n)
SELECT id, draft, status = 'translated' OR status = 'failed' AND draft AS reviewable FROM records JOIN b USING (n)""")
def reviewable_records(spark, sf_dir):
    speaker = F.when((F.col("turn") % 3 == 0) & (F.col("n") % 2 == 0), "讲者").otherwise(F.col("speaker_zh"))
    drafts = segments(spark, sf_dir).groupBy("n").agg(S.complete_draft(F.col("text_zh"), F.col("speaker_en"), speaker).alias("draft"))
    return records(spark, sf_dir).join(drafts, "n").select("id", "draft", S.reviewable(F.col("status"), F.col("draft")).alias("reviewable"))


@query(f"""
WITH {WITH}, m AS (SELECT s.n, r.status AS old, bool_and(CASE WHEN turn % 4 = 1 AND n % 8 = 1 THEN true ELSE trim(text_zh) <> '' END) AS ok, count(*) FILTER (turn % 4 = 1 AND n % 8 = 1) AS fixes FROM segs s JOIN records r USING (n) GROUP BY s.n, r.status)
SELECT n, CASE WHEN old <> 'translated' THEN old WHEN ok THEN 'reviewed' ELSE 'failed' END AS status, CASE WHEN old = 'translated' AND ok THEN fixes ELSE 0 END AS fixed FROM m""")
def review_outcomes(spark, sf_dir):
    units = segments(spark, sf_dir).join(records(spark, sf_dir).select("n", "status"), "n").select("n", "turn", "status", F.col("text_en").alias("source"), F.col("text_zh").alias("draft"))
    fixes = units.where("turn % 4 = 1 and n % 8 = 1").select("n", "turn", F.concat(F.lit("改："), "source").alias("text"))
    return S.reviewed(units, fixes, "n", "turn", lambda source, text: F.trim(text) != "")


@query(f"WITH {WITH} SELECT CAST(row_number() OVER (ORDER BY day, slug, id) AS INT) AS position, 'oldest' AS listing, id FROM records QUALIFY position <= 24 UNION ALL SELECT CAST(row_number() OVER (ORDER BY day DESC, n) AS INT) AS position, 'home', id FROM records QUALIFY position <= 24")
def catalogue_orders(spark, sf_dir):
    """The first pages of the home list (newest first, ties in load order) and of the catalogue's oldest first: two top-k."""
    from scriptorium.operators.ingest import in_source_order

    df = records(spark, sf_dir)
    pages = [in_source_order(df, order, 24).select(F.col("place").alias("position"), F.lit(name).alias("listing"), "id") for name, order in (("oldest", [F.col("day").asc(), F.col("slug").asc(), F.col("id").asc()]), ("home", [F.col("day").desc(), F.col("n").asc()]))]
    return pages[0].unionByName(pages[1])


@query(f"WITH {WITH} SELECT string_agg(org, ',' ORDER BY regexp_matches(org, '^[ -~]'), org) AS orgs FROM (SELECT DISTINCT org FROM records WHERE org <> '')")
def organisations(spark, sf_dir):
    """Distinct names in the order of a Chinese collation; a facet's values are few."""
    names = records(spark, sf_dir).where("org <> ''").select("org").distinct()
    ordered = names.agg(F.collect_list("org").alias("o")).select(F.array_sort(F.transform("o", lambda x: F.collate(x, "zh"))).alias("o"))
    return ordered.select(F.array_join(F.transform("o", lambda x: F.collate(x, "UTF8_BINARY")), ",").alias("orgs"))


@query(f"WITH {WITH} SELECT type, count(*) AS n FROM records WHERE type <> 'other' GROUP BY type")
def filled_categories(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in S.TYPES], "type string")
    return records(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "type")  # five kinds


@query(r"""
SELECT conv_id, CAST(sum(length(trim(text))) AS BIGINT) AS size, CAST(sum(len(regexp_extract_all(lower(text), 'no ')) + len(regexp_extract_all(lower(text), 'the ')) + len(regexp_extract_all(lower(text), 'an?,'))) AS BIGINT) AS evidence FROM conversations GROUP BY conv_id""")
def body_evidence(spark, sf_dir):
    """Lengths of texts, and how often a few patterns occur in them, by record."""
    hits = S.evidence(F.lower("text"), [r"no ", r"the ", r"an?,"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length(F.trim("text"))).alias("size"), F.sum(hits).alias("evidence"))


@query(r"""
SELECT event_id, CASE WHEN event_type IN (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0) AND event_id % 3 > 0 THEN event_type ELSE 'all' END AS type, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN greatest(1, event_id) WHEN 2 THEN 1 ELSE 7 END AS INT) AS page, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y') ELSE '未知' END AS year FROM events""")
def sanitised_parameters(spark, sf_dir):
    rows, n = table(spark, sf_dir, "events"), F.col("event_id")
    known = rows.where(n % 2 == 0).select("event_type").distinct()
    asked = F.when(n % 3 > 0, F.col("event_type")).otherwise("drop table")
    page = F.when(n % 4 == 0, "x9").when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, "-3").otherwise(" 7abc")
    rows = S.with_parameter(rows, "type", asked, known, "all")
    return rows.select("event_id", "type", S.page_number(page).alias("page"), S.year_of(F.when(n % 2 == 0, F.date_format("ts", "yyyy-MM")).otherwise("soon")).alias("year"))


@query("SELECT doc_id, md5(trim(text, E' \\n\\t\\r')) AS text FROM documents")
def markdown_inverse(spark, sf_dir):
    """Escaped Markdown read back: the trimmed text again."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.unescaped_markdown(F.replace(T.escape_markdown(F.replace("text", F.lit("\\"), F.lit("\x01"))), F.lit("\x01"), F.lit("\\\\")))).alias("text"))


#: The audit's rules for SQL: given(x) holds for non-blank values.
def _given(c: str) -> str:
    return f"coalesce(trim({c}), '') <> ''"


_WEB = lambda c: r"coalesce(regexp_matches({0}, '^https?://[^\s/?#]+'), false)".format(c)
_STAMP = r"coalesce(regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?Z$'), false)"
AUDIT_RULES = [
    *[issue(c, "required", f"NOT {_given(c)}") for c in ("id", "slug", "snapshot", "title_en", "hash")],
    issue("type", "unknown type", "coalesce(type, '') <> 'speech'"), issue("kind", "unknown content", "coalesce(kind, 'poem') = 'poem'"), issue("day", "invalid date", "coalesce(day, '') <> '2023-02-03'"), issue("fetched_at", "not a time stamp", "NOT " + _STAMP.format("fetched_at")),
    *[issue(c, "not a web address", f"NOT {_WEB(c)}") for c in ("source_url", "archive_url")], *[issue(c, "not a web address", f"{c} IS NOT NULL AND NOT {_WEB(c)}") for c in ("embed_url", "thumbnail_url")],
    issue("archive_url", "not this record of the archive", _WEB("archive_url") + " AND coalesce(regexp_replace(archive_url, '/$', '') <> 'https://archive.example/items/' || replace(id, ' ', '%20'), true)"),
    issue("embed_url", "not the private player", "embed_url LIKE 'https://www.youtube.com/%'"), issue("duration", "negative", "duration < 0"), issue("segments", "no list", "has_segments IS NULL"),
    issue("segments", "a text without a kind", "coalesce(kind = 'none', false) AND coalesce(has_segments, false)"), issue("segments", "a kind without a text", "NOT coalesce(kind = 'none', false) AND has_segments = false"),
    issue("status", "missing state", "status IS NULL"), issue("status", "unknown state", "status = 'lost'"), issue("status", "not reviewed", "status IN ('lost', 'translated')"),
    issue("reviewed_at", "reviewed without a stamp", "status = 'reviewed' AND NOT " + _STAMP.format("reviewed_at")), issue("model", "reviewed without a model", f"status = 'reviewed' AND NOT {_given('model')}"), issue("source_missing", "gone from the source", "source_missing", "warning"),
    *[issue(c, "duplicate", f"{_given(c)} AND row_number() OVER (PARTITION BY {c} ORDER BY place) > 1").replace(" WHERE ", " QUALIFY ") for c in ("id", "slug")],
    issue("snapshot", "another snapshot", "snapshot IS DISTINCT FROM 's1'"), issue("hash", "another source", "hash IS DISTINCT FROM 'h1'"),
    f"SELECT 'error', NULL, 'records', 'expected {COUNT}, found ' || count(*) FROM r HAVING count(*) <> {COUNT}",
    "SELECT 'error', 'r-' || doc_id, 'id', 'missing required baseline record' FROM (SELECT DISTINCT doc_id FROM labels) WHERE 'r-' || doc_id NOT IN (SELECT id FROM r WHERE id IS NOT NULL)",
    issue("segments", "translation too short", "source >= 1000 AND target < 0.08 * source", rows="bodies"),
    *[f"SELECT 'error' AS severity, id, 'segments[' || turn || '].{f}' AS field, '{m}' AS message FROM b WHERE {test}" for f, m, test in (
        ("sid", "missing", f"NOT {_given('sid')}"), ("sid", "duplicate", f"{_given('sid')} AND nth > 1"), ("text_en", "missing source text", "en = ''"),
        ("text_zh", "repeats the one before for another source", "length(zh) >= 30 AND zh = last_zh AND en <> last_en"), ("start", "negative", "start < 0"), ("start", "decreasing", "start >= 0 AND start < before"))],
    *[f"SELECT '{severity}' AS severity, id, field, '{m}' AS message FROM t WHERE {test}" for severity, m, test in (
        ("error", "missing translation", "zh = ''"), ("error", "no Chinese characters", "zh <> '' AND plain AND han = 0 AND NOT kept AND NOT spoken"), ("error", "implausibly short", "zh <> '' AND length(zh) < least"),
        ("error", "too much English left", "zh <> '' AND words > 4 AND letters > 12 AND letters > 1.5 * han"), ("error", "numbers changed", "zh <> '' AND (changed OR spoken)"), ("warning", "numbers to review", "unsure"))],
]
#: The fixture's texts are few, so SQL names what the rules see in them: plain words, the shortest translation, English words and letters that are left, numbers.
AUDIT_SQL = f"""
WITH {AUDIT_WITH},
b AS (SELECT s.*, r.id, trim(coalesce(text_en, '')) AS en, trim(coalesce(text_zh, '')) AS zh, lag(trim(coalesce(text_en, ''))) OVER w AS last_en, lag(trim(coalesce(text_zh, ''))) OVER w AS last_zh, row_number() OVER (PARTITION BY s.place, sid ORDER BY turn) AS nth,
  coalesce(last_value(CASE WHEN start >= 0 THEN start END IGNORE NULLS) OVER (PARTITION BY s.place ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM s JOIN r USING (place) WINDOW w AS (PARTITION BY s.place ORDER BY turn)),
bodies AS (SELECT id, sum(length(en)) AS source, sum(length(zh)) AS target FROM b GROUP BY place, id),
x AS (
  SELECT id, 'title_zh' AS field, title_en AS source, title_zh AS target FROM r UNION ALL SELECT id, 'summary_zh', summary_en, summary_zh FROM r
  UNION ALL SELECT id, 'segments[' || turn || '].text_zh', text_en, text_zh FROM b UNION ALL SELECT id, 'segments[' || turn || '].speaker_zh', speaker_en, speaker_zh FROM b),
t AS (SELECT id, field, trim(coalesce(target, '')) AS zh, starts_with(source, 'The river') OR starts_with(source, 'Boats') OR starts_with(source, 'Seven') OR starts_with(source, 'A talk') OR starts_with(source, 'It cost') OR starts_with(source, 'Ada') OR starts_with(source, 'ADA') OR starts_with(source, 'Twenty') OR starts_with(source, 'The Falcon') AS plain,
  starts_with(source, 'Ada') AND target = 'Ada Lovelace' AS kept, source = 'Twenty and a half' AS spoken, length(regexp_replace(target, '[^一-龥]', '', 'g')) AS han,
  CASE WHEN length(source) >= 80 THEN ceil(length(source) * 0.08) WHEN length(source) >= 40 THEN 3 WHEN length(source) >= 24 AND (starts_with(source, 'Boats') OR starts_with(source, 'The Falcon') OR starts_with(source, 'See')) THEN 2 ELSE 0 END AS least,
  CASE WHEN starts_with(target, 'the boats') THEN 8 WHEN starts_with(target, 'Falcon') THEN CASE WHEN starts_with(source, 'The Falcon') THEN 6 ELSE 7 END ELSE 0 END AS words,
  CASE WHEN starts_with(target, 'the boats') THEN 28 WHEN starts_with(target, 'Falcon') THEN CASE WHEN starts_with(source, 'The Falcon') THEN 18 ELSE 22 END ELSE 0 END AS letters,
  starts_with(source, 'It cost') AND target = '价格是13美元' AS changed, false AS unsure FROM x WHERE {_given('source')})
""" + " UNION ALL ".join(AUDIT_RULES)


@query(AUDIT_SQL)
def audit_issues(spark, sf_dir):
    """The whole audit over records and segments that break each of its rules."""
    df, rows = audited(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").select(F.concat(F.lit("r-"), "doc_id").alias("id"))
    return A.audit(df, rows, SITE, source_hash=F.lit("h1"), snapshot="s1", expected=COUNT, baseline=wanted)
