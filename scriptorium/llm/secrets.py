"""Multipart credential linking over whole texts, in DataFrame functions only.

Base kinds (always reported):
  assign  a named secret with a value of 6 or more characters
  access  an access identifier of 20 or more characters
  hex     a run of 24 or more lower-case hexadecimal digits
Weak kinds are candidates; a weak candidate is a finding only if complementary parts start within
``SCOPE`` characters of it in the same text:
  id        a named account/client identifier   needs a secret part (assign, hex or key)
  key       32+ characters with a letter and a digit, outside base spans
                                                needs an identifier part (access or id)
  endpoint  an http(s) address                  needs an identifier part and a secret part

:func:`redact` links more: it measures the gap between the spans, so that a long part doesn't hide the one beside it, and takes
identifier names in either case. :func:`find_secrets` reports both: ``spans`` by the distance of the starts and with lower-case identifier
names, ``linked_spans`` as they are masked.

Every text is the scope boundary, so the interval join runs inside the row: all parts of a text stand in one array in text order, and
two cumulative passes (:func:`around`) give each part the nearest secret and identifier before and after it. The passes go by chunks
(:func:`scanned`), so that n parts cost n * sqrt(n) copies, not n * n. Nothing is shuffled, and a hot source or group of copies has no effect.

Results for odd rows: a null or empty text has no spans; ties in start are ordered by kind in the
order above; repeated rows give repeated results; an empty table gives an empty result; other columns
pass through untouched in :func:`redact` and are dropped in :func:`find_secrets` (only the key is kept).
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table

KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
#: Characters between the starts of parts that belong together.
SCOPE = 256
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
ID = r"((?:client|user|account|tenant|key)_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]+)"
ANY_ID = ID.replace("(?:client", "(?i:client").replace("_?id)", "_?(?i:id))")
KEY = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+[^\s\"'<>]*"
SPAN = "array<struct<start:int,end:int,kind:int>>"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def cut(rows: Column) -> Column:
    """An array in about sqrt(n) chunks of as many rows; an empty one is one empty chunk."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(rows) / size).cast("int") - 1)), lambda i: F.slice(rows, i * size + 1, size))


def scanned(rows: Column, start: Column, total, step, kind: str) -> Column:
    """The outputs of a running fold over an array, as one array.

    An array that grows by one is copied each time, so n rows in one fold would cost n * n. Rows are cut into chunks of about sqrt(n):
    ``total(state, x)`` folds each chunk to a state, the states are folded over the chunks, and each chunk then folds from its own state.
    step(state, x) is (next state, array of outputs); kind is the outputs' type. That costs n * sqrt(n) copies of references."""

    def whole(c: Column) -> Column:
        empty = F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("out"))
        before = F.aggregate(c, empty, lambda acc, x: F.struct(F.aggregate(x, acc["s"], total).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])
        none = F.expr(f"cast(array() as {kind})")

        def inner(x: Column, s: Column) -> Column:
            def one(acc: Column, row: Column) -> Column:
                after, found = step(acc["s"], row)
                return F.struct(after.alias("s"), F.concat(acc["out"], found).alias("out"))

            return F.aggregate(x, F.struct(s.alias("s"), none.alias("out")), one, lambda acc: acc["out"])

        return F.flatten(F.zip_with(c, before, inner))

    return let(rows, lambda r: let(cut(r), whole))


def spans(text: Column, pattern: str, kind: str, least: int, group: int = 0, mixed: bool = False) -> Column:
    """Leftmost non-overlapping matches whose group has at least so many characters (mixed: and a digit and a letter).

    Splitting by the pattern gives the gaps between the matches; the running sum of the lengths of
    gaps and matches gives the positions."""
    n = F.lit(KINDS.index(kind))
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group_hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    good = lambda g: (F.length(g) >= least) & g.rlike("[0-9]") & g.rlike("[A-Za-z]") if mixed else F.length(g) >= least
    lengths = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("hit"))),
        group_hits,
        lambda x, g: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), good(g).alias("keep")),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["gap"], at + x["gap"] + x["hit"]
        found = F.array(F.struct(start.alias("start"), end.alias("end"), n.alias("kind")))
        return end, F.when(x["keep"], found).otherwise(F.expr(f"cast(array() as {SPAN})"))

    return scanned(lengths, F.lit(0), lambda at, x: at + x["gap"] + x["hit"], step, SPAN)


#: Stands for no part before, and for none after.
NONE_BEFORE, NONE_AFTER = -(1 << 30), 1 << 30
PASS = "array<struct<a:int,b:int>>"
HIDDEN = "array<struct<from:int,start:int,end:int>>"


def around(parts: Column, is_a: Column, is_b: Column, reach: str) -> Column:
    """For each of the parts, in order of their starts: the greatest ``reach`` (start or end) of the a and b parts up to it, and the least
    start of those from it on, as struct(part, a, b, next_a, next_b). is_a and is_b are functions of a part."""

    def run(rows: Column, start: int, value, better) -> Column:
        def total(s: Column, x: Column) -> Column:
            return F.struct(F.when(is_a(x), better(s["a"], value(x))).otherwise(s["a"]).alias("a"), F.when(is_b(x), better(s["b"], value(x))).otherwise(s["b"]).alias("b"))

        return scanned(rows, F.struct(F.lit(start).alias("a"), F.lit(start).alias("b")), total, lambda s, x: (total(s, x), F.array(total(s, x))), PASS)

    before = run(parts, NONE_BEFORE, lambda x: x[reach], F.greatest)
    after = F.reverse(run(F.reverse(parts), NONE_AFTER, lambda x: x["start"], F.least))
    first = F.zip_with(parts, before, lambda x, p: F.struct(x.alias("part"), p["a"].alias("a"), p["b"].alias("b")))
    return F.zip_with(first, after, lambda x, n: F.struct(x["part"].alias("part"), x["a"].alias("a"), x["b"].alias("b"), n["a"].alias("next_a"), n["b"].alias("next_b")))


def near(x: Column, which: str, scope: int, gaps: bool) -> Column:
    """Whether a part of the kind a or b lies within the scope of x: by the starts, or (gaps) by what lies between."""
    end = x["part"]["end"] if gaps else x["part"]["start"]
    return (x["part"]["start"] - x[which] <= scope) | (x[f"next_{which}"] - end <= scope)


def with_spans(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, whole: bool = False) -> DataFrame:
    """Adds the columns _base and _all: base spans, and all reported spans in text order.

    whole: link by the gaps between spans, and take identifier names in either case."""
    named, names = (F.col("_t").rlike(ANY_ID), ANY_ID) if whole else (F.contains("_t", F.lit("id")) & F.col("_t").rlike(ID), ID)
    none = F.expr(f"cast(array() as {SPAN})")
    t = F.coalesce(F.col(text_col), F.lit(""))
    gate = lambda test, value: F.when(test, value).otherwise(none)  # noqa: E731  most texts hold no part of most kinds
    df = docs.withColumn("_t", t)
    df = df.withColumns(
        {
            "_assign": gate(F.col("_t").rlike(f"({NAMES})[\"']?\\x20*[:=]"), spans(F.col("_t"), ASSIGN, "assign", 6, 2)),
            "_access": gate(F.contains("_t", F.lit("AKIA")), spans(F.col("_t"), ACCESS, "access", 20)),
            "_hex": gate(F.col("_t").rlike(HEX), spans(F.col("_t"), HEX, "hex", 24)),
            "_id": gate(named, spans(F.col("_t"), names, "id", 4, 2)),
        }
    )
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_ids", F.concat("_access", "_id"))
    # Keys and addresses can only be findings beside an identifier part.
    df = df.withColumn("_key", gate(F.size("_ids") > 0, spans(F.col("_t"), KEY, "key", 32, mixed=True)))
    kinds = {k: KINDS.index(k) for k in KINDS}
    # Keys inside or across base spans are none: such a base span ends after the key's start, or starts before its end.
    of_key, of_base = (lambda x: x["kind"] == kinds["key"]), (lambda x: x["kind"] <= kinds["hex"])
    beside = F.filter(around(F.array_sort(F.concat("_base", "_key")), of_base, of_key, "end"), lambda x: of_key(x["part"]) & (x["a"] <= x["part"]["start"]) & (x["next_a"] >= x["part"]["end"]))
    df = df.withColumn("_key", F.when((F.size("_key") > 0) & (F.size("_base") > 0), F.transform(beside, lambda x: x["part"])).otherwise(F.col("_key")))
    df = df.withColumn("_secrets", F.size("_assign") + F.size("_hex") + F.size("_key"))
    df = df.withColumn("_endpoint", gate((F.size("_ids") > 0) & (F.col("_secrets") > 0), spans(F.col("_t"), ENDPOINT, "endpoint", 8)))
    is_secret = lambda x: x["kind"].isin(kinds["assign"], kinds["hex"], kinds["key"])
    is_id = lambda x: x["kind"].isin(kinds["access"], kinds["id"])
    parts = around(F.array_sort(F.concat("_base", "_id", "_key", "_endpoint")), is_secret, is_id, "end" if whole else "start")
    kind = lambda x: x["part"]["kind"]
    reported = lambda x: (
        (kind(x) == kinds["id"]) & near(x, "a", scope, whole) | (kind(x) == kinds["key"]) & near(x, "b", scope, whole) | (kind(x) == kinds["endpoint"]) & near(x, "a", scope, whole) & near(x, "b", scope, whole)
    )
    found = F.transform(F.filter(parts, reported), lambda x: x["part"])
    linked = F.when((F.size("_ids") > 0) & (F.size("_id") + F.size("_key") + F.size("_endpoint") > 0), found).otherwise(none)
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    df = df.withColumn("_all", order(F.concat("_base", linked))).withColumn("_base", order(F.col("_base")))
    return df.drop("_t", "_ids", "_key", "_secrets", "_endpoint", "_id")


def digest(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, linked_spans): the spans linked by the distance of their starts, and those that
    :func:`redact` masks, linked by the gaps between them and with identifier names in either case."""
    df = with_spans(docs.select(key, text_col), text_col, scope).select(key, text_col, "_assign", "_access", "_hex", "_base", F.col("_all").alias("_near"))
    df = with_spans(df, text_col, scope, whole=True)
    return df.select(
        key,
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(digest(F.col("_base")), 256).alias("base_sha256"),
        digest(F.col("_near")).alias("spans"),
        digest(F.col("_all")).alias("linked_spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """Replaces every reported span by the mask (overlapping spans by one); the columns stay the same.

    A null text stays null; n_chars, where there is one, follows the new text."""
    df = with_spans(docs.select(text_col, F.struct(*docs.columns).alias("_row")), text_col, scope, whole=True)
    t = F.col(text_col)
    upto = lambda at, x: F.greatest(at, x["end"])
    hidden = scanned(F.col("_all"), F.lit(0), upto, lambda at, x: (upto(at, x), F.array(F.struct(at.alias("from"), x["start"].alias("start"), upto(at, x).alias("end")))), HIDDEN)

    def piece(chunk: Column) -> Column:
        """A chunk's stretch of the text, with its spans masked; a span that begins within one before it adds to that one's mask."""
        begin = F.get(chunk, 0)["from"]
        part = F.substring(t, begin + 1, F.get(chunk, F.size(chunk) - 1)["end"] - begin)
        one = lambda p, x: F.when(x["start"] >= x["from"], F.concat(F.substring(p, x["from"] - begin + 1, x["start"] - x["from"]), F.lit(mask))).otherwise("")
        return let(part, lambda p: F.array_join(F.transform(chunk, lambda x: one(p, x)), ""))

    # Finding a place in a text costs its length, so that the text is cut by chunks of spans first.
    masked = let(hidden, lambda h: F.concat(F.array_join(F.transform(cut(h), piece), ""), F.substring(t, F.get(h, F.size(h) - 1)["end"] + 1, F.length(t))))
    found = F.size("_all") > 0
    new = {text_col: F.when(found, masked).otherwise(t)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.length(new[text_col]).cast("long")).otherwise(F.col("_row.n_chars"))
    return df.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op8_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _sql_spans(pattern: str, kind: str, least: int, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
        'start': CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0) AS INT),
        'size': length(regexp_extract_all(t, '{p}')[i]), 'kind': {KINDS.index(kind)},
        'least': length(regexp_extract_all(t, '{p}', {group})[i])}}), lambda x: x.least >= {least}), lambda x: {{'start': x.start, 'kind': x.kind, 'end': CAST(x.start + x.size AS INT)}})"""


_BY_STARTS = f"abs(p.start - x.start) <= {SCOPE}"
_BY_GAPS = f"greatest(x.start - p.end, p.start - x.end) <= {SCOPE}"
_JOINED = "array_to_string(list_transform(list_sort({}), lambda x: ['" + "','".join(KINDS) + "'][x.kind + 1] || ':' || x.start || ':' || x.end), ',')"


def _oracle(names: str, within: str) -> str:
    near = "len(list_filter({}, lambda p: " + within + ")) > 0"
    return f"""(WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, {_sql_spans(ASSIGN, "assign", 6, 2)} AS assign, {_sql_spans(ACCESS, "access", 20, 0)} AS access, {_sql_spans(HEX, "hex", 24, 0)} AS hex, {_sql_spans(names, "id", 4, 2)} AS id FROM d),
b AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base, list_concat(access, id) AS ids FROM a),
c AS (SELECT *, list_filter(CASE WHEN len(ids) > 0 THEN {_sql_spans(KEY, "key", 32, 0)} ELSE [] END, lambda x: regexp_matches(substring(t, x.start + 1, x.end - x.start), '[0-9]') AND regexp_matches(substring(t, x.start + 1, x.end - x.start), '[A-Za-z]') AND len(list_filter(base, lambda b: b.start < x.end AND x.start < b.end)) = 0) AS keys FROM b),
e AS (SELECT *, list_concat(list_concat(assign, hex), keys) AS secrets FROM c),
f AS (SELECT *, CASE WHEN len(ids) > 0 AND len(secrets) > 0 THEN {_sql_spans(ENDPOINT, "endpoint", 8, 0)} ELSE [] END AS endpoints FROM e),
g AS (SELECT *, list_concat(base, list_concat(list_filter(id, lambda x: {near.format("secrets")}), list_concat(list_filter(keys, lambda x: {near.format("ids")}), list_filter(endpoints, lambda x: {near.format("ids")} AND {near.format("secrets")})))) AS found FROM f)
SELECT doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex,
  sha256({_JOINED.format("base")}) AS base_sha256, {_JOINED.format("found")} AS spans FROM g)"""


ORACLE = f"SELECT s.*, l.spans AS linked_spans FROM {_oracle(ID, _BY_STARTS)} s JOIN {_oracle(ANY_ID, _BY_GAPS)} l ON s.doc_id = l.doc_id"

QUERIES = {"op8_secret_linking": op8_secret_linking}
SQL = {"op8_secret_linking": ORACLE}
