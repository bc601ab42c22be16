"""Order-dependent operators over keyed rows: neighbours, related records, violations of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_related(df: DataFrame, key: str, kind: str, org: str, recency: str, most: int = 4) -> DataFrame:
    """(key, related, position): the others of the same kind, same org first (null equals null), then the most recent.

    Linear: whatever row asks, its relatives are among the first most + 1 of its (kind, org) and of its kind, so two
    group limits replace the self join."""
    newest = [F.col(recency).desc(), F.col(key).asc()]
    rows = df.select(key, kind, org, recency)
    ranked = lambda by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("r") <= most + 1).drop("r")
    ask = rows.select(F.col(key).alias("_key"), F.col(kind).alias("_kind"), F.col(org).alias("_org"))
    near = ask.join(ranked([kind, org]), (F.col("_kind") == F.col(kind)) & F.col("_org").eqNullSafe(F.col(org))).withColumn("same", F.lit(1))
    far = ask.join(ranked([kind]), (F.col("_kind") == F.col(kind)) & ~F.col("_org").eqNullSafe(F.col(org))).withColumn("same", F.lit(0))
    order = Window.partitionBy("_key").orderBy(F.col("same").desc(), *newest)
    both = near.unionByName(far).where(F.col("_key") != F.col(key)).withColumn("position", F.row_number().over(order))
    return both.where(F.col("position") <= most).select(F.col("_key").alias(key), F.col(key).alias("related"), "position")


def ranged(df: DataFrame, rank: Column, parts: int) -> DataFrame:
    """Adds _range: which of at most parts ranges of a rising number a row is in, by approximate percentiles (null: the first)."""
    shares = [i / parts for i in range(1, parts)]
    bounds = df.select(rank.cast("double").alias("r")).agg(F.percentile_approx("r", shares).alias("b")).first()["b"] or []  # one row
    at = F.coalesce(rank.cast("double"), F.lit(float("-inf")))
    return df.withColumn("_range", sum(((at > float(b)).cast("int") for b in sorted(set(bounds))), F.lit(0)))


def beside(df: DataFrame, key: str, by: list[str], rank: Column, order: list[Column], parts: int = 64) -> DataFrame:
    """Adds previous and next: the keys before and after in an order that rises with the number rank, over groups of any size (no columns: over all rows).

    Rows are cut into ranges of rank and look at their neighbours within them; the keys at the ends of the ranges, a row a group and range, are handed on."""
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    one = F.lit(1)
    rows = ranged(df, rank, parts).withColumns({"_p": F.lag(key).over(w), "_n": F.lead(key).over(w), "_first": F.lag(one).over(w).isNull(), "_last": F.lead(one).over(w).isNull()})
    ends = rows.where("_first or _last").groupBy(*by, "_range").agg(F.max(F.when(F.col("_first"), F.col(key))).alias("_head"), F.max(F.when(F.col("_last"), F.col(key))).alias("_tail"))
    along = Window.partitionBy(*by).orderBy("_range")
    handed = ends.select(*by, "_range", F.lag("_tail").over(along).alias("_before"), F.lead("_head").over(along).alias("_after"))
    return _met(rows, handed, [*by, "_range"]).select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_p")).alias("previous"), F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_n")).alias("next"))


def carried(df: DataFrame, by: list[str], rank: Column, order: list[Column], value: Column, name: str, parts: int = 64) -> DataFrame:
    """Adds the last non-null value of the rows before, in an order that rises with the number rank, over groups of any size."""
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    rows = ranged(df.withColumn("_v", value), rank, parts)
    rows = rows.withColumns({"_own": F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_i": F.row_number().over(w)})
    ends = rows.where("_v is not null").groupBy(*by, "_range").agg(F.max_by("_v", "_i").alias("_end"))
    # Ranges without a value hand on what came before them.
    all_ranges = rows.select(*by, "_range").distinct()
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    handed = _met(all_ranges, ends, [*by, "_range"], "left").select(*by, "_range", F.last("_end", ignorenulls=True).over(along).alias("_before"))
    return _met(rows, handed, [*by, "_range"]).select(*df.columns, F.coalesce("_own", "_before").alias(name))


def _met(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null meets null."""
    other = small.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    test = F.lit(True)
    for i, c in enumerate(on):
        test = test & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return rows.join(other, test, how).drop(*[f"_on{i}" for i in range(len(on))])


def drops(df: DataFrame, by: list[str], rank: Column, order: list[Column], value: Column, start: float = -1.0, parts: int = 64) -> DataFrame:
    """Rows whose value is lower than the last valid (non-null, non-negative) one before, over groups of any size."""
    valid = F.when(value >= 0, value)
    return carried(df, by, rank, order, valid, "before", parts).withColumn("before", F.coalesce("before", F.lit(start))).where(valid < F.col("before"))


def last_before(anchors: DataFrame, asked: DataFrame, by: list[str], at: str, anchor: str, asked_key: str, parts: int = 64) -> DataFrame:
    """(asked_key, by, at, anchor): the last anchor at or before each asked place, null if there is none; an as-of lookup.

    anchors: by, at, anchor, one a place (of several the greatest counts); asked: asked_key, by, at."""
    a = anchors.groupBy(*by, at).agg(F.max(anchor).alias(anchor))
    kind = dict(anchors.dtypes)[anchor]
    both = a.select(F.lit(None).cast(dict(asked.dtypes)[asked_key]).alias(asked_key), *by, at, anchor, F.lit(0).alias("_kind")).unionByName(asked.select(asked_key, *by, at, F.lit(None).cast(kind).alias(anchor), F.lit(1).alias("_kind")))
    found = carried(both, by, F.col(at), [F.col(at).asc(), F.col("_kind").asc()], F.col(anchor), "_found", parts)
    return found.where("_kind = 1").select(asked_key, *by, at, F.col("_found").alias(anchor))


def numbered(df: DataFrame, by: list[str], rank: Column, order: list[Column], parts: int = 64) -> DataFrame:
    """Adds position: the number of each row within its group, in an order whose first column rises with the number rank.

    Rows are cut into ranges of rank (at most parts bounds, from approximate percentiles), numbered within a group's range, and moved up by
    the counts of the ranges before: a group of any size is split over tasks."""
    rows = ranged(df, rank, parts)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    return inside.join(starts, [*by, "_range"]).withColumn("position", F.col("_start") + F.col("_n")).drop("_range", "_start", "_n")


def repeats_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, key, occurrence) of second and later rows of a text, in order of the (numeric) key.

    Only hashes are dealt; the texts of the few keys that repeat are joined to them at the end."""
    hashed = df.select(key, F.sha2(text, 256).alias("_h"))
    again = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_h")
    ranked = numbered(hashed.join(again, "_h"), ["_h"], F.col(key), [F.col(key)]).where("position > 1")
    found = ranked.select(key, F.col("position").cast("int").alias("occurrence"))
    return found.join(df.select(key, text), key).select(text, key, "occurrence")
