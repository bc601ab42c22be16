"""Neighbours, carried values and as-of lookups over ranges of an order, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import related


def rows_of(n, groups, seed=1):
    rng = random.Random(seed)
    # One group holds most rows, one is null; values are null or negative at times.
    return [(i, rng.choice(groups), rng.randrange(n // 2), rng.choice([None, -1.0, *map(float, range(20))])) for i in range(n)]


SCHEMA = "id long, g string, at long, v double"


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_neighbours_over_groups_and_over_all(spark, parts):
    rows = rows_of(300, ["a", "a", "a", "b", None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for by in ([], ["g"]):
        found = {r.id: (r.previous, r.next) for r in related.beside(df, "id", by, F.col("at"), [F.col("at").asc(), F.col("id").asc()], parts).collect()}
        want = {}
        for g in {r[1] if by else 0 for r in rows}:
            own = sorted((r for r in rows if not by or r[1] == g), key=lambda r: (r[2], r[0]))
            want |= {r[0]: (own[i - 1][0] if i else None, own[i + 1][0] if i + 1 < len(own) else None) for i, r in enumerate(own)}
        assert found == want


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_carried_values_and_drops(spark, parts):
    rows = rows_of(300, ["a", "a", "a", "b", None], 4)
    df, order = spark.createDataFrame(rows, SCHEMA).repartition(5), [F.col("at").asc(), F.col("id").asc()]
    want, falls = {}, set()
    for g in {r[1] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            want[r[0]] = last
            if r[3] is not None and r[3] >= 0:
                if r[3] < (-1.0 if last is None else last):
                    falls.add(r[0])
                last = r[3]
    valid = F.when(F.col("v") >= 0, F.col("v"))
    assert {r.id: r.before for r in related.carried(df, ["g"], F.col("at"), order, valid, "before", parts).collect()} == want
    assert {r.id for r in related.drops(df, ["g"], F.col("at"), order, F.col("v"), parts=parts).collect()} == falls


def test_a_large_group_is_split(spark):
    df = spark.range(20_000).withColumn("g", F.lit("hot"))
    rows = related.ranged(df, F.col("id"), 64).groupBy("g", "_range").count().collect()
    assert len(rows) == 64 and max(r["count"] for r in rows) < 1000


def test_the_last_anchor_before_a_place(spark):
    rng = random.Random(2)
    anchors = [(rng.choice(["a", "b", None]), rng.randrange(100), n) for n in range(60)]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(-5, 120)) for i in range(80)]
    found = related.last_before(spark.createDataFrame(anchors, "g string, at long, n long"), spark.createDataFrame(asked, "q long, g string, at long"), ["g"], "at", "n", "q", parts=5).collect()
    for r in found:
        before = [(at, n) for g, at, n in anchors if g == r.g and at <= r.at]
        assert r.n == (max(before)[1] if before else None)
    assert sorted(r.q for r in found) == list(range(80))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert related.beside(df, "id", [], F.col("at"), [F.col("at")]).count() == 0 and related.drops(df, ["g"], F.col("at"), [F.col("at")], F.col("v")).count() == 0
