"""Ranked search with segments to open, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import search


def split(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(segments, asked, page=20, excerpt=30):
    docs = {}
    for d, s, t in segments:
        docs.setdefault(d, {})[s] = split(t)
    flat = {d: [w for s in sorted(p) for w in p[s]] for d, p in docs.items()}
    flat = {d: w for d, w in flat.items() if w}
    n, total = len(flat), sum(map(len, flat.values()))
    df = {}
    for w in flat.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for q, text in asked:
        terms = list(dict.fromkeys(split(text)))
        found = []
        for d, w in flat.items():
            if terms and set(terms) <= set(w):
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (22000 * w.count(t) // (10 * w.count(t) + 3 + 9 * len(w) * n // total)) for t in terms)
                found.append((-score, d))
        for rank, (score, d) in enumerate(sorted(found)[:page], 1):
            spans = {}
            for s, w in docs[d].items():
                if set(terms) & set(w):
                    spans[s] = min((j - i + 1 for i in range(len(w)) for j in range(i, len(w)) if set(terms) <= set(w[i : j + 1])), default=None)
            good = [s for s in sorted(spans) if spans[s] is not None and spans[s] <= excerpt]
            anchor = (good or sorted(spans))[0]
            out.add((q, rank, d, -score, anchor, spans[anchor]))
    return out


def hits(spark, segments, asked, **options):
    rows = search.ranked_hits(spark.createDataFrame(segments, "doc long, seg long, text string"), spark.createDataFrame(asked, "q long, text string"), "doc", "seg", "q", "text", **options).collect()
    return {(r.q, r["rank"], r.doc, r.score, r.anchor, r.span) for r in rows}


def test_equals_plain_python(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    segments = [(d, s, " ".join(rng.choice(words[: 5 + d % 21]) for _ in range(rng.randrange(0, 25)))) for d in range(60) for s in range(rng.randrange(1, 5))]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for i in range(25)]
    assert hits(spark, segments, asked) == brute(segments, asked)
    assert hits(spark, segments, asked, page=3, excerpt=4) == brute(segments, asked, 3, 4)


def test_a_phrase_of_one_segment_opens_it(spark):
    segments = [(d, s, f"common words of talk {d} part {s} and more") for d in range(30) for s in range(8)] + [(7, 9, "here the purple heron landed"), (7, 8, "purple things, and " + "x " * 40 + "a heron")]
    found = hits(spark, segments, [(1, "purple heron"), (2, "talk 7"), (3, "absent words"), (4, "")])
    assert {(q, d, a) for q, _, d, _, a, _ in found if q == 1} == {(1, 7, 9)}
    assert {q for q, *_ in found} == {1, 2}


def test_odd_rows(spark):
    segments = [(1, 0, None), (1, 1, ""), (2, 0, "Ünï 日本 x"), (2, 0, "Ünï again"), (3, 5, "日本 " * 3000 + "x")]
    found = hits(spark, segments, [(1, "ÜNÏ"), (2, "日本 x"), (3, None)])
    assert {(q, d) for q, _, d, *_ in found} == {(1, 2), (2, 2), (2, 3)}
    assert hits(spark, [], [(1, "a")]) == set() and hits(spark, segments, []) == set()


@pytest.mark.parametrize("places, best", [([(0, "a"), (5, "b"), (6, "a")], 2), ([(0, "a"), (1, "a")], None), ([(3, "b"), (4, "a")], 2), ([], None)])
def test_covering_stretch(spark, places, best):
    df = spark.createDataFrame([(places, ["a", "b"])], "p array<struct<at:int,token:string>>, t array<string>")
    assert df.select(search.covering(F.col("p"), F.col("t"))).first()[0] == best
