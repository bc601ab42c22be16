import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document is scored for every distinct item."""
    rows = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for key, held, size in rows:
            share = 8 * (25 + 75 * size * n // total)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * held[t] // (1000 * held[t] + share)) for t, times in Counter(terms(text)).items() if t in held)
            if score:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(found)[:k])]
    return Counter(out)


def ranks(spark, docs, items, parts=3, chars=search.SEGMENT_CHARS, k=10, **options):
    blocks = search.index(spark.createDataFrame(docs, DOCS).repartition(parts), chars=chars)
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(blocks, spark.createDataFrame(items, ITEMS), k=k, **options).collect())


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    pick = lambda m: " ".join(words[min(199, int(rng.paretovariate(0.7)) - 1)] for _ in range(m))
    docs = [(i, pick(rng.randrange(1, 80))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(n // 3)]  # a third are copies
    return docs, [(i, pick(rng.randrange(2, 12))) for i in range(12)]


def test_equals_scoring_of_all_documents(spark):
    docs, items = corpus(900)
    assert ranks(spark, docs, items, chars=8_000) == brute(docs, items)
    assert ranks(spark, docs, items, parts=1, k=3) == brute(docs, items, 3)
    assert ranks(spark, docs, items, batch_terms=20) == brute(docs, items)


def test_blocks_below_the_threshold_stay_packed():
    docs = search.Segment()
    for i in range(6000):
        docs.add(i, "common " * (1 + i % 5) + ("rare rare rare" if i in (40, 4000) else "filler words here"))
    lists = search.Lists(docs.rows(0), 6000, 6000 * 6)
    best = search.Best(2)
    lists.search([("rare", 9000), ("common", 10)], best)
    assert best.ids.tolist() == sorted([40, 4000], key=lambda i: i % 5) or set(best.ids.tolist()) == {40, 4000}
    a, b = lists.of["common"]
    docs_open, _, done = lists.open[a]
    assert b - a == -(-6000 // search.BLOCK) and done.sum() <= 3


def test_block_bounds_are_exact():
    rng = random.Random(1)
    held = search.Segment()
    for i in range(700):
        held.add(i, "a " * rng.randrange(1, 30) + "b " * rng.randrange(0, 50))
    lists = search.Lists(held.rows(0), 700, 20_000)
    for a, b in lists.of.values():
        _, impacts = lists.postings(a, b, 0, b - a)
        edges = range(0, len(impacts), search.BLOCK)
        assert [int(impacts[e : e + search.BLOCK].max()) for e in edges] == lists.most[a:b].tolist()


def test_variable_bytes_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 31) - 1, 5])
    raw, ends = search.var_bytes(values)
    assert search.from_var_bytes(raw).tolist() == values.tolist() and ends[-1] == len(raw)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Ünïcode ÜNÏCODE x"), (5, "Ünïcode"), (5, "Ünïcode"), (None, "x y"), (7, "long " * 40_000 + "needle"), (-3, "x\ty\nz"), (9, "日本語 text 日本語")]
    items = [(1, "x needle"), (1, "x needle"), (1, "Ünïcode"), (2, None), (3, ""), (4, "absent words"), (5, "日本語 TEXT"), (None, "y")]
    assert ranks(spark, docs, items, parts=2) == brute(docs, items)
    assert not ranks(spark, [], items) and not ranks(spark, docs, []) and not ranks(spark, [(1, None)], items)


def test_other_columns_and_string_items(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "b c", "y", 4)], "doc_id long, text string, term string, segment long")
    items = spark.createDataFrame([("q", "b a", "z")], "item_id string, text string, own string")
    rows = search.ranked(search.index(docs), items).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in rows] == [("q", 1, 1), ("q", 2, 2)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = search.op11_block_max_wand(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text")).collect()]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == brute(docs, items)
