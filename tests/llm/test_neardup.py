import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import neardup as n


def bag(text):
    words = (text or "").lower().split()
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return Counter(runs)


def similarity(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def brute(rows):
    """Class of each row by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, least.get(find(i))) for i, (k, _) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r))


def altered(words, changes, rng):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    errors = []
    for changes in (1, 4, 9, 20):
        for _ in range(15):
            words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 300))] + ["ha"] * rng.randrange(200)
            texts = [" ".join(words), altered(words, changes, rng)]
            _, doc, h, count = n.bags(texts, n.WordHashes())
            a, b = n.signatures(2, doc, h, count)
            cut = int(np.searchsorted(doc, 1))
            exact = similarity(bag(texts[0]), bag(texts[1]))
            assert abs(n.overlap(n.expanded(h[:cut], count[:cut]), n.expanded(h[cut:], count[cut:])) - exact) < 1e-9
            errors.append((a == b).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((k, altered(words, rng.choice([0, 0, 1, 2, 3, 6]), rng)))
            k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "  "), (k + 3, "two words"), (k + 4, "Two  words"), (k + 5, "three other words"), (3, rows[3][1]), (None, rows[0][1]), (None, "alone and without a key at all")]
    rows += [(k + 6, "ha " * 30_000), (k + 7, "ha " * 29_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    assert ordered(tuple(r) for r in n.classes(df).collect()) == ordered(brute(rows))


def test_a_large_group_without_a_common_hub(spark):
    """Copies that are near to their neighbours only: one class by links that no single hub has."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words[(i * 7) % 300] = f"v{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(tuple(r) for r in n.classes(df).collect()) == ordered(brute(rows))


def test_unlike_texts_of_common_passages_take_few_rounds(spark, monkeypatch):
    """Each text is six of twelve passages: buckets and rarest elements are common, hardly a pair is alike. Before, hubs grew from one to 64, a round each time."""
    passages = [" ".join(f"p{i}-{j}" for j in range(60)) for i in range(12)]
    rng = random.Random(6)
    rows = [(k, " ".join(passages[i] for i in sorted(rng.sample(range(12), 6)))) for k in range(60)]
    rows += [(k, altered(rows[k - 60][1].split(), 3, rng)) for k in range(60, 65)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rounds, meet = [], n.meet
    monkeypatch.setattr(n, "meet", lambda state, slots, sets, least: rounds.append(slots) or meet(state, slots, sets, least))
    assert ordered(tuple(r) for r in n.classes(df).collect()) == ordered(brute(rows))
    assert 2 < len(rounds) <= 3
    # Where meetings are limited, rounds go on until all have met, with the same classes.
    monkeypatch.setattr(n, "MEETINGS", 1)
    monkeypatch.setattr(n, "ALL_MEETINGS", 1)
    monkeypatch.setattr(n, "HUBS", 2)
    rounds.clear()
    assert ordered(tuple(r) for r in n.classes(df).collect()) == ordered(brute(rows))
    assert rounds[:3] == [1, 2, 8] and len(rounds) > 3


def test_keep_first(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(5, a, 1), (2, a + " x", 2), (2, a + " x", 2), (9, b, 3), (None, b, 4)], "doc_id long, text string, class_id int")
    kept = n.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.class_id for r in kept.collect()) == [2, 3, 4]
    assert n.keep_first(df.limit(0)).count() == 0 and n.classes(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ordered(tuple(r) for r in n.op1_bagminhash(spark, "/root/testdata/sf0.001").collect()) == ordered(brute(rows))


def test_prefixes_of_bags(spark):
    """Only a share of each bag's elements is dealt, and two similar bags have one of them in common, whatever their slots hold."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join([f"w{k}-{i}" for i in range(100)] + common) for k in range(20)]
    texts += [altered(t.split(), 4, rng) for t in texts]
    doc, h, count = n.bags(texts, n.WordHashes())[1:]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [n.expanded(h[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]
    rows = [(bytes([i]), bytes([i]), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node binary, root binary, bag binary")
    often = n.slot_counts(df)
    assert often.sum() == sum(map(len, sets))
    for slots in (often, np.zeros_like(often)):
        first = {}
        for r in n.prefixes(df, slots, n.SIMILARITY).collect():
            first.setdefault(bytes(r.node)[0], set()).add(r.bucket)
        assert all(len(first[i]) <= 0.2 * len(x) + 1 for i, x in enumerate(sets))
        assert all(first[i] & first[j] for i in range(len(sets)) for j in range(i) if n.overlap(sets[i], sets[j]) >= n.SIMILARITY)
    # By frequency, texts that only share a common passage don't meet.
    of = [{r.bucket for r in n.prefixes(df.where(F.col("node") == bytes([i])), often, n.SIMILARITY).collect()} for i in (0, 1)]
    assert not of[0] & of[1]


def test_only_the_bags_of_pairs_are_dealt(spark, monkeypatch):
    """Before, each round shuffled all bags."""
    name = lambda c: F.unhex(F.md5(c.cast("string")))
    sets = spark.range(20_000).select(name(F.col("id")).alias("node"), F.lit(b"abcd").alias("bag"))
    pairs = spark.range(300).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"), F.lit(1).alias("x"))
    wanted = {r[0] for r in pairs.selectExpr("explode(array(a, b))").collect()}
    assert {r["node"] for r in n.bags_of(pairs, sets).collect()} == wanted
    monkeypatch.setattr(n, "BROADCAST_ROWS", 10)
    through = [r["node"] for r in n.bags_of(pairs, sets).collect()]
    assert wanted <= set(through) and len(through) == len(set(through)) < 2 * len(wanted)
    monkeypatch.setattr(n, "FILTER_BITS", 1 << 12)
    assert wanted <= {r["node"] for r in n.bags_of(pairs, sets).collect()}
    assert n.similar(pairs, sets, 0.8).count() == 300
