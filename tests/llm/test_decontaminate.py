import random
import tracemalloc

from scriptorium.llm import decontaminate as d


def edits(item, text):
    """Least edits between the item and any piece of the text."""
    row = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        nxt = [i]
        for j in range(1, len(text) + 1):
            nxt.append(min(row[j - 1] + (item[i - 1] != text[j - 1]), row[j] + 1, nxt[j - 1] + 1))
        row = nxt
    return min(row)


def plain(text):
    return " ".join((text or "").lower().split())


def altered(text, n, rng):
    out = list(text)
    for _ in range(n):
        p, what = rng.randrange(len(out)), rng.random()
        if what < 1 / 3:
            out[p] = rng.choice("abcé ")
        elif what < 2 / 3:
            out.insert(p, rng.choice("abc"))
        else:
            out.pop(p)
    return "".join(out)


def test_bound_against_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 40))) for _ in range(40)]
    index = d.build(list(enumerate(items)), d.EDITS)
    for _ in range(80):
        i = rng.randrange(len(items))
        text = " ".join(rng.choice(words) for _ in range(12)) + " " + altered(items[i], rng.randrange(0, 2 + int(0.14 * len(items[i]))), rng) + " " + rng.choice(words)
        near = edits(plain(items[i]), plain(text))
        hits = [h for h in d.search(index, ["", text, None]) if h[1] == i]
        assert bool(hits) == (near <= index.edits[i])
        if hits:
            assert hits[0][0] == 1 and hits[0][4] == near
            assert edits(plain(items[i]), plain(text.lower()[hits[0][2] : hits[0][3]])) <= index.edits[i]


def test_common_grams_lose_nothing():
    rng = random.Random(6)
    shared = "the same opening words stand in every item of this set "
    items = [shared + " ".join(f"{rng.randrange(10**6)}" for _ in range(8)) for _ in range(60)]
    index = d.build(list(enumerate(items)), d.EDITS)
    for i, item in enumerate(items):
        assert i in {h[1] for h in d.search(index, [f"x {altered(item, 3, rng)} y"])}


def test_normal_text():
    points, places, starts = d.normal(["  A\n\tb ", None, "", "É　 x", " "])
    assert "".join(map(chr, points)) == "a bé x" and places.tolist() == [2, 3, 5, 0, 1, 3] and starts.tolist() == [0, 3, 3, 3, 6, 6]


def test_rows(spark):
    item = "a passage of a benchmark that must not be in any text that a model learns from"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y", "c"), (2, None, "c"), (None, item, "c"), (4, "", "c"), (5, "word " * 60_000 + item.replace(" ", "\n") + " word" * 9, "c"), (1, f"x {item.upper()} y", "c"), (7, "the end", "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item, "y"), (11, None, "y"), (12, " ", "y"), (13, item, "y"), (14, "end", "y")], "item_id long, text string, doc_id string")
    rows = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.distance) for r in d.find_leaks(docs, items).collect())
    n = len(item)
    assert rows == sorted([(i, j, s, s + n, 0) for i, s in ((1, 2), (1, 2), (0, 0), (5, 300_000)) for j in (10, 13)] + [(7, 14, 4, 7, 0)])
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == [2, 4]
    assert d.clean(docs, items).columns == docs.columns and d.clean(docs, items.limit(0)).count() == 7
    assert d.find_leaks(docs, items.limit(0)).count() == 0 and d.find_leaks(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")]
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(*tables).collect()}
    monkeypatch.undo()
    assert found == {(r.doc_id, r.item_id) for r in d.find_leaks(*tables).collect()}
    docs, items = [[(r[0], plain(r.text)) for r in t.collect()] for t in tables]
    assert found >= {(i, j) for i, t in docs for j, x in items if x in t}


def test_short_items_have_their_whole_budget():
    rng = random.Random(7)
    for n in range(9, 41):
        for _ in range(6):
            item = "".join(rng.choice("abcdefghijkl") for _ in range(n))
            text = "zz " + altered(item, rng.randrange(0, 2 + n // 10), rng) + " yy"
            near = edits(plain(item), plain(text))
            assert bool(d.search(d.build([(0, item)], d.EDITS), [text])) == (near <= int(d.EDITS * len(plain(item))))


def test_repetitive_items():
    """Items that repeat themselves, by windows, against brute force; and in bounded memory."""
    rng = random.Random(8)
    for _ in range(30):
        item = rng.choice(["ha ", "abab ", "x", "lorem ipsum dolor "]) * rng.randrange(30, 60)
        text = "an end " * rng.randrange(9) + altered(item, rng.randrange(0, 2 + int(0.14 * len(item))), rng) + " no end" * rng.randrange(9)
        index = d.build([(0, item)], d.EDITS)
        hits = d.search(index, [text])
        assert bool(hits) == (edits(plain(item), plain(text)) <= index.edits[0])
    index = d.build([(0, "ha " * 600)] + [(i, f"ha ha ha ha {i} " + "".join(rng.choice("abcdefgh ") for _ in range(60))) for i in range(1, 40)], d.EDITS)
    tracemalloc.start()
    assert {h[1] for h in d.search(index, ["ha " * 333_000])} == {0}
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_many_short_and_repetitive_items():
    """10,000 of each kind: one index and one look-up for all, and what they find equals a search for each."""
    import pickle
    import random
    import time

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    short = [word(rng.randrange(1, 8)) if i % 3 else f"{word(2)} {word(3)}" for i in range(10_000)]
    repetitive = [" ".join([word(4)] * 12) for _ in range(10_000)]
    began = time.process_time()
    index = d.build(list(enumerate(short + repetitive)), d.EDITS)
    assert len(index.windowed) == 1 and len(pickle.dumps(index)) < 100 << 20
    texts = [" ".join(rng.choice(short) if rng.random() < 0.2 else word(5) for _ in range(2000)) for _ in range(5)]
    texts += ["x " + repetitive[7] + " y", repetitive[8] + " " + repetitive[9][:-1], ""]
    found = {h[:2] for h in d.search(index, texts)}
    assert time.process_time() - began < 30
    want = {(t, o) for o, x in enumerate(short) for t, text in enumerate(texts) if f" {x} " in f" {text} "}
    assert found == want | {(5, 10_007), (6, 10_008), (6, 10_009)}
