"""Spans against Python's regular expressions."""

import hashlib
import re
import time

from scriptorium.llm import secrets

PYTHON = {
    "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}
ACCESS = "AKIA" + "Z9" * 8
TEXTS = [
    "",
    None,
    'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
    "secret=token: abcdefgh PASSWORD:abc Api_Key = 'aaaaaa",
    f"{ACCESS} {ACCESS}9 AKIAAKIA AKIA{'B' * 15} {ACCESS.lower()}",
    "😀 " + "0a" * 12 + "g" + "f" * 23 + " password=" + "f" * 30,
    "toKen = abcdef Key",
    "token=a1b2c3 " * 300,
    "x" * 100_000 + " passwd : 'qwerty1' " + "y" * 100_000,
]


def base(text):
    spans = []
    for n, (kind, (pattern, group, least)) in enumerate(PYTHON.items()):
        spans += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in secrets.find_secrets(df).collect():
        want = base(TEXTS[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in want) for k in PYTHON], r.doc_id
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert joined(want) == r.spans


def test_weak_parts_need_their_complement(spark):
    key = "Ab1" * 12
    link = f"{ACCESS} https://store.example.org/x {key} client_id: acme7"
    texts = [key, f"https://store.example.org/x {key}", "client_id: acme7", link, f"{ACCESS}{' ' * 300}{key}", f"client_id=acme7 token=abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert spans[0] == spans[1] == spans[2] == ""
    at = {k: link.index(k) for k in ("https", key, "client")}
    assert spans[3] == f"access:0:20,endpoint:{at['https']}:{at['https'] + 27},key:{at[key]}:{at[key] + 36},id:{at['client']}:{len(link)}"
    assert spans[4] == "access:0:20"
    assert spans[5] == "id:0:15,assign:16:28"


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdef b " + "0" * 30, 5, 3), (2, None, None, 1), (3, "clean", 5, 2)], "doc_id long, text string, n_chars long, _t int")
    rows = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert rows[1].text == "a [SECRET] b [SECRET]" and rows[1].n_chars == 21
    assert rows[2].text is None and rows[2].n_chars is None
    assert rows[3].text == "clean" and secrets.redact(df).columns == df.columns
    assert secrets.redact(df.limit(0)).count() == 0 and secrets.find_secrets(df.limit(0)).count() == 0


def test_redaction_links_across_long_and_upper_case_parts(spark):
    long, key, far = "token=" + "a1" * 200, "Ab1" * 12, " " * 257
    texts = [f"{long} client_id=acme7 https://store.example.org/x", f"CLIENT_ID=acme7 {key}", f"{long} Account_Id: acme7 https://a.example.org/{'x' * 400} b", f"{ACCESS}{far}{key}", "USER_ID: acme7 clean", f"{long} {key}"]
    rows = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0] == "[SECRET] [SECRET] [SECRET]" and rows[1] == "[SECRET] [SECRET]" and rows[2] == "[SECRET] [SECRET] [SECRET] b"
    assert rows[3] == f"[SECRET]{far}{key}" and rows[4] == texts[4] and rows[5] == f"[SECRET] {key}"


def test_many_parts_in_one_text(spark):
    """The links of 20,000 parts, against a sweep over their places."""
    unit = "token=abcdef client_id=acme7 "
    text = unit * 5_000 + " " * 600 + "client_id=alone " + " " * 600 + unit * 5_000
    began = time.time()
    spans = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].spans.split(",")
    assert time.time() - began < 60
    alone = text.index("client_id=alone")
    assert len(spans) == 20_000 and f"id:{alone}:{alone + 15}" not in spans


def test_parts_grow_the_work_little(spark):
    """80,000 parts in one text: seconds, not minutes; masked and found alike."""
    unit = "token=abcdef client_id=acme7 "
    df = spark.createDataFrame([(1, unit * 40_000)], "doc_id long, text string")
    began = time.time()
    row = secrets.find_secrets(df).collect()[0]
    assert row.n_assign == 40_000 and row.spans == row.linked_spans and row.spans.count(",") == 79_999
    assert secrets.redact(df).collect()[0].text == "[SECRET] " * 80_000
    assert time.time() - began < 60


def test_reported_links_are_those_that_are_masked(spark):
    long = "token=" + "a1" * 200
    texts = [f"{long} client_id=acme7 x", "CLIENT_ID=acme7 " + "Ab1" * 12, "user_id: acme7 clean", None, ""]
    rows = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].spans == "assign:0:406,hex:6:406" and rows[0].linked_spans == "assign:0:406,hex:6:406,id:407:422"
    assert rows[1].spans == "" and rows[1].linked_spans == "id:0:15,key:16:52" and rows[2].linked_spans == rows[3].linked_spans == rows[4].spans == ""


def test_overlapping_spans_are_masked_once(spark):
    text = "a token=" + "0a" * 20 + "! b " + "0" * 30 + " c"
    assert secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].text == "a [SECRET]! b [SECRET] c"
