"""Findings of the fourth round: texts that name no number are not read by any line."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_numbers import CASES, READ

from scriptorium.functions import numbers

#: Words with the letters of number words in them, and words that lines have beside numbers.
PLAIN = "Often stones and tensions of the rare lantern attend; thousandfold doubtful things, as the twofoldness of a manytrillionth eighteenthly point."


def test_words_with_the_letters_of_number_words_are_tried_by_no_line():
    assert numbers.met(numbers.grams(PLAIN)) == set()
    assert numbers.compare(PLAIN * 3, PLAIN.upper()) == ("ok", [], [])


def test_only_pairs_that_may_name_a_number_are_compared(spark):
    """A pair is let through if any line, month or digit is in one of its texts, and no other pair."""
    texts = sorted({x or "" for case in CASES for x in case[:2]} | {x for x, _ in READ} | {PLAIN, "the ſixth", "３", "doublets", "x_two_y", "aK 5", "untwo"})
    near = {i for i, *_ in numbers.told(pa.array(texts), pa.nulls(len(texts), pa.string()))}
    has = [numbers.grams(x) for x in texts]
    assert all(i in near for i, x in enumerate(has) if numbers.met(x) or numbers.may_match(numbers.needed_months(), x) or "\\d" in x)
    assert all(numbers.tokens(x) == [] for i, x in enumerate(texts) if i not in near)
    assert near == {i for i, *_ in numbers.told(pa.nulls(len(texts), pa.string()), pa.array(texts))} and texts.index(PLAIN) not in near
    assert [x for _, *x in numbers.told(pa.array(["a", "b 1", None]), pa.array(["c", None, "二"]))] == [["b 1", None], [None, "二"]]
    rows = [(i, PLAIN, PLAIN.upper()) for i in range(3)] + [(3, "Q1 and 5", "第一季度和5"), (4, "Q1", None), (5, None, None), (6, "5", "3")]
    df = spark.createDataFrame(rows, "id int, a string, b string").coalesce(1)
    found = df.select("id", numbers.integrity(F.col("a"), F.col("b")).alias("r"), numbers.level(F.col("a"), F.col("b")).alias("l")).orderBy("id").collect()
    assert [r.l for r in found] == [r.r.level for r in found] == ["ok", "ok", "ok", "ok", "error", "ok", "error"]
    assert found[0].r == ("ok", [], []) and found[3].r.target_values == ["number:5", "quarter:1"] and found[5].r == ("ok", [], []) and found[6].r.source_values == ["number:5"]


@pytest.mark.parametrize(
    "text, values",
    [
        ("doublethrice", ["2", "3"]),  # a line takes a word's beginning, so that its end becomes a word
        ("doubletriple", ["2", "3"]),
        ("10-15 -5, .5 and -.7%", ["-0.7", "0.5", "10", "15", "5"]),
        ("mail1@x.example, b2", ["1", "2"]),
        ("it was 5k", ["5000"]),
        ("2 millionaires", ["2000000"]),
        ("the ſixth, one-half", ["1", "2"]),
        ("onehalf and oneninth", ["1", "1", "2", "9"]),
    ],
)
def test_values_at_the_edges_of_words(text, values):
    assert sorted(x.partition(":")[2] for x in numbers.tokens(text)) == values
