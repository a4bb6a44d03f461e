"""The first key of a long table that a text contains, against a search key by key."""

import random

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import lookup

KEYS = "place int, needle string, answer string"


def brute(text, keys):
    usable = [k for k in keys if k[1] is not None]
    found = [(place, needle, answer or "", answer) for place, needle, answer in usable if text is not None and needle in text.lower()]
    return min(found)[3] if found else None


def answers(spark, texts, keys, **kwargs):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame(keys, KEYS)
    return {r.id: r.answer for r in lookup.first_match(rows, F.col("t"), table, ["place"], **kwargs).collect()}


@pytest.mark.parametrize("characters", [lookup.CHARACTERS, 60_000])
def test_ten_thousand_keys(spark, characters):
    deal = random.Random(5)
    letters = "abcdeé 😀"
    keys = [(p, "".join(deal.choices(letters, k=deal.randint(4, 9))), f"a{p}") for p in range(10_000)]
    texts = ["".join(deal.choices(letters + "AB", k=deal.choice([0, 3, 30, 400]))) for _ in range(300)]
    assert answers(spark, texts, keys, characters=characters) == {i: brute(t, keys) for i, t in enumerate(texts)}


def test_odd_keys_and_texts(spark):
    keys = [(3, "ring", "late"), (1, "string", "early"), (2, None, "never"), (5, "ring", "later"), (4, "zz", None), (9, "x" * 500, "long")]
    texts = ["A STRING", "a ring", "strin", None, "", "zz top", "x" * 200_000, "ring", "ring"]
    for characters in (lookup.CHARACTERS, 10):
        got = answers(spark, texts, keys, characters=characters)
        assert got == {0: "early", 1: "late", 2: None, 3: None, 4: None, 5: None, 6: "long", 7: "late", 8: "late"}


def test_empty_key_and_empty_table(spark):
    assert answers(spark, ["a", "", None], [(2, "", "any"), (1, "a", "a")]) == {0: "a", 1: "any", 2: None}
    assert answers(spark, ["a", None], []) == {0: None, 1: None}
    assert answers(spark, [], [(1, "a", "a")]) == {}


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 7, 8)], "place int, needle string, _answer int, _block int")
    table = spark.createDataFrame([(1, "b", "found")], KEYS)
    got = lookup.first_match(rows, F.col("needle"), table, ["place"]).first()
    assert got.asDict() == {"place": 1, "needle": "a b", "_answer": 7, "_block": 8, "answer": "found"}
    with pytest.raises(ValueError):
        lookup.first_match(rows, F.col("needle"), table, ["place"], name="place")
