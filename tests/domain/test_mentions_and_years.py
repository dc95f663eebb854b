"""Mentions anywhere in a text against a plain contains join; years and amounts in either order."""

import random

import pytest

from dealspark.operators import classify as C
from dealspark.operators import relational as R


@pytest.mark.parametrize("broadcast", [True, False])
def test_mentions_equal_a_contains_join(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(R, "BROADCAST_NAMES", -1)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    names = ["acme", "Acme", "Acme", "a", "é", "ab c", "", None, "a.c", "x(y", "zzzzz", "😀", "\n"] + [word(rng.randrange(1, 9)) for _ in range(60)]
    texts = [(i, t) for i, t in enumerate(["superacme", "ACME inc", "", None, "a.c x(y", "😀 ok\nline", "superacme"] + [word(rng.randrange(0, 60)) for _ in range(120)])]
    got = R.mention_join(spark.createDataFrame([(n, "k") for n in names], "name string, _x string"), "name", spark.createDataFrame(texts, "id long, body string"), "body")
    want = sorted((n, i) for n in names if n for i, t in texts if t is not None and n.lower() in t.lower())
    assert sorted((r["name"], r.id) for r in got.collect()) == want
    assert got.columns == ["name", "_x", "id", "body"]


def test_no_names_or_texts(spark):
    names, texts = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([(1, "a")], "id long, body string")
    assert R.mention_join(names.limit(0), "name", texts, "body").count() == R.mention_join(names, "name", texts.limit(0), "body").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Revenue was $5M in 2023 and $9M in 2024", {"2023": 5e6, "2024": 9e6}), ("2023: $5M, 2024 - 9,000,000", {"2023": 5e6, "2024": 9e6}), ("2023 $5M 2024 $9M", {"2023": 5e6, "2024": 9e6}),
        ("In 2022: $1M, then $5M in 2023, and 2024 = 3 crore", {"2022": 1e6, "2023": 5e6, "2024": 3e7}), ("$47M Year 1, $110M Year 2", {"year 1": 4.7e7, "year 2": 1.1e8}), ("Year 1: $47M, 2nd year: $1.5B", {"year 1": 4.7e7, "year 2": 1.5e9}),
        ("₹5 lakh for FY 2021 (2022: ₹7 lakh)", {"2021": 5e5, "2022": 7e5}), ("10,000,000 - 2024", {"2024": 1e7}), ("2023: $5M and again 2023: $6M", {"2023": 5e6}), ("$2 million by the end; $3 million (2025)", {"2025": 3e6}),
        ("Year 0: $5M, Year 21: $5M, 1999: $5M, 2101: $5M, 2100: $5M", {"2100": 5e6}), ("40 people in 2023", {}), ("2024 was quiet", {}), ("2023: $0", {}), ("", {}), (None, {}),
    ],
)
def test_year_revenues(spark, text, want):
    got = C.year_revenues(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    assert {r.yr: r.revenue for r in got} == want
