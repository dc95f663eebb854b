"""mentions are found in the different pieces of texts; no text is copied by its grams."""

from dealspark.operators import relational as R


def test_counts_equal_a_contains_join(spark, monkeypatch):
    names = spark.createDataFrame([(n,) for n in ("the", "he", "Then", "x-1", "😀", "", None, "absent", "the", "]^\\")], "word string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["The other", "then x-1, x-12", "THE OTHER", "the other", "the other", "", None, "ok😀 ]^\\ they"])], "id long, body string")
    want = sorted((n, sum(n.lower() in (t["body"] or "").lower() for t in texts.collect())) for n in [r.word for r in names.collect()] if n)
    for most in (R.LETTERS, 3):  # beyond it texts aren't cut
        monkeypatch.setattr(R, "LETTERS", most)
        assert sorted(map(tuple, R.mention_counts(names, "word", texts, "body").collect())) == [w for w in want if w[1]]
        pairs = R.mention_join(names, "word", texts, "body").collect()
        assert sorted((n, sum(r.word == n for r in pairs)) for n in {r.word for r in pairs}) == sorted({(n, k * (2 if n == "the" else 1)) for n, k in want if k})


def test_texts_are_not_shuffled_by_their_grams(spark):
    names = spark.createDataFrame([("there",), ("other",)], "word string")
    texts = spark.range(3).selectExpr("id", "'there are others' as body")
    plan = R.mention_counts(names, "word", texts, "body")._jdf.queryExecution().executedPlan().toString()
    grams = [x for x in plan.splitlines() if "Generate explode(flatten(" in x]
    assert grams and all("_piece" in x and "_low" not in x.split("Generate")[1].split("[_gram")[0] for x in grams)
