"""The folded chunker, the table function, lexicon tables, vector means and models as columns."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealspark.functions.pluggable import verdict
from dealspark.operators import chunking as K
from dealspark.operators import classify as C
from dealspark.operators import lexicon as LX
from dealspark.operators import retrieve as S
from dealspark.plans import composite, registry, retrieval, text  # noqa: F401  they register their queries


def random_texts(n: int, most: int) -> list:
    r = random.Random(3)
    return [None, "", "x" * 40, "x" * 51, "a. " * 400, "." * 3000, "é\U0001f600 b! c?\n" * 700, "  \t" * 300 + "word. " * 90] + ["".join(r.choice("abcdefg    .!?\né\U0001f600") for _ in range(r.randrange(1, most))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"overlap": 300}, {"size": 200, "overlap": 20, "least": 1}, {"size": 60, "overlap": 100, "least": 5}, {"size": 2, "overlap": 1, "least": 1}])
def test_folded_chunks_equal_the_loop(spark, options):
    texts = random_texts(25, 12_000 if options.get("size", 500) > 2 else 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.chunk_id, r.start, r.text) for r in K.sliding_chunks(df, **options).collect())
    assert got == [(i, n, f"chunk_{n:04d}", s, t) for i, x in enumerate(texts) for n, (s, t) in enumerate(K.sliding(x or "", **options))]


def test_folded_chunks_stay_in_the_jvm_and_tell_pages(spark, capsys):
    df = spark.createDataFrame([(1, "Plain words. " * 200, 4), (2, "Plain words. " * 50, None), (3, "Plain words. " * 50, 0)], "doc_id long, text string, pages long")
    chunks = K.sliding_chunks(df.withColumn("pos", F.lit("clash")), pages=F.col("pages"))
    chunks.explain()
    assert "Python" not in (out := capsys.readouterr().out) and "Arrow" not in out
    rows = chunks.collect()
    assert {r.page for r in rows if r.doc_id > 1} == {1}
    assert [(r.start, r.page) for r in rows if r.doc_id == 1] == [(r.start, min(int(r.start / (2600 / 4)) + 1, 4)) for r in rows if r.doc_id == 1]
    assert {r.page for r in rows if r.doc_id == 1} == {1, 2, 3, 4}


def test_table_function_of_every_kind(spark, sf):
    docs = registry.table(spark, sf, "documents")
    got = registry.QUERIES["g03_chunks_of_every_kind"](spark, sf).collect()
    for kind in K.KINDS:
        want = sorted((r.doc_id, r.pos, r.start, r.text) for r in K.chunk(docs, kind).collect())
        assert sorted((r.doc_id, r.pos, r.start, r.chunk) for r in got if r.kind == kind) == want
    rows = spark.sql("select * from chunk_text('Some words here.', 'token_budget')")
    assert rows.columns == ["pos", "start", "chunk", "tokens"] and rows.first()["tokens"] == 3
    assert spark.sql("select * from chunk_text(null, 'sentences')").count() == 0
    with pytest.raises(Exception, match="the kind is one of"):
        spark.sql("select * from chunk_text('x', 'pages')").collect()


def by_hand(texts, rows):
    """(document, category): hits, occurrences, score, with plain loops."""
    out = {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        low = t.lower()
        words = re.findall(r"[^\W_](?:[^\W_]|')*|'(?:[^\W_]|')*", low)
        for c, _, term, weight, kind in rows:
            if not term:
                continue
            want = term.lower().split()
            n = low.count(term.lower()) if kind == "substring" else len(re.findall(term, low)) if kind == "regex" else sum(words[j : j + len(want)] == want for j in range(len(words)))
            if n:
                h, o, s = out.get((i, c), (0, 0, 0.0))
                out[i, c] = (h + 1, o + n, round(s + n * (weight or 0.0), 6))
    return out


ROWS = [
    ("money", 2, "fund", 0.5, "substring"), ("money", 2, "fund", 0.5, "substring"), ("money", 2, "aa", 0.25, "substring"), ("money", 2, "Term Sheet", 2.0, "word"), ("people", 1, "don't know", 1.5, "word"),
    ("people", 1, "a a", 1.0, "word"), ("risk", 3, "burn.*high", -1.0, "regex"), ("risk", 3, "é", None, "substring"), ("none", 0, "", 1.0, "substring"), ("none", 0, None, 1.0, "word"),
]
TEXTS = ["Funding a fund: refund", "aaaaa", "TERM sheet, term-sheet; termsheet", "we don't know; don't  know", "a a a", "burn is high\nburn rate high", "été", "", None, "nothing"]


@pytest.mark.parametrize("limit", [LX.LIMIT, 0])
def test_lexicon_of_any_kind(spark, limit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("term", F.lit("clash"))
    lexicon = spark.createDataFrame(ROWS, LX.LEXICON)
    want = by_hand(TEXTS, ROWS)
    got = {(r.id, r.category): (r.hits, r.occurrences, r.score) for r in LX.score(df, "id", "text", lexicon, limit=limit).collect()}
    assert got == want and got[0, "money"] == (2, 6, 3.0) and got[1, "money"] == (1, 2, 0.5) and got[4, "people"] == (1, 2, 2.0)
    assert {(r.id, r.category) for r in LX.score(df, "id", "text", lexicon, "any", limit=limit).collect()} == set(want)


def test_lexicon_classes_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "y z z"), (3, None), (4, "q"), (5, "x"), (5, "y y"), (None, "z")], "id long, text string")
    lexicon = spark.createDataFrame(LX.table_of([("one", ["x"]), ("two", ["y"]), ("three", ["z", "zz", "z z"])]), LX.LEXICON)
    say = lambda mode, **o: {r.id: r.category for r in LX.score(df, "id", "text", lexicon, mode, **o).collect()}
    assert say("first_class") == {1: "one", 2: "two", 3: None, 4: None, 5: "one", None: "three"}
    assert say("argmax", none="general") == {1: "one", 2: "three", 3: "general", 4: "general", 5: "one", None: "three"}
    assert say("argmax", none="unknown", tie="unknown") == {1: "unknown", 2: "three", 3: "unknown", 4: "unknown", 5: "unknown", None: "three"}
    assert LX.score(df, "id", "text", lexicon.limit(0)).count() == 0 and LX.score(df.limit(0), "id", "text", lexicon, "argmax").count() == 0
    assert {r.category for r in LX.score(df, "id", "text", lexicon.limit(0), "first_class", none="none").collect()} == {"none"}
    with pytest.raises(ValueError, match="unknown kinds"):
        LX.score(df, "id", "text", lexicon.withColumn("kind", F.lit("glob")))


def test_vector_mean(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", [9.0]), ("a", None), ("a", [None, 1.0]), ("b", [5.0, 5.0, 5.0]), ("c", None), ("d", [1.0]), ("d", [2.0, 3.0])]
    got = {r.label: list(r.v) for r in S.mean_vector(spark.createDataFrame(rows, "label string, v array<float>"), ["label"]).collect()}
    assert got == {"a": [2.0, 4.0], "b": [5.0, 5.0, 5.0], "d": [1.0]}


def test_model_is_loaded_once_a_task(spark):
    def load():
        from uuid import uuid4

        mark = str(uuid4())
        return lambda texts: pd.Series([mark] * len(texts))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        marks = spark.range(0, 400, 1, 2).select(verdict(load, "string")(F.col("id").cast("string")).alias("m")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert marks == 2


@pytest.mark.parametrize("limit", [10, 1])
def test_lexicon_join_never_broadcasts_the_words(spark, tmp_path, monkeypatch, limit):
    """a small file of many words was broadcast through the driver."""
    monkeypatch.setattr(C, "LEXICON_ROWS", limit)
    spark.createDataFrame([(1, "Growth and growth, debt"), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    lexicon = spark.createDataFrame([("up", "growth", 0.5), ("up", "and", 0.25), ("down", "debt", -1.0)], "category string, term string, weight double")
    found = C.score_lexicon(spark.read.parquet(f"{tmp_path}/docs"), "text", "doc_id", lexicon)
    assert sorted(map(tuple, found.collect())) == [(1, "down", 1, 1, -1.0), (1, "up", 2, 3, 1.25)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (limit == 10)
