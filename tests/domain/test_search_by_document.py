"""Postings are shuffled by document, never as pairs of query and document; small blocks give the join's results."""

import random

import pytest

from dealspark.operators import retrieve as S
from dealspark.operators.textindex import InvertedIndex


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(r.randrange(0, 40))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (7, "aa b"), (200, None), (201, "")], "doc_id long, text string").localCheckpoint()
    asked = spark.createDataFrame([(q, " ".join(r.choices("abcdefghijk", k=5))) for q in range(30)], "qid long, text string").localCheckpoint()
    return InvertedIndex.create(spark, f"file://{tmp_path_factory.mktemp('index')}/i", docs), asked


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_blocks_equal_the_join(corpus, monkeypatch, method):
    index, asked = corpus
    monkeypatch.setattr(S, "BROADCAST_TERMS", 0)
    want = sorted(map(tuple, getattr(index, method)(asked, 4).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(S, "PAIRS", 50)
    monkeypatch.setattr(S, "DOCS", 64)
    found = getattr(index, method)(asked, 4)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan and not any("hashpartitioning(qid" in x and "doc" in x.split("hashpartitioning(qid")[1][:12] for x in plan.splitlines())
