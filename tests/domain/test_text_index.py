"""The stored inverted index: equal to indexing anew after additions, replacements and removals; buckets pruned."""

import re

import pytest
from pyspark.sql import functions as F

from dealspark.operators import retrieve as S
from dealspark.operators.textindex import InvertedIndex, bucket

DOCS = "doc_id long, text string"
FIRST = [(1, "Revenue grew, revenue doubled"), (2, "growth of the market"), (3, ""), (4, None), (5, "été à la plage"), (None, "no key")]
QUERIES = [(1, "revenue market"), (2, "growth growth plage"), (3, "absent"), (4, None)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def check(spark, index, docs):
    """Every table and both searches as of documents indexed from nothing."""
    df = spark.createDataFrame([d for d in docs if d[0] is not None], DOCS)
    asked = spark.createDataFrame(QUERIES, "qid long, text string")
    fresh, view = S.TextIndex(df, "doc_id", "text"), index.view()
    assert rows(view.postings.select("doc", "term", "tf", "length")) == rows(fresh.postings.select("doc", "term", "tf", "length"))
    assert rows(view.df) == rows(fresh.df)
    assert [(r.N, r.avgdl) for r in view.stats.collect()] == [(r.N, r.avgdl) for r in fresh.stats.collect()]
    words = {i: None if t is None else len(re.findall(r"[^\W\d_]+", t)) for i, t in docs if i is not None}
    assert {r.doc: r.n for r in index.lengths().collect()} == words
    for found, plain in ((index.bm25(asked, 3), S.bm25(df, "doc_id", "text", asked, 3)), (index.tfidf(asked, 3), S.tfidf(df, "doc_id", "text", asked, 3))):
        assert rows(found) == rows(plain)


@pytest.fixture()
def index(spark, tmp_path):
    return InvertedIndex.create(spark, f"file://{tmp_path}/index", spark.createDataFrame(FIRST, DOCS).withColumn("term", F.lit("x")))


def test_built(spark, index):
    check(spark, index, FIRST)


def test_added_replaced_removed_and_opened_again(spark, index):
    more = [(6, "market share"), (2, "now about revenue"), (3, "filled later")]
    index.add(spark.createDataFrame(more, DOCS))
    now = [FIRST[0], FIRST[3], FIRST[4], *more]
    check(spark, index, now)
    index = InvertedIndex(spark, index.path)
    index.remove(spark.createDataFrame([(1,), (4,), (99,), (None,)], "doc_id long"))
    now = [d for d in now if d[0] not in (1, 4)]
    check(spark, index, now)
    index.add(spark.createDataFrame([(1, "back again")], DOCS))
    check(spark, index, [*now, (1, "back again")])


def test_change_without_manifest_is_not_read(spark, index):
    epoch = max(index._epochs()) + 1
    index._write(spark.createDataFrame([(7, "lost", 1)], "N long, x string, total long").selectExpr("N", "N as sized", "total"), "stats", epoch)
    check(spark, index, FIRST)
    index.add(spark.createDataFrame([(8, "after it")], DOCS))
    check(spark, index, [*FIRST, (8, "after it")])


def test_searches_read_their_buckets_alone(spark, index):
    asked = spark.createDataFrame([(1, "revenue")], "qid long, text string")
    terms = S.query_terms(asked, "text")
    plan = index.view(terms, 1).postings._jdf.queryExecution().executedPlan().toString()
    one = spark.range(1).select(bucket(F.lit("revenue"))).first()[0]
    assert f"= {one})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_no_documents(spark, tmp_path):
    index = InvertedIndex.create(spark, f"file://{tmp_path}/none", spark.createDataFrame([], DOCS))
    assert index.view().postings.count() == index.bm25(spark.createDataFrame(QUERIES, "qid long, text string"), 3).count() == 0
    index.add(spark.createDataFrame(FIRST, DOCS))
    check(spark, index, FIRST)
