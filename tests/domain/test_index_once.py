"""The stored index cuts a text into words once: its lengths are what its postings say."""

from pyspark.sql import functions as F

from dealspark.operators.textindex import InvertedIndex


def test_lengths_lie_with_the_postings(spark, tmp_path):
    rows = [(1, "Revenue grew, revenue"), (2, "x"), (2, "y y"), (2, None), (3, ""), (4, None), (None, "no key"), (5, "1 2, 3"), (6, "ıİ ß é́a")]
    index = InvertedIndex.create(spark, f"file://{tmp_path}/i", spark.createDataFrame(rows, "doc_id long, text string"))
    held = spark.read.parquet(f"{index.path}/postings").where("bucket = -1")
    assert {(r.doc, r.length) for r in held.collect()} == {(r.doc, r.n) for r in index.lengths().collect()}
    assert {(1, 3), (2, 3), (3, 0), (4, None), (5, 0)} < {(r.doc, r.length) for r in held.collect()}
    every = index.view().postings
    assert every.where("term is null or term = ''").count() == 0
    assert {(r.doc, r.n) for r in every.groupBy("doc").agg(F.sum("tf").alias("n")).collect()} == {(r.doc, r.length) for r in held.collect() if r.length}
