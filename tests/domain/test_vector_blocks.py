"""A task of the vector search holds one block of vectors and a bounded number of scores, however many queries there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealspark.operators import annindex as I
from dealspark.operators import retrieve as S


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]  # many ties
    return spark.createDataFrame([*rows, (7, rows[7][1]), (None, rows[3][1]), (900, None)], "id long, v array<float>").localCheckpoint()


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_small_blocks_equal_all_pairs(spark, vectors, monkeypatch, metric):
    asked = vectors.where("id % 3 = 0").select(F.col("id").alias("qid"), "v").dropDuplicates(["qid"])
    want = S.top_per_group(S.scores(vectors.where("id is not null and v is not null"), asked.where("v is not null"), metric), ["qid"], [F.desc("score"), F.asc("id")], 4)
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    monkeypatch.setattr(S, "SCORES", 200)
    found = S.knn_blocks(vectors, asked, 4, metric)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # queries go to the blocks row by row: none of the tasks' input is a list of vectors
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_queries_of_an_index_are_asked_in_bounded_pieces(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FAR", 40)
    index = I.VectorIndex.build(vectors, f"file://{tmp_path}/i", 3)
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")
    found, exact = ({(r.qid, r.id) for r in df.collect()} for df in (index.search(asked, 3), S.knn(vectors, asked, 3)))
    assert len(found & exact) >= 0.8 * len(exact)
