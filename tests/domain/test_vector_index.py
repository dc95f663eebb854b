"""The stored index of vectors (r12): recall, what it compares, odd rows, growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealspark.operators import annindex as I
from dealspark.operators import retrieve as S


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def asked(df):
    return df.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


@pytest.mark.parametrize("n", [300, 3000])
def test_recall_and_share_at_two_sizes(spark, tmp_path, n):
    """Unstructured vectors, the hardest for cells."""
    rng = np.random.default_rng(n)
    df = frame(spark, enumerate(rng.normal(size=(n, 32))))
    index = I.VectorIndex.build(df, f"file://{tmp_path}/i", 5)
    found, exact = pairs(index.search(asked(df), 5)), pairs(S.knn(df, asked(df), 5))
    assert len(found & exact) >= 0.9 * len(exact)
    assert index.compared < 0.05 * n and 0.5 * n**0.5 < len(index.model.lower) < 2 * n**0.5


def test_scores_are_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = frame(spark, enumerate(rng.normal(size=(400, 10))))
    found = I.VectorIndex.build(df, f"file://{tmp_path}/i", 3).search(asked(df), 3)
    exact = {(r.qid, r.id): r.score for r in S.knn(df, asked(df), 400).collect()}
    rows = found.collect()
    assert len(rows) == 60 and all(exact[r.qid, r.id] == r.score for r in rows)
    for q in {r.qid for r in rows}:
        own = sorted((r for r in rows if r.qid == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3] and own == sorted(own, key=lambda r: (-r.score, r.id))


def test_loaded_and_added(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(600, 16))
    old, new = frame(spark, enumerate(m[:400])), frame(spark, ((i + 400, v) for i, v in enumerate(m[400:])))
    path = f"file://{tmp_path}/i"
    I.VectorIndex.build(old, path, 5)
    index = I.VectorIndex.load(spark, path)
    assert index.n == 400 and not index.outgrown()
    index.add(new)
    index = I.VectorIndex.load(spark, path)
    both = old.unionByName(new)
    found, exact = pairs(index.search(asked(both), 5)), pairs(S.knn(both, asked(both), 5))
    assert index.n == 600 and any(i >= 400 for _, i in found) and len(found & exact) >= 0.8 * len(exact)
    index.n = 10**6
    assert index.outgrown()


def test_crowded_cell_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    rows = [(i, one) for i in range(120)] + [(1000 + i, v) for i, v in enumerate(rng.normal(size=(200, 8)))]
    index = I.VectorIndex.build(frame(spark, rows), f"file://{tmp_path}/i", 5)
    sizes = [r["n"] for r in spark.read.parquet(f"{index.path}/blocks").select(F.size("ids").alias("n")).collect()]
    assert max(sizes) <= 16 and sum(sizes) == 320
    hits = {r.qid: r.score for r in index.search(frame(spark, rows[:1]).select(F.col("id").alias("qid"), "v"), 5).collect()}
    assert hits == {0: 1.0}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [0.0, 0.0])], [(1, [1.0, 0.0])], [(i, [1.0, float(i)]) for i in range(3)]])
def test_few_or_no_vectors(spark, tmp_path, rows):
    df = frame(spark, rows)
    index = I.VectorIndex.build(df, f"file://{tmp_path}/i", 2)
    usable = [i for i, v in rows if v and any(v)]
    found = pairs(index.search(df.select(F.col("id").alias("qid"), "v"), 2))
    assert found == {(q, i) for q in usable for i in usable if i != q}


def test_ragged_and_odd_rows_stay_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [*enumerate(rng.normal(size=(100, 6))), (200, [1.0] * 5), (201, [1.0] * 7), (202, [float("nan")] * 6), (203, [0.0] * 6), (None, [1.0] * 6), (204, None)]
    df = frame(spark, rows).withColumn("extra", F.lit(1))
    index = I.VectorIndex.build(df, f"file://{tmp_path}/i", 5)
    found = pairs(index.search(df.select(F.col("id").alias("qid"), "v", F.lit(1).alias("cell")), 5))
    assert index.n == 100 and {q for q, _ in found} == set(range(100)) and {i for _, i in found} <= set(range(100))
