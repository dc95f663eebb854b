"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets. A lower bound of each query's k-th score comes from the bucket of the
longest vectors. With it every (query block, bucket) pair gets a local cosine threshold per query: above 1 the bucket is
skipped; a high threshold prunes by the query's largest coordinate, a lower one by length; what is left is multiplied out.
Vectors that are null or hold null, NaN or infinite components take no part; shorter ones count as padded with zeros. Ties
go to the smaller vec_id. Repeated rows each count as candidates; rows of one query's vec_id are one query, their hits merged. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import materialise

#: Rows of a bucket and of a query block: bounds on what one task holds.
BUCKET_ROWS, QUERY_ROWS = 8192, 512
#: Query blocks whose best hits a task holds at once.
HELD_BLOCKS = 64
#: From this local cosine on, pruning by coordinate is tried.
COORDINATE_FROM = 0.7


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _pack(pdf_rows: int):
    """Packs runs of rows of a partition into blocks: ids, and the vectors as one matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pd.DataFrame, seq: int) -> pd.DataFrame:
            dims = max(map(len, rows["v"]), default=0)
            matrix = np.zeros((len(rows), max(1, dims)), np.int64)
            for i, v in enumerate(rows["v"]):
                matrix[i, : len(v)] = v
            lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
            order = np.argsort(-lengths, kind="stable")
            return pd.DataFrame({"block": [(part << 32) + seq], "longest": [float(lengths.max())], "dims": [matrix.shape[1]], "n": [len(rows)], "ids": [rows["vec_id"].to_numpy(np.int64)[order].tobytes()], "matrix": [matrix[order].tobytes()]})

        size = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                take = batch.iloc[at : at + pdf_rows - size]
                held.append(take)
                size += len(take)
                at += len(take)
                if size == pdf_rows:
                    yield block(pd.concat(held), seq)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield block(pd.concat(held), seq)

    return run


BLOCK = "block long, longest double, dims int, n int, ids binary, matrix binary"


def _unpack(ids: bytes, matrix: bytes, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(matrix, np.int64).reshape(-1, dims)
    if width > dims:
        m = np.hstack([m, np.zeros((len(m), width - dims), np.int64)])
    return np.frombuffer(ids, np.int64), m


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: through BLAS while doubles hold them exactly, else in int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score falling, then id rising."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_block(qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, vids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of one bucket for each query, leaving out what can't reach the query's bound (NaN: none known)."""
    found: list[tuple[int, int, int]] = []
    qlen = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    vlen = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    longest = vlen.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounds > 0, bounds / (qlen * longest), -1.0)
    local = np.where(np.isnan(bounds), -1.0, local)
    live = ~(local > 1 + 1e-9)
    by_coordinate = live & (local >= COORDINATE_FROM)

    def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = vids[at] != qids[i]
        if not np.isnan(bounds[i]):
            ok &= scores >= bounds[i]
        at, scores = at[ok], scores[ok]
        for p in _best(vids[at], scores, k):
            found.append((int(qids[i]), int(vids[at[p]]), int(scores[p])))

    if by_coordinate.any():
        unit = v / np.maximum(vlen, 1e-300)[:, None]
        for i in np.flatnonzero(by_coordinate):
            direction = q[i] / qlen[i]
            f = int(np.abs(direction).argmax())
            t, c = min(local[i], 1.0), direction[f]
            slack = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-6
            # vectors shorter than the bucket's longest need a larger cosine still, so this range holds for all of them
            low, high = t * c - slack, t * c + slack
            if c >= t:
                high = 1.0
            if -c >= t:
                low = -1.0
            at = np.flatnonzero((unit[:, f] >= low) & (unit[:, f] <= high) & (vlen * qlen[i] >= bounds[i] * (1 - 1e-9)))
            keep(i, at, _products(q[i : i + 1], v[at])[0])
    rest = np.flatnonzero(live & ~by_coordinate)
    if len(rest):
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where((bounds[rest] > 0) & (qlen[rest] > 0), bounds[rest] / qlen[rest] * (1 - 1e-9), -1.0)
        shortest = np.where(np.isnan(shortest), -1.0, shortest)
        prefix = np.searchsorted(-vlen, -shortest, "right")
        scores = _products(q[rest], v[: prefix.max(initial=0)])
        for row, i in enumerate(rest):
            keep(i, np.arange(prefix[row]), scores[row, : prefix[row]])
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors, queries: vec_id long, v array<long>. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = vectors.withColumn("l", -length)
    buckets = materialise(ordered.repartitionByRange(parts, "l").sortWithinPartitions("l", "vec_id").select("vec_id", "v").mapInPandas(_pack(BUCKET_ROWS), BLOCK))
    blocks = materialise(queries.repartition(parts).mapInPandas(_pack(QUERY_ROWS), BLOCK))
    first = buckets.orderBy(F.desc("longest"), "block").limit(1)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                width = max(r.dims, r.vdims)
                qids, q = _unpack(r.ids, r.matrix, r.dims, width)
                vids, v = _unpack(r.vids, r.vmatrix, r.vdims, width)
                scores = _products(q, v)
                own = qids[:, None] == vids[None, :]
                low = np.full(len(qids), np.nan)
                enough = (~own).sum(axis=1) >= k
                for i in np.flatnonzero(enough):
                    s = scores[i][~own[i]]
                    low[i] = np.partition(s, len(s) - k)[len(s) - k]
                # the shortest vector that can reach some query's bound
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(low > 0, low / np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), 0.0)
                yield pd.DataFrame({"block": [r.block], "bounds": [low.tobytes()], "shortest": [float(np.nan_to_num(least, nan=0.0).min()) * (1 - 1e-9)]})

    named = first.select(F.col("dims").alias("vdims"), F.col("ids").alias("vids"), F.col("matrix").alias("vmatrix"), F.lit(0).alias("on"))
    # one bucket row (at most BUCKET_ROWS vectors) meets every query block
    bounded = materialise(blocks.withColumn("on", F.lit(0)).join(F.broadcast(named), "on").mapInPandas(bound, "block long, bounds binary, shortest double"))

    # which (query block, bucket) pairs can hold a hit: by numbers alone, before any vector is shipped
    reach = buckets.select(F.col("block").alias("target"), "longest")
    pairs = bounded.select("block", "shortest").join(reach, F.col("longest") >= F.col("shortest")).select("block", "target")
    targets = buckets.select(F.col("block").alias("target"), F.col("dims").alias("vdims"), F.col("ids").alias("vids"), F.col("matrix").alias("vmatrix"))
    asked = pairs.join(blocks.select("block", "dims", "ids", "matrix"), "block").join(bounded.select("block", "bounds"), "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Keeps the k best of every query over the buckets of a task; of many query blocks, some at a time."""
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for r in batch.itertuples():
                width = max(r.dims, r.vdims)
                qids, q = _unpack(r.ids, r.matrix, r.dims, width)
                vids, v = _unpack(r.vids, r.vmatrix, r.vdims, width)
                found = search_block(qids, q, np.frombuffer(r.bounds, np.float64), vids, v, k)
                hits = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
                hits = pd.concat([best.get(r.block, hits.iloc[:0]), hits]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                best[r.block] = hits[hits.groupby("query_id").cumcount() < k]
                if len(best) > HELD_BLOCKS:
                    yield pd.concat(best.values())
                    best = {}
        if best:
            yield pd.concat(best.values())

    hits = asked.join(targets, "target").mapInPandas(search, "query_id long, vec_id long, score long")
    best = hits.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op6(embeddings: DataFrame, k: int = 20) -> DataFrame:
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k)
