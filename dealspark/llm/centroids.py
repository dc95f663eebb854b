"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors of whole numbers are put in the order of a Hilbert curve (a few bits of every component), cut into blocks, and
each block is written with its zone map: the least and greatest value of every component and their sum. A round compares
a block's box with the centroids: c cannot win in the block where, for every point of the box, the squared distance to
the centroid nearest the box's middle is smaller. Where one candidate is left the block's sum goes to it unread; the
others are compared exactly, vector by vector, with the candidates alone. A round ends with one row per centroid and
component, all that reaches the driver. Vectors are shuffled once, for the order; rounds shuffle sums only.

Arithmetic is exact: in 64-bit whole numbers, or in doubles where all products stay under 2**53. Components whose scaled value
is 2**26 or more raise an error, as does a sum beyond long.

Ties go to the smaller centroid. Vectors that are null, have another number of components, or hold null or non-finite ones take no part.
Each repeated row counts as a vector of its own and gets a row; equal rows that compete to be first centroids go by their
components. A null vec_id is hashed as the empty string. With fewer vectors than centroids there are as many centroids as
vectors; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import discard, materialise

CLUSTERS, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: Vectors of a block, and bits of a component in the Hilbert order.
BLOCK_ROWS, BITS = 512, 3
#: Components stay under this size, so that squared distances and box bounds fit into 64 bits.
LARGEST = 1 << 26
#: Under this size products of up to 64 components are exact in doubles.
_DOUBLES = 1 << 22


def usable(vector: Column, dims: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of whole numbers): the vectors that take part."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST, y).otherwise(F.raise_error(F.lit(f"components of {LARGEST // scale} and more are too large"))).cast("int")

    kept = vectors.where(usable(F.col("embedding"), dims))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows of cells, each 0 to 2**bits - 1), as rows of bytes in that order.
    The axes are turned to the transposed index in place, all points at once (Skilling, 2004)."""
    x = cells.astype(np.uint32).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
    np.bitwise_xor.accumulate(x, axis=1, out=x)
    turn = np.zeros(n, np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1, np.uint32((1 << b) - 1), np.uint32(0)).astype(np.uint32)
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64)


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("matrix", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("total", pa.binary())])


def blocks(vectors: DataFrame, block_rows: int | None = None, bits: int = BITS) -> DataFrame:
    """vec_id, v. Blocks in Hilbert order: ids, vectors, and the zone map. Cells are 2**bits steps of half a standard deviation
    around the mean of all components (both ends open), so outliers do not press all others into one cell."""
    spark, block_rows = vectors.sparkSession, block_rows or BLOCK_ROWS
    values = F.transform("v", lambda x: x.cast("double"))
    add = lambda of: F.sum(F.aggregate(F.transform(values, of), F.lit(0.0), lambda a, b: a + b))
    n, total, squares = vectors.agg(F.sum(F.size("v")), add(lambda x: x), add(lambda x: x * x)).first()
    if not n:
        return spark.createDataFrame([], "ids array<long>, matrix binary, low binary, high binary, total binary")
    mean = total / n
    step = max(np.sqrt(max(squares / n - mean * mean, 0.0)) / 2, 1e-9)
    keyed_schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("key", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.clip((_matrix(batch.column("v"), batch.num_rows) - mean) // step + (1 << bits - 1), 0, (1 << bits) - 1)
                keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v").cast(pa.list_(pa.int32())), pa.array(keys, pa.binary())], schema=keyed_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block_rows - size))
                size += held[-1].num_rows
                at += held[-1].num_rows
                if size == block_rows:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        m = _matrix(table.column("v").chunk(0), table.num_rows).astype("<i4")
        ids = table.column("vec_id").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([ids], [m.tobytes()], [m.min(0).tobytes()], [m.max(0).tobytes()], [m.sum(0, dtype="<i8").tobytes()]), _BLOCK, strict=True)], schema=_BLOCK)

    rows = vectors.mapInArrow(keyed, "vec_id long, v array<int>, key binary")
    # equal vectors, however many, are dealt on by where they were read
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place")
    return ordered.select("vec_id", "v").mapInArrow(cut, "ids array<long>, matrix binary, low binary, high binary, total binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box: all but those that a pivot, the one nearest
    the middle, beats at every corner. |x - p|^2 - |x - c|^2 is linear in x: its greatest value over the box decides."""
    twice = low + high - 2 * centroids  # of the middle, doubled
    pivot = centroids[np.argmin((twice * twice).sum(1))]
    slope = 2 * (centroids - pivot)
    greatest = np.maximum(slope * low, slope * high).sum(1) + int((pivot * pivot).sum()) - (centroids * centroids).sum(1)
    return np.flatnonzero(greatest >= 0)


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (the first of equals) and the squared distance, exactly."""
    if max(np.abs(m).max(initial=0), np.abs(centroids).max(initial=0)) < _DOUBLES:
        products = np.rint(m.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        products = m @ centroids.T
    distance = (m * m).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)
    found = distance.argmin(1)
    return found, distance[np.arange(len(m)), found]


def _of(raw: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.int64)


def sums(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of every centroid that wins vectors their number and sum: {number: (n, components)}."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for size, matrix, low, high, whole in zip(*(batch.column(c).to_pylist() for c in ("n", "matrix", "low", "high", "total")), strict=True):
                few = candidates(_of(low), _of(high), centroids)
                if len(few) == 1:
                    n[few[0]] += size
                    total[few[0]] += _of(whole, "<i8")
                    continue
                m = _of(matrix).reshape(size, dims)
                own = few[nearest(m, centroids[few])[0]]
                n += np.bincount(own, minlength=k)
                for c in np.unique(own):
                    total[c] += m[own == c].sum(0)
        won = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip((np.repeat(won, dims), np.tile(np.arange(dims), len(won)), total[won].ravel(), np.repeat(n[won], dims)), schema, strict=True)], schema=schema)

    parts = zones.select(F.size("ids").alias("n"), "matrix", "low", "high", "total").mapInArrow(run, "cluster int, dim int, total long, n long")
    found: dict[int, tuple[int, list[int]]] = {}
    # clusters x components rows, whatever the table
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("cluster", "dim").collect():
        found.setdefault(r["cluster"], (r["n"], []))[1].append(r["total"])
    return found


def assign(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dims = centroids.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix, low, high in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("matrix", "low", "high")), strict=True):
                few = candidates(_of(low), _of(high), centroids)
                own, distance = nearest(_of(matrix).reshape(-1, dims), centroids[few])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(few[own], pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return zones.select("ids", "matrix", "low", "high").mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose hashed ids come first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v (whole numbers, one length). Returns (vec_id, cluster, distance) of every vector and the centroids."""
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    zones = materialise(blocks(vectors))
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in sums(zones, centroids).items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    found = materialise(assign(zones, centroids))
    discard(zones)
    return found, centroids


def op11(embeddings: DataFrame) -> DataFrame:
    found, centroids = cluster(scaled(embeddings))
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    named = [(c, i, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, i in inertia.items()]
    # one row per centroid
    table = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
