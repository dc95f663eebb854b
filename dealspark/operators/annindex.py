"""r12: a stored index for approximate nearest neighbours by cosine, which grows with its table.

Cells are the leaves of a tree of two levels, about n ** 0.25 branches each, so about sqrt(n) cells: the upper centres are
fitted on a bounded sample, the lower ones of every branch by a task of its own on a bounded sample of that branch. Every
vector is filed under its cell with the product-quantised residual to the cell's centre (one byte for each few components),
in blocks of a bounded number of rows, a crowded cell in several. A query scans the codes of the cells nearest to it and compares
the best of them exactly. How many cells and how many exact comparisons follows from a recall target, measured on
sampled vectors against exact search when the index is built.

Rows whose id or vector is null, of no length, or of another length than most take no part. Repeated ids are filed each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspark.functions import vectors as V
from dealspark.operators.relational import top_per_group
from dealspark.operators.retrieve import knn_blocks

#: Bounds on what is sampled: rows for the upper centres and the code books, rows for each lower centre, calibration queries.
SAMPLE_ROWS, ROWS_PER_CELL, CALIBRATION = 8192, 64, 128
#: Components that share a byte, values of that byte, rows of a block, queries of a block.
PART, BOOK, BLOCK_ROWS, QUERY_ROWS = 2, 256, 4096, 512
#: Candidates that a scanning task holds before it keeps the best of each query alone; distances or cells of queries that a task holds at once.
HELD, FAR = 1 << 20, 1 << 20
#: Share of the table that may be compared exactly, and a bound on that number at any size.
SHARE, MOST = 0.04, 512


def kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of plain k-means; of fewer rows than k all are centres."""
    rng = np.random.default_rng(seed)
    if len(rows) <= k:
        return rows.copy()
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n)])[:-1][filled]
        centres[filled] = np.add.reduceat(rows[order], starts, axis=0) / n[filled, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (rows @ centres.T)).argmin(1)


@dataclass
class Model:
    """upper: branches; lower: all cells' centres, those of branch b from first[b] to first[b + 1]; books: per part of the
    components its values."""

    upper: np.ndarray
    lower: np.ndarray
    first: np.ndarray
    books: np.ndarray

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest of the nearest branch."""
        branch, out = nearest(rows, self.upper), np.zeros(len(rows), np.int32)
        for b in np.unique(branch):
            at = np.flatnonzero(branch == b)
            out[at] = self.first[b] + nearest(rows[at], self.lower[self.first[b] : self.first[b + 1]])
        return out

    def residuals(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Differences to the cells' centres, by parts of PART components, the last filled with zeros."""
        rest = rows - self.lower[cells]
        wide = np.zeros((len(rest), len(self.books) * PART))
        wide[:, : rest.shape[1]] = rest
        return wide.reshape(len(rest), len(self.books), PART)

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts = self.residuals(rows, cells)
        return np.stack([nearest(parts[:, p], self.books[p]) for p in range(len(self.books))], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        parts = self.books[np.arange(len(self.books))[None], codes]
        return self.lower[cell] + parts.reshape(len(codes), -1)[:, : self.lower.shape[1]]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(df: DataFrame, key: str, dims: int | None = None) -> DataFrame:
    """Unit vectors of one length."""
    kept = df.where(F.col(key).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select(F.col(key).cast("long").alias(key), F.col("v").cast("array<double>").alias("v"))
    kept = kept if dims is None else kept.where(F.size("v") == dims)
    return kept.where(V.norm(F.col("v")) > 0).select(key, V.normalise(F.col("v")).alias("v"))


def _share(key: str, share: float) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 11) < F.lit(min(1.0, share) * float(1 << 53))


def _fit(units: DataFrame, n: int, seed: int) -> Model:
    branches = max(1, round(n**0.25))
    sample = np.array([r["v"] for r in units.where(_share("id", SAMPLE_ROWS / n)).orderBy("id", "v").limit(2 * SAMPLE_ROWS).collect()])
    upper = kmeans(sample, branches, seed)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = nearest(_rows(batch.column("v")), upper)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), batch.column("v")], names=["id", "branch", "v"])

    dealt = units.mapInArrow(branch, "id long, branch int, v array<double>")
    # of every branch about as many rows, however many it has
    sizes = {r["branch"]: r["n"] for r in dealt.groupBy("branch").agg(F.count("*").alias("n")).collect()}
    each = max(1, round(n**0.5 / branches))
    share = F.element_at(F.array(*[F.lit(min(1.0, ROWS_PER_CELL * each / sizes.get(b, 1)) * float(1 << 53)) for b in range(len(upper))]), F.col("branch") + 1)

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        centres = kmeans(_rows(table.column("v").combine_chunks()), each, seed)
        return pa.table([pa.array(np.repeat(table.column("branch")[0].as_py(), len(centres)).astype(np.int32)), pa.array(centres.tolist(), pa.list_(pa.float64()))], names=["branch", "centre"])

    picked = dealt.where(F.shiftrightunsigned(F.xxhash64(F.lit("cell"), F.col("id")), 11) < share)
    found = picked.groupBy("branch").applyInArrow(fit, "branch int, centre array<double>").collect()  # about sqrt(n) rows
    groups = [[r["centre"] for r in found if r["branch"] == b] or [upper[b].tolist()] for b in range(len(upper))]
    first = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    model = Model(upper, np.array([c for g in groups for c in g]), first, np.zeros((-(-upper.shape[1] // PART), 1, PART)))
    parts = model.residuals(sample, model.cells(sample))
    books = [kmeans(parts[:, p], BOOK, seed + p) for p in range(parts.shape[1])]
    model.books = np.stack([np.concatenate([b, np.repeat(b[-1:], BOOK - len(b), axis=0)]) for b in books])
    return model


def _blocks(units: DataFrame, model: Model) -> DataFrame:
    """cell, ids, codes: runs of at most BLOCK_ROWS rows of one cell."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch.column("v"))
                cells = model.cells(rows)
                codes = [c.tobytes() for c in model.codes(rows, cells)]
                yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("id"), pa.array(codes, pa.binary())], names=["cell", "id", "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, codes = -1, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(codes)], pa.binary())], names=["cell", "ids", "codes"])

        for batch in batches:
            for c, i, code in zip(*(batch.column(name).to_pylist() for name in ("cell", "id", "code")), strict=True):
                if ids and (c != cell or len(ids) == BLOCK_ROWS):
                    yield block()
                    ids, codes = [], []
                cell = c
                ids.append(i)
                codes.append(code)
        if ids:
            yield block()

    filed = units.mapInArrow(file, "cell int, id long, code binary")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return filed.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").mapInArrow(cut, "cell int, ids array<long>, codes binary")


@dataclass
class VectorIndex:
    """A built index: the model, its tables (blocks of codes, unit vectors), and what a search takes."""

    spark: SparkSession
    path: str
    model: Model
    n: int
    probes: int
    compared: int
    recall: float

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 10, recall: float = 0.9, seed: int = 7) -> VectorIndex:
        """vectors: id, v. Written under path; k and recall: what the calibration aims at."""
        spark = vectors.sparkSession
        lengths = vectors.where("id is not null and v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        _unit(vectors, "id", lengths["d"] if lengths else 0).write.mode("overwrite").parquet(f"{path}/vectors")
        units = spark.read.parquet(f"{path}/vectors")
        n = units.count()
        if not n:
            model = Model(np.zeros((1, 1)), np.zeros((1, 1)), np.array([0, 1]), np.zeros((1, BOOK, PART)))
        else:
            model = _fit(units, n, seed)
        _blocks(units, model).write.mode("overwrite").parquet(f"{path}/blocks")
        index = cls(spark, path, model, n, len(model.lower), cls._most(n, k), 1.0)
        if n:
            index._calibrate(units, k, recall)
        index._save()
        return index

    @staticmethod
    def _most(n: int, k: int) -> int:
        """How many vectors a query may be compared with exactly."""
        return max(k, min(int(SHARE * n), MOST))

    def _save(self) -> None:
        m = self.model
        arrays = [(name, list(a.shape), a.astype(np.float64).tobytes()) for name, a in (("upper", m.upper), ("lower", m.lower), ("first", m.first), ("books", m.books), ("plan", np.array([self.n, self.probes, self.compared, self.recall])))]
        self.spark.createDataFrame([(name, shape, bytearray(raw)) for name, shape, raw in arrays], "name string, shape array<int>, raw binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        a = {r["name"]: np.frombuffer(r["raw"]).reshape(r["shape"]).copy() for r in spark.read.parquet(f"{path}/model").collect()}
        n, probes, compared, recall = a["plan"]
        return cls(spark, path, Model(a["upper"], a["lower"], a["first"].astype(np.int64), a["books"]), int(n), int(probes), int(compared), float(recall))

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Files more vectors under the cells there are. `outgrown` tells when to build anew."""
        units = _unit(vectors, "id", self.model.lower.shape[1])
        units.write.mode("append").parquet(f"{self.path}/vectors")
        _blocks(units, self.model).write.mode("append").parquet(f"{self.path}/blocks")
        self.n = self.spark.read.parquet(f"{self.path}/vectors").count()
        self._save()
        return self

    def outgrown(self) -> bool:
        """Whether the table has four times the vectors its number of cells is made for."""
        return self.n > 4 * max(1, len(self.model.lower)) ** 2

    def candidates(self, queries: DataFrame, probes: int, best: int) -> DataFrame:
        """qid, id, near (approximate cosine) and turn (how many cells are nearer to the query than the id's): of each query the best of the
        cells probed."""
        model, probes, lower = self.model, min(probes, len(self.model.lower)), self.model.lower

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = max(1, FAR // len(lower))
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    batch = whole.slice(at, size)
                    far = (lower**2).sum(1) - 2 * (_rows(batch.column("v")) @ lower.T)
                    cells = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([batch.column("qid").take(row), batch.column("v").cast(pa.list_(pa.float32())).take(row), pa.array(cells.ravel()), pa.array(np.tile(np.arange(probes, dtype=np.int32), batch.num_rows))], names=["qid", "v", "cell", "turn"])

        asked = queries.mapInArrow(ask, "qid long, v array<float>, cell int, turn int")
        # queries of a cell in blocks of a bounded size
        salts = max(1, -(-queries.count() * probes // (len(lower) * QUERY_ROWS)))
        asked = asked.groupBy("cell", F.pmod(F.xxhash64("qid"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("qid", "turn", "v")).alias("asked"))
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("near", pa.float64()), ("turn", pa.int32())])

        def kept(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """The best of each query among what is held."""
            qid, ids, near, turn = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((ids, -near, qid))
            qid = qid[order]
            stay = np.arange(len(qid)) - np.searchsorted(qid, qid) < best
            order = order[stay]
            return qid[stay], ids[order], near[order], turn[order]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for batch in batches:
                for cell, ids, codes, asked in zip(batch.column("cell").to_pylist(), batch.column("ids"), batch.column("codes").to_pylist(), batch.column("asked"), strict=True):
                    ids = ids.values.to_numpy()
                    here = model.decoded(np.frombuffer(codes, np.uint8).reshape(len(ids), -1), cell)
                    here /= np.maximum(np.linalg.norm(here, axis=1, keepdims=True), 1e-12)
                    flat = asked.values
                    qids, turn = flat.field("qid").to_numpy(), flat.field("turn").to_numpy()
                    near = flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1) @ here.T.astype(np.float32)
                    near[qids[:, None] == ids[None]] = -np.inf
                    take = min(best, len(ids))
                    at = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    row = np.repeat(np.arange(len(qids)), take)
                    at = at.ravel()
                    known = np.isfinite(near[row, at])
                    row, at = row[known], at[known]
                    held.append((qids[row], ids[at], near[row, at].astype(np.float64), turn[row]))
                    size += len(row)
                    if size > HELD:
                        held = [kept(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:  # of many queries: what is held goes on as it is
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held[0], schema, strict=True)], schema=schema)
                            held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(kept(held), schema, strict=True)], schema=schema)

        hits = blocks.join(asked, "cell").select("cell", "ids", "codes", "asked").mapInArrow(scan, "qid long, id long, near double, turn int")
        return top_per_group(hits, ["qid"], [F.desc("near"), F.asc("id")], best).drop("rank")

    def _calibrate(self, units: DataFrame, k: int, recall: float) -> None:
        """The fewest cells, and then the fewest comparisons, with which sampled vectors find their true neighbours."""
        queries = units.where(_share("id", 2 * CALIBRATION / self.n)).select(F.col("id").alias("qid"), "v").dropDuplicates(["qid"]).orderBy(F.xxhash64(F.lit("sample"), "qid")).limit(CALIBRATION)
        truth = {(r["qid"], r["id"]) for r in knn_blocks(units, queries, k).collect()}
        best = self._most(self.n, k)
        found: dict[int, list[tuple[float, int, int]]] = {}
        for r in self.candidates(queries, len(self.model.lower), best).collect():  # at most CALIBRATION x MOST rows
            found.setdefault(r["qid"], []).append((-r["near"], r["turn"], r["id"]))
        # of each true neighbour: the turn of its cell, and for any number of cells its place among what they give
        target = recall + (1 - recall) / 3
        cells = len(self.model.lower)
        for probes in sorted({*range(1, min(cells, 16)), *np.linspace(1, cells, 16).astype(int).tolist(), cells}):
            places = []
            for q, hits in found.items():
                kept = sorted(h for h in hits if h[1] < probes)
                places += [place for place, (_, _, i) in enumerate(kept) if (q, i) in truth]
            reached = len(places) / max(1, len(truth))
            if reached >= target or probes == cells:
                break
        places = np.sort(np.array([*places, *[best - 1] * max(0, len(truth) - len(places))]))
        need = int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else best
        self.probes, self.compared, self.recall = int(probes), int(max(k, min(best, need))), float(min(reached, target) if reached >= target else reached)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: qid, v. The best k of each query by exact cosine among what the codes put first; ties to the smaller id."""
        asked = _unit(queries, "qid", self.model.lower.shape[1])
        near = self.candidates(asked, self.probes, max(k, self.compared)).select("qid", "id")
        vectors = self.spark.read.parquet(f"{self.path}/vectors")
        exact = near.distinct().join(vectors, "id").join(asked.withColumnRenamed("v", "qv"), "qid").select("qid", "id", F.round(V.dot(F.col("v"), F.col("qv")), 6).alias("score"))
        return top_per_group(exact, ["qid"], [F.desc("score"), F.asc("id")], k)


def recall_of(found: DataFrame, exact: DataFrame, vectors: DataFrame, compared: int) -> DataFrame:
    """One row: queries with a true neighbour, the recall of found (qid, id) against exact, and the share of the table that each was compared with."""
    hit = exact.select("qid", "id").distinct().join(found.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    total = hit.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return total.join(F.broadcast(vectors.agg((F.lit(compared) / F.count("*")).alias("share"))))
