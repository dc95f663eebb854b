"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (`train_rows` of each language, chosen by a hash of doc_id and text). The
log-probability matrix (orders x 2**bits x languages floats, at most `MAX_LANGUAGES` languages) is broadcast, and tasks
score whole texts in numpy. Null texts and texts without a letter are `und` with score 0. Repeated rows are scored alike;
ties go to the smaller language name; without any labelled row everything is `und`. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import record, sampled, slices

ORDERS = (1, 2, 3)
BITS = 16
MAX_LANGUAGES = 256
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(lowered.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _ngrams(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram inside a text, and where each text's n-grams start."""
    for slot, order in enumerate(ORDERS):
        counts = np.maximum(np.diff(bounds) - order + 1, 0)
        n = max(len(points) - order + 1, 0)
        hashed = np.full(n, order, np.uint32)
        for j in range(order):
            hashed += points[j : j + n] * _MULTIPLIERS[j]
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x2C1B3C6D)
        bucket = (hashed >> np.uint32(32 - BITS)).astype(np.int64) + (slot << BITS)
        keep = np.ones(n, bool)
        for back in range(1, order):
            edge = bounds[1:] - back
            keep[edge[(edge >= 0) & (edge < n)]] = False
        yield bucket[keep], np.concatenate([[0], np.cumsum(counts)])


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            points, bounds = _code_points(batch.column("text").filter(pa.array(langs == lang)))
            total = totals.setdefault(lang, np.zeros(len(ORDERS) << BITS, np.int64))
            for buckets, _ in _ngrams(points, bounds):
                total += np.bincount(buckets, minlength=len(total))
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield record(_COUNTS, np.full(len(at), lang, object), at.astype(np.int32), total[at])


def train(docs: DataFrame, train_rows: int = 5000, partitions: int = 8) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and the log-probability matrix (buckets x languages) with add-one smoothing.

    docs: text, lang and doc_id of the labelled rows.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(ORDERS) << BITS, 0), np.float32)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, train_rows / sizes[lang])).otherwise(share)
    sample = labelled.where(sampled(share, "doc_id", "text"))
    counted = sample.select("text", "lang").repartition(partitions).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(ORDERS) << BITS, len(langs)))
    table[rows["bucket"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy().astype(str))] = rows["n"].to_numpy()
    table += 1
    for slot in range(len(ORDERS)):
        part = slice(slot << BITS, (slot + 1) << BITS)
        table[part] = np.log(table[part] / table[part].sum(axis=0))
    return langs, table.astype(np.float32)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs: doc_id, held_out, text. Returns doc_id, held_out, lang_pred, score (the posterior probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        names = np.array([*langs, UNDETERMINED], object)
        for batch in slices(batches, "text", 2 << 20):
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, max(1, len(langs))))
            if langs:
                points, bounds = _code_points(text)
                for buckets, first in _ngrams(points, bounds):
                    some = np.flatnonzero(np.diff(first))
                    if len(some):
                        for k in range(len(langs)):
                            total[some, k] += np.add.reduceat(table[:, k][buckets], first[:-1][some], dtype=np.float64)
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = lettered & bool(langs)
            yield record(_SCORED, batch.column("doc_id"), batch.column("held_out"), names[np.where(known, best, len(langs))], np.where(known, score, 0.0))

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def is_held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder `part`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts)) == part


def op10(docs: DataFrame, train_rows: int = 5000) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(is_held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"))
    return identify(rows, train(rows.where(~F.col("held_out")), train_rows))
