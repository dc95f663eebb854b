"""Packing token sequences by non-negative least squares over length combinations.

Every document becomes its tokens and one end token. Full windows are cut off first; what remains of a document has a
length under the window. Shallow combinations of such lengths that fill a window exactly are enumerated, non-negative
least squares finds how often to use each so that the histogram of lengths is met, the counts are rounded down to what
the histogram holds, and the lengths that are left over are packed greedily: laid end to end and cut at window borders,
the very last part at powers of two, which need no padding. Null text is an empty document (one end token). Repeated
rows are packed each on their own, ties go by doc_id; an empty table gives no piece; other columns are ignored.

The histogram (at most `window` numbers) is all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import materialise, record, slices

WINDOW = 1024
END = 0
#: Up to so many left-over remainders (four numbers each) are broadcast to the texts' scan; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of the file, and an encoder of the same vocabulary, merges and splitting rule that is several times
    as fast; texts that hold the special token go to the first, which alone gives it its own id."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(path), None
    if path.endswith("byte_bpe_50k.json"):
        import public_tokenizers

        with open(path[: -len(".json")] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast


def encode(text: str | None, path: str) -> np.ndarray:
    """Token ids of a whole text and the end token, as little-endian unsigned 32-bit numbers."""
    exact, fast = _encoders(path)
    text = text or ""
    ids = fast.encode_ordinary(text) if fast is not None and _SPECIAL not in text else exact.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], "<u4")


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash")])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_hash long"


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def tokenise(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row for each full window of a document and for its remainder (length under the window, may be missing). The hash
    of the text tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple[int, ...]] = []
            for doc_id, text, text_hash in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("text_hash").to_pylist(), strict=True):
                ids = encode(text.as_py(), path)
                raw, n = memoryview(ids.tobytes()), len(ids)
                rows += [(doc_id, at, min(window, n - at), zlib.crc32(raw[4 * at : 4 * (at + window)]), n, text_hash) for at in range(0, n, window)]
            yield record(_PIECES, *zip(*rows, strict=True))

    return docs.select("doc_id", "text", _text_hash()).mapInArrow(run, PIECES)


def combinations(lengths: np.ndarray, window: int, seed: int = 7, triples: int = 4096) -> list[tuple[int, ...]]:
    """Multisets of at most three lengths of the histogram that fill the window: all pairs, and up to `triples` triples
    spread evenly over all of them (the method's search breadth; what they leave over is packed all the same)."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    low = lengths[lengths <= window // 2]
    found = [(int(a), int(window - a)) for a in low if have[window - a]]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & have[np.clip(c, 0, window)]
    threes = np.stack([a[ok], b[ok], c[ok]], axis=1)
    if len(threes) > triples:
        threes = threes[np.linspace(0, len(threes) - 1, triples).astype(int)]
    return found + [tuple(map(int, t)) for t in threes]


def nnls(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares of the combinations' counts against the histogram, by cyclic coordinate descent."""
    x = np.zeros(len(combos))
    if not combos:
        return x
    width = max(map(len, combos))
    at = np.full((len(combos), width), len(histogram))
    for i, c in enumerate(combos):
        at[i, : len(c)] = c
    rest = np.append(histogram.astype(np.float64), 0.0)
    columns = []
    for c in combos:
        values, times = np.unique(c, return_counts=True)
        columns.append((values, times.astype(np.float64), float((times**2).sum())))
    for _ in range(sweeps):
        change = 0.0
        for i, (values, times, norm) in enumerate(columns):
            step = max(-x[i], float(times @ rest[values]) / norm)
            if step:
                x[i] += step
                rest[values] -= step * times
                change = max(change, abs(step))
        if change < 0.25:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(combination, how often), rounded so that no length is used more often than the histogram has it."""
    combos = combinations(np.flatnonzero(histogram), window)
    x, left, chosen = nnls(combos, histogram), histogram.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        values, times = np.unique(combos[i], return_counts=True)
        n = int(min(round(x[i]), (left[values] // times).min()))
        if n > 0:
            left[values] -= n * times
            chosen.append((combos[i], n))
    for c in combos:  # whole windows that rounding left behind
        values, times = np.unique(c, return_counts=True)
        n = int((left[values] // times).min())
        if n > 0:
            left[values] -= n * times
            chosen.append((c, n))
    return chosen


def slots(chosen: list[tuple[tuple[int, ...], int]], first_sequence: int, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """For each length, runs of its ranks: (length, first rank, count, sequence of the first, offset). Sequences of a
    run are consecutive."""
    used, out, sequence = np.zeros(window + 1, np.int64), [], first_sequence
    for combo, n in chosen:
        offset = 0
        for length in combo:
            out.append((length, int(used[length]), n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: the position of a piece among those of its length, by (doc_id, start). Range partitions are ranked on
    their own and shifted by the counts of the partitions before, so that a frequent length is spread over tasks."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(pieces.repartitionByRange(parts, "length", "doc_id", "start").withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) over (partition by length order by part) - n as before")
    inner = placed.selectExpr("*", "row_number() over (partition by part, length order by doc_id, start) - 1 as inner_rank")
    return inner.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inner_rank")).drop("part", "before", "inner_rank")


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id long, text. Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, path, window))
    ranked = materialise(_ranked(pieces))
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    full = int(histogram[window])
    histogram[window] = 0
    whole = ranked.where(F.col("length") == window).select(*PIECES_NAMES, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = slots(plan(histogram, window), full, window)
    used = np.zeros(window + 1, np.int64)
    for length, _, n, _, _ in runs:
        used[length] += n
    packed = sum(n for *_, n, _, offset in runs if offset == 0)
    # at most a few thousand runs, whatever the input: their number is bounded by the combinations
    table = F.broadcast(spark.createDataFrame(runs, "run_length long, first long, n long, sequence long, `offset` long"))
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    combined = ranked.where(F.col("length") < window).join(table, fits).select(*PIECES_NAMES, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    cut = F.element_at(F.array(*[F.lit(int(u)) for u in used]), F.col("length").cast("int") + 1)
    left = ranked.where((F.col("length") < window) & (F.col("rank") >= cut))
    return whole.unionByName(combined).unionByName(_residue(docs, left, histogram - used, full + packed, path, window))


PIECES_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def _residue(docs: DataFrame, left: DataFrame, counts: np.ndarray, first_sequence: int, path: str, window: int) -> DataFrame:
    """Lay the remainders that no combination took end to end, by length and rank, and cut at the windows' borders; the
    last, shorter part is cut at powers of two."""
    starts = np.concatenate([[0], np.cumsum(counts * np.arange(len(counts)))])
    used_before = F.element_at(F.array(*[F.lit(int(s)) for s in starts[:-1]]), F.col("length").cast("int") + 1)
    total = int(starts[-1])
    tail = total - total % window
    # sequences of the tail: (start, size), sizes falling powers of two
    ends, at = [], tail
    for bit in reversed(range(window.bit_length())):
        if (total - tail) >> bit & 1:
            ends.append((at, 1 << bit))
            at += 1 << bit
    lowest = left.groupBy("length").agg(F.min("rank").alias("lowest"))
    laid = left.join(F.broadcast(lowest), "length").withColumn("at", used_before + (F.col("rank") - F.col("lowest")) * F.col("length"))
    laid = laid.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash", "at")
    texts = docs.select(F.col("doc_id").alias("text_id"), "text", _text_hash().alias("of_text"))
    same = F.col("text_id").eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("text_hash"))
    if counts.sum() <= BROADCAST_ROWS:
        laid = F.broadcast(laid)
    # one row of each text that is wanted, however often it is repeated: pieces meet their text once
    known = texts.join(laid.select("doc_id", "text_hash"), same, "left_semi").dropDuplicates(["text_id", "of_text"])
    wanted = known.join(laid, same).drop("text_id", "of_text")
    schema = pa.schema([(n, pa.int64()) for n in (*PIECES_NAMES, "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, encode(None, path)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, start, length, crc, tokens, at, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at", "text")), strict=True):
                if text != last:
                    last, ids = text, encode(text, path)
                if len(ids) != tokens or zlib.crc32(ids[start:].tobytes()) != crc:
                    raise ValueError("two texts of one doc_id share a 64-bit hash")
                done = 0
                while done < length:
                    here = at + done
                    if here < tail:
                        seq, offset, size = here // window, here % window, window
                    else:
                        k = max(i for i, (s, _) in enumerate(ends) if s <= here)
                        seq, offset, size = tail // window + k, here - ends[k][0], ends[k][1]
                    n = min(length - done, size - offset)
                    part = ids[start + done : start + done + n]
                    rows.append((doc_id, start + done, n, zlib.crc32(part.tobytes()), len(ids), first_sequence + seq, offset))
                    done += n
            if rows:
                yield record(schema, *zip(*rows, strict=True))

    return wanted.mapInArrow(run, OUT)


def op8(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    import public_tokenizers

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pack(rows, public_tokenizers.path("byte_bpe_50k.json"), window)
