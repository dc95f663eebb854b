"""Substring dedup on bytes: repeated strings of at least `width` bytes, all but the first occurrence removed.

Prefix doubling over all byte positions would sort every byte's position and rank once a round. Here only sampled
positions (the anchors of repeats.py) enter: Spark sorts (position, rank pair) rows, the pair being the names of the
string of `GRAM` bytes at the position and of the longer string around it (at least `width` bytes: past the threshold);
positions of a unique name drop out, those of equal pairs are settled, and the few whose short names agree but whose long
ones differ are ranked byte position by byte position with prefix doubling at offsets 1, 2, 4, ... until unique or past
the threshold, in shards by anchor.

Texts are UTF-8 bytes; null and empty ones have none, those shorter than `width` stay whole. Matches never cross
documents. An occurrence is earlier if its doc_id is smaller, or its start in the same document. Rows of one doc_id with
different texts are documents of their own, in the order of a hash of the text; so are rows of null doc_id, which come last.
A row that repeats another's doc_id and text counts as the same document and gets the same result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import buffers, materialise, mix, record, rolling, slices
from dealspark.llm.repeats import KEY, blocks, known, merge_spans, pack_place, unpack_place

WIDTH, GRAM = 100, 32
#: Contested blocks of one anchor that a task compares at once; more are compared in parts, and then what the parts kept.
GROUP_ROWS = 20_000
_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _schema(**fields: pa.DataType) -> tuple[pa.Schema, str]:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return pa.schema(list(fields.items())), ", ".join(f"{k} {names[t]}" for k, t in fields.items())


_LONG, _BOOL = pa.int64(), pa.bool_()
BLOCKS, BLOCKS_DDL = _schema(anchor=_LONG, block=_LONG, doc=_LONG, place=_LONG, variant=_LONG, done=_BOOL)
JUDGED, JUDGED_DDL = _schema(doc=_LONG, variant=_LONG, anchor=_LONG, place=_LONG, again=_BOOL)
_WINDOWS, _WINDOWS_DDL = _schema(doc=_LONG, variant=_LONG, anchor=_LONG, place=_LONG, again=_BOOL, hash=_LONG)
_CONTENTS, _CONTENTS_DDL = _schema(anchor=_LONG, salt=_LONG, parts=_LONG, doc=_LONG, variant=_LONG, place=_LONG, content=pa.binary())


def doubling_ranks(data: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the strings of `width` bytes at all positions of strings laid end to end, by prefix doubling. Once all are
    unique their ranks stay. Strings don't run over the end of their piece."""
    n = len(data)
    rank = data.astype(np.int64) + 1
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # bytes to the end of the piece
    out = np.full(n, -1, np.int64)
    length = 1
    while length < width:
        offset = min(length, width - length)
        length += offset
        reach = np.flatnonzero(left >= length)
        if not len(reach):
            return out
        names, inverse = np.unique(rank[reach] * np.int64(n + 512) + rank[reach + offset], return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[reach] = inverse + 1
        if len(names) == len(reach):
            break
    live = left >= width
    out[live] = rank[live]
    return out


def window_ranks(contents: list[bytes], windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows of all contents laid end to end (equal windows get equal ones), and their hashes."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    ranks = doubling_ranks(data, first, width)
    at = np.repeat(first[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    return ranks[at], rolling(_NAMES[data], width)[at].view(np.int64)


def _changes(columns: list[np.ndarray], before: tuple[int, ...] | None = None) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    for k, c in enumerate(columns):
        out[1:] |= c[1:] != c[:-1]
        out[:1] |= before is None or c[0] != before[k]
    return out


def settle(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """BLOCKS of a slice, with what the slice alone decides: of equal blocks only the first is left for the comparison with
    other slices, the others are done: they are to go. So a block that is very frequent costs a row per slice."""
    columns = [anchor, block, doc, variant, place]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    once = _changes(columns)  # a repeated row is one occurrence
    columns = [c[once] for c in columns]
    new = _changes(columns[:2])
    anchor, block, doc, variant, place = (np.concatenate([c[new], c[~new]]) for c in columns)
    return record(BLOCKS, anchor, block, doc, place, variant, np.repeat([False, True], [new.sum(), (~new).sum()]))


class _Judge:
    """Reads rows in the order of anchor, block, doc, variant, place and holds one or two of them."""

    def __init__(self):
        self.last: tuple[int, ...] | None = None
        self.head: tuple[int, int, int, int] | None = None  # the anchor's only content so far
        self.several = False

    def read(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        once = _changes(columns, self.last)
        columns = [c[once] for c in columns]
        anchor, _, doc, variant, place = columns
        if not len(anchor):
            return record(JUDGED, [], [], [], [], [])
        head = _changes(columns[:2], self.last and self.last[:2])
        new = _changes(columns[:1], self.last and self.last[:1])
        group = np.cumsum(new)  # 0 goes on from before
        contents = np.bincount(group, head, minlength=group[-1] + 1)
        several = contents > 1
        several[0] = self.several or contents[0] > 0
        contested = head & several[group]
        before = [self.head] if contents[0] and self.head else []
        first = lambda k: np.array([b[k] for b in before], np.int64)
        pick = lambda k, c: np.concatenate([first(k), c[~head], c[contested]])
        again = np.repeat([False, True, False], [len(before), (~head).sum(), contested.sum()])
        out = record(JUDGED, pick(0, doc), pick(1, variant), pick(2, anchor), pick(3, place), again)
        if group[-1]:
            at = np.flatnonzero(head)[-1]
            self.head = None if several[-1] else (int(doc[at]), int(variant[at]), int(anchor[at]), int(place[at]))
        elif contents[0]:
            self.head = None
        self.several = bool(several[group[-1]])
        self.last = tuple(int(c[-1]) for c in columns)
        return out


def judge(found: DataFrame) -> DataFrame:
    """found: BLOCKS. Returns a row with again=true for each block that has occurred before as a whole, and one with
    again=false for the first block of each content whose anchor has several contents (contested). Tasks read sorted rows
    and hold two of them."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge()
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column("done").to_numpy(zero_copy_only=False)
            columns = [batch.column(k).to_numpy() for k in ("anchor", "block", "doc", "variant", "place")]
            if not done.all():
                yield judge.read([c[~done] for c in columns])
            if done.any():
                anchor, _, doc, variant, place = (c[done] for c in columns)
                yield record(JUDGED, doc, variant, anchor, place, done[done])

    # rows that are done pass through, dealt evenly
    key = F.when(F.col("done"), F.xxhash64("doc", "place")).otherwise(F.col("anchor"))
    ordered = found.repartition(parts, key).sortWithinPartitions("done", "anchor", "block", "doc", "variant", "place")
    return ordered.mapInArrow(run, JUDGED_DDL)


def compare_windows(contents: DataFrame, width: int) -> DataFrame:
    """contents: _CONTENTS, of contested blocks, distinct within an anchor. Returns the windows that are to go (again), and
    of anchors in several parts also those that a part kept."""
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def some(batch: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batch).combine_chunks()
        get = lambda k: table.column(k).to_numpy()
        table = table.filter(pa.array(_changes([get(k) for k in ("anchor", "salt", "doc", "variant", "place")])))
        anchor, salt, doc, variant, place = (get(k) for k in ("anchor", "salt", "doc", "variant", "place"))
        first, windows, _ = unpack_place(place)
        number, hashes = window_ranks(table.column("content").to_pylist(), windows, width)
        row = np.repeat(np.arange(len(doc)), windows)
        at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        key = np.cumsum(_changes([anchor, salt]))[row] * (int(number.max(initial=0)) + 1) + number
        is_first = np.zeros(len(key), bool)
        is_first[np.unique(key, return_index=True)[1]] = True
        out = ~is_first | (get("parts")[row] > 1)
        row, at, again = row[out], at[out], ~is_first[out]
        return record(_WINDOWS, doc[row], variant[row], anchor[row], (first[row] + at) << 16, again, hashes[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= GROUP_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                change = np.flatnonzero(_changes([table.column(k).to_numpy() for k in ("anchor", "salt")]))
                if change[-1]:
                    cut = int(change[-1])
                    yield some(table.slice(0, cut).to_batches())
                    held = table.slice(cut).to_batches()
                    size = len(table) - cut
        if held:
            yield some(held)

    ordered = contents.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "variant", "place")
    return ordered.mapInArrow(run, _WINDOWS_DDL)


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs: doc, variant, text. Returns doc, variant, place: runs of windows that have occurred before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, first = buffers(batch.column("text"))
            anchor, block, row, start, windows, distance = blocks(_NAMES[data], first, width, gram)
            doc, variant = (batch.column(k).to_numpy() for k in KEY)
            yield settle(anchor, block, doc[row], variant[row], pack_place(start, windows, distance))

    texts = docs.where(F.col("text").isNotNull()).select(*KEY, "text")
    judged = materialise(judge(texts.mapInArrow(find, BLOCKS_DDL)))
    contested = judged.where(~F.col("again")).select(*KEY, "anchor", "place")
    # anchors with many contents: at most one in GROUP_ROWS contested rows
    crowded = contested.groupBy("anchor").count().where(F.col("count") > GROUP_ROWS).select("anchor", F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("long").alias("parts"))
    dealt = contested.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(*KEY, "place"), "parts"))
    wanted = dealt.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "salt", "parts", "place")).alias("blocks"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for doc, variant, text, wanted in zip(*(batch.column(k).to_pylist() for k in KEY), batch.column("text"), batch.column("blocks"), strict=True):
                b, raw = wanted.values, text.as_buffer().to_pybytes()
                start, windows, _ = unpack_place(b.field("place").to_numpy())
                content = [raw[s : s + n - 1 + width] for s, n in zip(start.tolist(), windows.tolist(), strict=True)]
                yield record(_CONTENTS, b.field("anchor"), b.field("salt"), b.field("parts"), np.full(len(start), doc), np.full(len(start), variant), b.field("place"), content)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in read(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    contents = texts.join(wanted, list(KEY)).mapInArrow(gathered, _CONTENTS_DDL)
    windows = materialise(compare_windows(contents, width))
    over = windows.where(~F.col("again")).select("anchor", F.col("hash").alias("block"), "doc", "place", "variant", F.lit(False).alias("done"))
    # windows that the parts of crowded anchors kept: by anchor and window, so that no task meets a whole anchor
    rest = judge(over.withColumn("anchor", F.xxhash64("anchor", "block"))).where("again")
    found = [judged.where("again"), windows.where("again"), rest]
    return found[0].select(*KEY, "place").unionByName(found[1].select(*KEY, "place")).unionByName(found[2].select(*KEY, "place"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """docs: doc_id long, text. Returns doc_id, n_bytes, n_removed, n_spans, kept (bytes; null without with_kept),
    kept_sha256."""
    rows = known(docs)
    found = spans(rows, width, gram).groupBy(*KEY).agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, kept, runs = len(raw), raw, 0
                if places.is_valid:
                    starts, ends = merge_spans(places.values.to_numpy(), width)
                    runs = len(starts)
                    cuts = [0, *np.stack([starts, ends], axis=1).reshape(-1).tolist(), n]
                    kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((doc_id, n, n - len(kept), runs, kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
            yield record(_OUT, *zip(*rows, strict=True))

    return rows.join(found, list(KEY), "left").select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), with_kept=False).drop("kept")
