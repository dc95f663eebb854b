"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every training passage (overlapping runs of words of the whole text) is a query against the items. Impacts are divided by
an item's score against itself, so that a threshold between 0 and 1 asks for a share of the item whatever its length. All
items at or above the threshold are retrieved; a hit counts once the item's question (all sentences but the last) and
answer (the last one, or the last quarter of the words of a single sentence) both overlap the passage by word trigrams.

Passages are at least twice as long as the longest item of the index and half of each overlaps the next, so an item lies
whole in one of them. Null, empty and short texts and items give no hit; repeated rows are searched alike; repeated items
are each retrieved. Words are runs of letters and digits, lower-cased. Other columns are ignored. The index is broadcast
in shards of at most `SHARD_ITEMS` items, one after another, with statistics over all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import NOT_ALNUM, record, slices, split_words

K1, B = 1.5, 0.75
THRESHOLD = 0.6
MIN_OVERLAP = 0.6
MIN_PASSAGE = 128
#: Blocks of the index, and passages that are bounded at once.
MAX_BLOCKS, _CHUNK = 256, 2048
SHARD_ITEMS = 20_000
_FILTER_BITS = 20


def _lower_words(texts: list[str]):
    return split_words(pc.utf8_lower(pa.array(texts, pa.large_string())), NOT_ALNUM)


def _trigrams(h: np.ndarray) -> np.ndarray:
    if len(h) < 3:
        return np.unique(h)
    return np.unique(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[2:] ^ (h[2:] >> np.uint64(29))))


def _parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Postings of a shard of items: for each term its items with normalised impacts, and maxima of runs of postings."""

    def __init__(self, ids: np.ndarray, texts: list[str], df: dict[int, int], n: int, average: float, threshold: float = THRESHOLD):
        words = _lower_words(texts)
        hashes, row = words.hashes(), words.row
        self.ids = ids
        self.longest = int(np.diff(words.first).max(initial=0))
        self.terms, inverse = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(inverse * max(1, len(ids)) + row, return_counts=True)
        term, item = pair // max(1, len(ids)), pair % max(1, len(ids))
        length = np.diff(words.first)[item]
        known = np.array([df[int(h)] for h in self.terms], np.float64)
        idf = np.log1p((n - known + 0.5) / (known + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(average, 1e-9)))
        own = np.bincount(item, impact, minlength=len(ids))
        impact = impact / own[item]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.items, self.impacts = item, impact
        self.top = np.maximum.reduceat(impact, self.first[:-1]) if len(impact) else np.zeros(0)
        self.question, self.answer = [], []
        for t in texts:
            q, a = _parts(t)
            self.question.append(_trigrams(_lower_words([q]).hashes()))
            self.answer.append(_trigrams(_lower_words([a]).hashes()))
        # maxima of blocks of neighbouring items
        self.width = max(1, -(-len(ids) // MAX_BLOCKS))
        self.block_top = np.zeros((len(self.terms), -(-max(1, len(ids)) // self.width)), np.float32)
        np.maximum.at(self.block_top, (term, item // self.width), impact)
        # the most frequent terms whose maxima stay under a share of the threshold in each block: nothing is retrieved
        # by them alone, so only passages with other terms are looked at
        order = np.lexsort((self.top, -known))
        worst = np.zeros(len(self.terms))
        total = np.zeros(self.block_top.shape[1])
        for i, t in enumerate(order):
            total += self.block_top[t]
            worst[i] = total.max()
        self.optional = np.zeros(len(self.terms), bool)
        self.optional[order[worst < 0.6 * threshold]] = True
        self.block_slack = self.block_top[self.optional].sum(axis=0)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @property
    def passage(self) -> int:
        return max(MIN_PASSAGE, 2 * self.longest)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words of no item."""
        out = np.full(len(hashes), -1)
        if len(self.terms):
            maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            hit = self.terms[slot] == hashes[maybe]
            out[maybe[hit]] = slot[hit]
        return out

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score for the terms reaches the threshold."""
        at = self.first[terms].copy()
        end = self.first[terms + 1]
        found = []
        none = len(self.ids)
        current = np.where(at < end, self.items[np.minimum(at, len(self.items) - 1)], none)
        while True:
            order = np.argsort(current, kind="stable")
            bound = np.cumsum(self.top[terms[order]])
            p = int(np.searchsorted(bound, threshold - 1e-9))
            if p >= len(order) or current[order[p]] >= none:
                return found
            pivot = current[order[p]]
            while p + 1 < len(order) and current[order[p + 1]] == pivot:
                p += 1
            lists = order[: p + 1]
            # maxima of the pivot's block of items
            column = int(pivot) // self.width
            target = pivot
            if self.block_top[terms[lists], column].sum() >= threshold - 1e-6:
                if current[lists[0]] == pivot:
                    score = float(self.impacts[at[lists]].sum())
                    if score >= threshold - 1e-9:
                        found.append((int(pivot), score))
                    target = pivot + 1
            else:
                target = (column + 1) * self.width
                if p + 1 < len(order):
                    target = min(target, current[order[p + 1]])
                target = max(target, pivot + 1)
            for i in lists:
                if current[i] < target:
                    at[i] += np.searchsorted(self.items[at[i] : end[i]], target)
                    current[i] = self.items[at[i]] if at[i] < end[i] else none


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
HITS = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"


def search_slice(index: Index, doc_ids: np.ndarray, texts: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    words = split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_ALNUM)
    if not len(words.starts) or not len(index.ids):
        return []
    hashes = words.hashes()
    term = index.lookup(hashes)
    size = index.passage
    step = size // 2
    n_words = np.diff(words.first)
    essential = np.flatnonzero((term >= 0) & ~index.optional[term])
    row = np.searchsorted(words.first, essential, "right") - 1
    inside = essential - words.first[row]
    # word i lies in the passages that start at step*(i//step) and one step before
    last = np.maximum(0, -(-(n_words - size) // step))
    second = np.minimum(inside // step, last[row])
    first = np.maximum(0, inside // step - 1)
    base = np.cumsum(last + 1) - (last + 1)
    p1, p2 = base[row] + first, base[row] + second
    t = term[essential]
    two = (p1 != p2) & (first <= last[row])
    first_ok = first <= last[row]
    passage = np.concatenate([p1[first_ok], p2[two]])
    terms = np.concatenate([t[first_ok], t[two]])
    pair = np.unique(passage * len(index.terms) + terms)
    passage, terms = pair // len(index.terms), pair % len(index.terms)
    if not len(passage):
        return []
    cut = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.append(cut[1:], len(passage))
    likely = np.add.reduceat(index.top[terms], cut) + index.block_slack.max() >= threshold - 1e-5
    for at in range(0, len(cut), _CHUNK):
        lo, hi = cut[at], ends[min(at + _CHUNK, len(cut)) - 1]
        bound = np.add.reduceat(index.block_top[terms[lo:hi]], cut[at : at + _CHUNK] - lo, axis=0)
        likely[at : at + _CHUNK] &= (bound + index.block_slack).max(axis=1) >= threshold - 1e-5
    out = []
    for k in np.flatnonzero(likely):
        which = passage[cut[k]]
        r = int(np.searchsorted(base, which, "right")) - 1
        start = int(which - base[r]) * step
        lo = words.first[r] + start
        hi = min(words.first[r + 1], lo + size)
        all_terms = np.unique(term[lo:hi])
        grams = None
        for item, score in index.wand(all_terms[all_terms >= 0], threshold):
            if grams is None:
                grams = np.union1d(_trigrams(hashes[lo:hi]), hashes[lo:hi])
            share = [float(np.isin(g, grams).mean()) if len(g) else 1.0 for g in (index.question[item], index.answer[item])]
            if min(share) >= overlap:
                out.append((int(doc_ids[r]), int(index.ids[item]), start, score, *share))
    return out


def build_shards(items: DataFrame, threshold: float) -> list[Index]:
    """Indexes of at most about SHARD_ITEMS items each, with document frequencies and lengths over all items."""
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    parts = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s) if shards > 1 else items for s in range(shards)]
    df: dict[int, int] = {}
    n = length = 0
    held = []
    for part in parts:
        rows = part.toPandas().sort_values(["item_id", "text"], kind="stable")
        rows = rows[np.array([bool(re.search(r"\w", t)) for t in rows["text"]], bool)]
        words = _lower_words(rows["text"].tolist())
        rows = rows[np.diff(words.first) > 0]
        n, length = n + len(rows), length + len(words.starts)
        hashes, row = words.hashes(), words.row
        order = np.lexsort((row, hashes))
        once = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])])) if len(order) else order
        for h, c in zip(*np.unique(hashes[order][once], return_counts=True), strict=True):
            df[int(h)] = df.get(int(h), 0) + int(c)
        held.append(rows)
    return [Index(rows["item_id"].to_numpy(np.int64), rows["text"].tolist(), df, n, length / max(1, n), threshold) for rows in held]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = MIN_OVERLAP) -> DataFrame:
    """docs: doc_id long, text; items: item_id, text. One row for each document and item it contains: the best passage.
    Rows of null doc_id are left out."""
    found = []
    for index in build_shards(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                hits = search_slice(shared.value, batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text"), threshold, overlap)
                if hits:
                    yield record(_HITS, *zip(*hits, strict=True))

        found.append(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, HITS))
    hits = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "question_overlap", "answer_overlap"))
    return hits.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.score").alias("score"), F.col("b.question_overlap").alias("question_overlap"), F.col("b.answer_overlap").alias("answer_overlap"))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of docs that contain no item, columns unchanged; the scan itself filters, nothing is shuffled."""
    for index in build_shards(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in search_slice(shared.value, np.arange(batch.num_rows), batch.column("text"), threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
