"""Windows of a fixed number of tokens, found through sampled positions: what op2 and op7 share.

A window of `width` tokens is filed under its anchor: the leftmost of the grams of `gram` tokens in it whose hash is
smallest. Equal windows have equal anchors at equal distances, so each can be judged among the windows of its anchor
alone. The neighbouring windows that share one anchor occurrence are a block; a document of n tokens has about
2n / (width - gram + 2) blocks. Only blocks are shuffled.

A document is known by (doc, variant): doc is its doc_id (the largest long where that is null); variant is 0, or the text's
hash where doc_id is null or stands over several texts. So rows of one doc_id and different texts are different documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import materialise, mix, powers

#: A block's document and place in it.
KEY = ("doc", "variant")
#: place = first token << 16 | (windows - 1) << 8 | distance of the anchor from the first token; orders by first token.
_BYTE = 255


def pack_place(first: np.ndarray, windows: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (first << 16) | ((windows - 1) << 8) | distance


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, ((place >> 8) & _BYTE) + 1, place & _BYTE


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks(tokens: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of documents laid end to end (first: where each starts, and the end): anchor hash, content hash, document,
    first token in it, number of windows, distance of the anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(tokens)
    if n < width:
        return none
    scaled = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(n), dtype=np.uint64, out=scaled[1:])
    inverse = powers(n, inverse=True)
    grams = mix((scaled[gram:] - scaled[: n - gram + 1]) * inverse[: n - gram + 1])
    span = width - gram + 1
    low = _sliding_min(grams, span)
    # windows inside one document
    sizes = np.diff(first)
    inside = np.zeros(n + 1, np.int64)
    fits = sizes >= width
    np.add.at(inside, first[:-1][fits], 1)
    np.add.at(inside, first[1:][fits] - width + 1, -1)
    inside = np.cumsum(inside[:-1])[: len(low)] > 0
    # runs of windows of one minimum within one document
    starts_run = inside.copy()
    starts_run[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    heads = first[:-1][fits]
    starts_run[heads] = True
    s = np.flatnonzero(starts_run)
    if not len(s):
        return none
    ends_run = inside.copy()
    ends_run[:-1] &= ~inside[1:] | starts_run[1:]
    e = np.flatnonzero(ends_run)
    out = []
    while len(s):
        # leftmost gram with the minimum, run by run
        p = np.empty(len(s), np.int64)
        step = max(1, (1 << 22) // span)
        for at in range(0, len(s), step):
            some = s[at : at + step]
            p[at : at + step] = some + (grams[some[:, None] + np.arange(span)] == low[some][:, None]).argmax(axis=1)
        stop = np.minimum(e, p)
        out.append((s, stop, p))
        again = stop < e
        s, e = stop[again] + 1, e[again]
    s, e, p = (np.concatenate([o[k] for o in out]) for k in range(3))
    order = np.argsort(s, kind="stable")
    s, e, p = s[order], e[order], p[order]
    content = mix((scaled[e + width] - scaled[s]) * inverse[s] + ((e - s) << 8 | (p - s)).astype(np.uint64))
    doc = np.searchsorted(first, s, "right") - 1
    return grams[p].view(np.int64), content.view(np.int64), doc, s - first[doc], e - s + 1, p - s


def known(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with doc and variant in front; text and the columns in keep stay."""
    rows = docs.select("doc_id", "text", *keep)
    content = F.xxhash64("text")
    several = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(content).alias("lo"), F.max(content).alias("hi")).where("lo <> hi")
    # usually no row at all: its size is known once it is written, so it is broadcast only where it is small
    several = materialise(several.select("doc_id", F.lit(True).alias("_several")))
    own = F.col("_several") | F.col("doc_id").isNull()
    marked = rows.join(several, "doc_id", "left")
    return marked.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.when(own, F.xxhash64("doc_id", "text")).otherwise(F.lit(0)).cast("long").alias("variant"), *rows.columns)


def merge_spans(place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of tokens under the windows of `place`: starts and ends."""
    first, windows, _ = unpack_place(np.sort(place))
    end = np.maximum.accumulate(first + windows - 1 + width)
    new = np.empty(len(first), bool)
    new[:1] = True
    new[1:] = first[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return first[heads], end[np.append(heads[1:], len(first)) - 1] if len(first) else end
