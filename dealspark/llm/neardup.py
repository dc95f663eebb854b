"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are five words (lower-cased runs of letters and digits; a shorter text is one shingle), weighted by their count
times an inverse document frequency over all documents, counted in 2**18 hashed buckets as in feature hashing: 1 MB,
whatever the input. Samples agree with the probability of the weighted Jaccard similarity; bands of two samples give the
candidates, and pairs of texts are verified by their exact weighted Jaccard similarity.

Copies of the same word sequence are one node. In a bucket of candidates every text is first verified against one of them;
buckets whose texts are then still in different classes are compared in full, blocks of texts against blocks of other
classes, and only links that join classes leave a task. So no pairs are written out, and no link between different texts is
left out but by the chance of the bands (1 in 25000 at the threshold).

A document's class is the smallest doc_id it is linked to, directly or through others. Null, empty and wordless texts are
alone in their class; a null doc_id takes no part and gets a null class. Repeated rows share a class; rows of one doc_id and
different texts are documents of their own, each in its text's class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import NOT_ALNUM, discard, materialise, mix, powers, record, slices, split_words
from dealspark.llm.repeats import KEY, known

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 2
SAMPLES = BANDS * ROWS
DF_BITS, DF_CHUNK = 18, 4096
#: Bounds of a block of texts that are compared at once.
BLOCK_ROWS, BLOCK_CHARS = 1000, 2 << 20

_rng = np.random.default_rng(20240229)
_TABLE = 1 << 12
#: Samples of Gamma(2, 1), its logarithm, and of a uniform variable, drawn by hash bits.
_R = _rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of row and hash: row, hash, count; and the rows' 128-bit content hashes (rows x 2)."""
    words = split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_ALNUM)
    hashes, n = words.hashes(), np.diff(words.first)
    rows = len(texts)
    content = np.zeros((rows, 2), np.uint64)
    total = np.zeros((2, len(hashes) + 1), np.uint64)
    for k, h in enumerate((hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
        np.cumsum(h * powers(len(h)), dtype=np.uint64, out=total[k, 1:])
        content[:, k] = mix((total[k, words.first[1:]] - total[k, words.first[:-1]]) * powers(len(h) + 1, inverse=True)[words.first[:-1]] + n.astype(np.uint64))
    short = n < SHINGLE
    whole = content[:, 0][short & (n > 0)]
    if len(hashes) >= SHINGLE:
        five = mix((total[0, SHINGLE:] - total[0, :-SHINGLE]) * powers(len(hashes) - SHINGLE + 1, inverse=True))
        row = words.row[: len(five)]
        inside = words.row[SHINGLE - 1 :] == row
        five, row = five[inside], row[inside]
    else:
        five, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    five, row = np.concatenate([five, whole]), np.concatenate([row, np.flatnonzero(short & (n > 0))])
    order = np.lexsort((five, row))
    five, row = five[order], row[order]
    head = np.flatnonzero(np.concatenate([[True], (five[1:] != five[:-1]) | (row[1:] != row[:-1])])) if len(five) else np.zeros(0, np.int64)
    return row[head], five[head], np.diff(np.append(head, len(five))), content


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


_DF = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(1 + N / df) of each hashed bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in slices(batches, "text", 2 << 20):
            _, hashes, _, _ = shingles(batch.column("text"))
            total += np.bincount(_bucket(hashes), minlength=len(total))
            rows += batch.num_rows
        if rows:
            salt = TaskContext.get().partitionId() % 64
            chunks = [np.array([rows]), *np.split(total, len(total) // DF_CHUNK)]
            yield record(_DF, np.arange(-1, len(chunks) - 1, dtype=np.int32), np.full(len(chunks), salt, np.int32), [c.tobytes() for c in chunks])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["counts"].iloc[0], np.int64).copy()
        for c in pdf["counts"].iloc[1:]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "salt": [0], "counts": [total.tobytes()]})

    ddl = "chunk int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, ddl)
    # sums of sums, so that no task gets a number from every task of the scan
    rows = parts.groupBy("chunk", "salt").applyInPandas(add, ddl).groupBy("chunk").applyInPandas(add, ddl).toPandas()
    if not len(rows):
        return np.ones(1 << DF_BITS, np.float32)
    held = {int(c): np.frombuffer(b, np.int64) for c, b in zip(rows["chunk"], rows["counts"], strict=True)}
    df = np.concatenate([held[c] for c in range(len(held) - 1)])
    return np.log1p(held[-1][0] / np.maximum(df, 1)).astype(np.float32)


def samples(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Improved consistent weighted samples, as 32-bit fingerprints: rows x SAMPLES; rows without shingles get 0."""
    out = np.zeros((rows, SAMPLES), np.uint32)
    if not len(row):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    which = row[first]
    sizes = np.diff(np.append(first, len(row)))
    log_w = np.log(weights).astype(np.float32)
    for k in range(SAMPLES):
        h = hashes ^ _SEEDS[k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        bits = (h >> np.uint64(20)).astype(np.int64)
        r = _R[bits & (_TABLE - 1)]
        beta = ((bits >> 12) & 0xFFFF).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + beta)
        log_a = _LOG_C[(bits >> 28) & (_TABLE - 1)] - r * (t - beta + 1)
        low = np.minimum.reduceat(log_a, first)
        at = np.flatnonzero(log_a == np.repeat(low, sizes))
        at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]  # ties: the smaller hash
        out[which, k] = (mix(hashes[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


_SIGNED = pa.schema([(k, pa.int64()) for k in (*KEY, "c1", "c2", "size")] + [("bands", pa.list_(pa.int64()))])


def sign(docs: DataFrame, idf) -> DataFrame:
    """docs: doc, variant, text. Adds content hash (c1, c2), bytes and bands, for the documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            row, hashes, tf, content = shingles(batch.column("text"))
            sig = samples(row, hashes, tf * idf.value[_bucket(hashes)], batch.num_rows)
            some = np.unique(row)
            sig = sig[some]
            bands = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS):
                for j in range(ROWS):
                    bands[:, b] = mix(bands[:, b] * np.uint64(31) + sig[:, b * ROWS + j] + np.uint64(b))
            keys = [batch.column(k).to_numpy()[some] for k in KEY]
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)[some].astype(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * BANDS, pa.array(bands.reshape(-1).view(np.int64)))
            yield record(_SIGNED, *keys, content[some, 0].view(np.int64), content[some, 1].view(np.int64), sizes, flat)

    return docs.select(*KEY, "text").mapInArrow(run, "doc long, variant long, c1 long, c2 long, size long, bands array<long>")


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of texts."""
    ra, ha, ta, _ = shingles(a)
    rb, hb, tb, _ = shingles(b)
    rows = len(a)
    row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
    w = np.concatenate([ta * idf[_bucket(ha)], tb * idf[_bucket(hb)]]).astype(np.float64)
    total = np.bincount(row, w, minlength=rows)
    order = np.lexsort((h, row))
    row, h, w = row[order], h[order], w[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(row[same], np.minimum(w[same], w[same + 1]), minlength=rows)
    return both / np.maximum(total - both, 1e-12)


def verify(pairs: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """pairs: u, v (distinct rows); docs: node, text. Those of them whose texts are similar enough."""
    left = docs.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = docs.select(F.col("node").alias("v"), F.col("text").alias("text_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_v", 1 << 20):
            ok = similarities(batch.column("text_u"), batch.column("text_v"), idf.value) >= threshold
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    both = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component), by alternating large and small stars; edges: u, v."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small)
        sums = [e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first() for e in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def intersections(row: np.ndarray, hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray, rows: int, chunk: int = 2048) -> np.ndarray:
    """Weights that each two of the texts share (rows x rows): counts' levels times the frequencies, as matrix products over
    the shingles that occur in two texts at least."""
    _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code, tf, weight = row[shared], code[shared], tf[shared], idf[_bucket(hashes[shared])].astype(np.float64)
    out = np.zeros((rows, rows))
    below = 0
    for level in np.unique(tf):
        some = tf >= level
        kept, column = np.unique(code[some], return_inverse=True)
        for at in range(0, len(kept), chunk):
            inside = (column >= at) & (column < at + chunk)
            m = np.zeros((rows, min(chunk, len(kept) - at)))
            m[row[some][inside], column[inside] - at] = np.sqrt(weight[some][inside])
            out += (level - below) * (m @ m.T)
        below = level
    return out


def _spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what the given ones connect."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def compare_buckets(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """members: bucket, node, size, label; texts: node, text. Compares exactly all texts of a bucket that are in different
    classes, in blocks of bounded rows and bytes, and returns links (u, v) that connect what is similar. A class that fills
    a block has blocks of its own, which don't meet each other; smaller ones share blocks."""
    open_ = materialise(members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"))
    rows = materialise(members.join(open_, "bucket", "left_semi"))
    size = (F.count("*") / BLOCK_ROWS).alias("rows"), (F.sum("size") / BLOCK_CHARS).alias("bytes")
    large = rows.groupBy("bucket", "label").agg(*size).where("rows >= 0.5 or bytes >= 0.5").select("bucket", "label", F.col("label").alias("own"))
    rows = materialise(rows.join(large, ["bucket", "label"], "left"))
    groups = materialise(rows.groupBy("bucket", "own").agg(*size).select("bucket", "own", F.ceil(F.greatest("rows", "bytes")).cast("int").alias("blocks")))
    name = lambda own, nth: F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("")), nth.cast("string"))
    here = groups.withColumnsRenamed({"own": "own_", "bucket": "bucket_"})
    placed = rows.join(here, (F.col("bucket") == F.col("bucket_")) & F.col("own").eqNullSafe(F.col("own_"))).select("bucket", "own", "node", "label", name(F.col("own"), F.pmod(F.xxhash64("node"), "blocks")).alias("block"))
    others = groups.select("bucket", F.col("own").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth")).select("bucket", "of", name(F.col("of"), F.col("nth")).alias("other"))
    # a block meets itself (side 2) and each block of other classes (sides 0 and 1)
    meets = placed.join(others, "bucket").where(F.col("own").isNull() | F.col("of").isNull() | (F.col("own") != F.col("of")))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    meets = meets.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), side.alias("side"), "node", "label")
    dealt = meets.join(texts.select("node", "text"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        ids, labels, sides = (pdf[c].to_numpy() for c in ("node", "label", "side"))
        row, hashes, tf, _ = shingles(pa.array(pdf["text"].tolist(), pa.large_string()))
        total = np.bincount(row, tf * idf.value[_bucket(hashes)].astype(np.float64), minlength=len(ids))
        both = intersections(row, hashes, tf, idf.value, len(ids))
        similar = both >= threshold * (total[:, None] + total[None, :] - both) * (1 - 1e-12)
        similar &= (labels[:, None] != labels[None, :]) & ((sides[:, None] == 2) | (sides[:, None] != sides[None, :]))
        u, v = np.nonzero(np.triu(similar, 1))
        links = _spanning(ids[u], ids[v])
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return dealt.groupBy("bucket", "a", "b").applyInPandas(compare, "u long, v long").distinct()


def classes(rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """rows: doc, variant, text. Returns doc, variant and the first row of its class (first_doc, first_variant), for texts
    that have words."""
    spark = rows.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows))
    node = F.when(F.col("variant") == 0, F.col("doc")).otherwise(F.col("variant")).alias("node")
    texts = rows.where(F.col("text").isNotNull())
    signed = materialise(sign(texts, idf))
    # one row stands for all of the same words
    nodes = materialise(signed.groupBy("c1", "c2").agg(F.min(node).alias("node"), F.min(F.struct(*KEY)).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    texts = texts.select(node, "text")
    filed = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    # heads are written first, so that the join reads them by a shuffle of its own and splits frequent buckets
    heads = materialise(filed.groupBy("bucket").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").select("bucket", "u"))
    members = materialise(filed.join(heads, "bucket").select("bucket", "u", F.col("node").alias("v"), "size"))
    stars = members.where("u <> v").select("u", "v").distinct()
    linked = materialise(verify(stars, texts, idf, threshold).distinct())
    labels = materialise(components(linked))
    tagged = members.join(labels, members["v"] == labels["node"], "left").select("bucket", F.col("v").alias("node"), "size", F.coalesce("label", "v").alias("label"))
    more = materialise(compare_buckets(tagged, texts, idf, threshold))
    discard(members, heads)
    labels = components(linked.unionByName(more))
    placed = materialise(nodes.join(labels, "node", "left").select("c1", "c2", "first", F.coalesce("label", "node").alias("label")))
    firsts = materialise(placed.groupBy("label").agg(F.min("first").alias("first")))
    found = materialise(placed.drop("first").join(firsts, "label").select("c1", "c2", "first"))
    return signed.join(found, ["c1", "c2"]).select(*KEY, F.col("first.doc").alias("first_doc"), F.col("first.variant").alias("first_variant")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs: doc_id long, text. Returns doc_id, class_id (the smallest doc_id of the class)."""
    rows = known(docs.where(F.col("doc_id").isNotNull()))
    found = rows.drop("text").join(classes(rows, threshold), list(KEY), "left").select("doc_id", F.coalesce("first_doc", "doc_id").alias("class_id"))
    return found.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents whose class has a smaller one (by doc_id, then a hash of the text), columns unchanged; a
    repeated row stays once, rows of null doc_id stay."""
    names = {c: f"keep_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    rows = known(own.where(F.col("doc_id").isNotNull()), *names.values())
    joined = rows.join(classes(rows), list(KEY), "left")
    first = F.col("first_doc").isNull() | ((F.col("first_doc") == F.col("doc")) & (F.col("first_variant") == F.col("variant")))
    kept = joined.where(first).dropDuplicates(list(KEY)).select(*names.values())
    kept = kept.unionByName(own.where(F.col("doc_id").isNull()).select(*names.values()))
    return kept.withColumnsRenamed({a: c for c, a in names.items()})


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
