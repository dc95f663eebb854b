"""Retrieval: BM25, TF-IDF, keyword, vector and hybrid search, many queries per job (r01-r18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from dealspark.functions import text as X
from dealspark.functions import vectors as V
from dealspark.operators.relational import top_per_group

#: Largest number of queries' terms that is broadcast (some 10 MB); beyond it Spark joins them by a shuffle.
BROADCAST_TERMS = 200_000
#: Vectors of a block, and the fewest of one where more blocks keep more tasks busy; scores that a task holds at once.
BLOCK_ROWS, LEAST_ROWS, SCORES = 32768, 4096, 1 << 22
#: Documents whose postings make one task, and pairs of posting and query (or of document and query) that are added up at once.
DOCS, PAIRS = 8192, 1 << 21


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


class TextIndex:
    """r01: postings (doc, term, tf, length), document frequencies, number and mean length of documents."""

    def __init__(self, docs: DataFrame, key: str, text: str, terms: DataFrame | None = None):
        words = docs.select(F.col(key).alias("doc"), X.letter_runs(F.col(text)).alias("w"))
        sized = words.select("doc", F.size("w").alias("length"), F.explode("w").alias("term"))
        self.stats = words.agg(F.count("*").alias("N"), F.avg(F.size("w")).alias("avgdl"))
        if terms is not None:  # only the queries' terms are counted and shuffled
            sized = sized.join(terms, "term", "left_semi")
        self.postings = sized.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
        self.df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.size = docs.count


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("qid", F.explode(X.letter_runs(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def parts_of(spark: SparkSession, docs: int) -> int:
    """Tasks for a number of documents: at most DOCS each, and down to a sixteenth of that to keep all tasks of a shuffle busy."""
    return max(1, -(-docs // DOCS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs * 16 // DOCS)))


def _best(weights: DataFrame, terms: DataFrame, n: int, k: int, docs: int, by_times: bool) -> DataFrame:
    """The best k documents of each query by the sum of the weights (doc, term, w) of its terms, rounded to four digits.

    Weights are dealt by document, so that no pair of query and document is shuffled but the best k of each task. Every task adds up
    blocks of documents by queries in arrays of bounded size. More than BROADCAST_TERMS terms of queries meet the weights in a join."""
    best = [F.desc("score"), F.asc("doc")]
    if n > BROADCAST_TERMS:
        of = weights.join(terms, "term")
        total = of.groupBy("qid", "doc").agg(F.round(F.sum(F.col("w") * F.col("qtf") if by_times else F.col("w")), 4).alias("score")).where("score > 0")
        return top_per_group(total, ["qid"], best, k)
    spark, asked = weights.sparkSession, sorted(terms.collect(), key=lambda r: r["term"])
    words, tid = np.unique(np.array([r["term"] for r in asked], object), return_inverse=True)
    qids = list(dict.fromkeys(r["qid"] for r in asked))
    number = {q: i for i, q in enumerate(qids)}
    first = np.searchsorted(tid, np.arange(len(words) + 1))
    held = spark.sparkContext.broadcast((qids, first, np.array([number[r["qid"]] for r in asked], np.int64), np.array([r["qtf"] if by_times else 1 for r in asked], np.float64)))
    ids = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, tid int")
    schema = StructType([StructField("qid", terms.schema["qid"].dataType), StructField("doc", weights.schema["doc"].dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_batches = [b for b in batches if b.num_rows]
        if not held_batches:
            return
        names, first, query, times = held.value
        rows = pa.Table.from_batches(held_batches)
        docs = pc.unique(rows["doc"])
        docs = docs.take(pc.array_sort_indices(docs, null_placement="at_start"))
        code, term = pc.index_in(rows["doc"], docs).to_numpy().astype(np.int64), rows["tid"].to_numpy()
        order = np.lexsort((term, code))  # sums don't depend on the order of arrival
        code, term, w = code[order], term[order], rows["w"].to_numpy()[order]
        wide = np.diff(first)[term]
        starts = np.searchsorted(code, np.arange(len(docs) + 1))
        pairs = np.concatenate([[0], np.cumsum(wide)])[starts]
        none = np.zeros(0, np.int64)
        top, least, at = (none, none, np.zeros(0)), np.zeros(len(names)), 0
        while at < len(docs):
            end = int(min(np.searchsorted(pairs, pairs[at] + PAIRS, "right") - 1, at + max(1, PAIRS // len(names)), len(docs)))
            end = max(at + 1, end)
            a, b = starts[at], starts[end]
            size = wide[a:b]
            nth = np.repeat(first[term[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat((code[a:b] - at) * len(names), size) + query[nth]
            score = np.bincount(cell, np.repeat(w[a:b], size) * times[nth], (end - at) * len(names)).reshape(-1, len(names))
            score = np.floor(score * 1e4 + 0.5) / 1e4
            d, q = np.nonzero((score > 0) & (score >= least))
            q, d, s = (np.concatenate(x) for x in zip(top, (q, d + at, score[d, q]), strict=True))
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            least[q[rank == k - 1]] = s[rank == k - 1]
            top, at = (q[rank < k], d[rank < k], s[rank < k]), end
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in top[0]], target.field("qid").type), docs.take(pa.array(top[1])).cast(target.field("doc").type), pa.array(top[2])], schema=target)

    target = to_arrow_schema(schema)
    dealt = weights.join(F.broadcast(ids), "term").select("doc", "tid", "w").repartition(parts_of(spark, docs), "doc")
    return top_per_group(dealt.mapInArrow(run, schema), ["qid"], best, k)


def score_bm25(index, terms: DataFrame, n: int, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """index: postings, df, stats and size; terms: qid, term, of n rows."""
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    weights = index.postings.join(maybe_broadcast(index.df, n), "term").join(F.broadcast(index.stats)).select("doc", "term", weight.alias("w"))
    return _best(weights, terms, n, k, index.size(), False)


def score_tfidf(index, terms: DataFrame, n: int, k: int) -> DataFrame:
    weight = F.col("tf") / F.col("length") * (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1)
    weights = index.postings.join(maybe_broadcast(index.df, n), "term").join(F.broadcast(index.stats)).select("doc", "term", weight.alias("w"))
    return _best(weights, terms, n, k, index.size(), True)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """r02: queries: qid, text. Best k of each query with a score above 0; repeated query terms count once. Indexes the documents for
    this search alone; `textindex.InvertedIndex` keeps an index."""
    terms = query_terms(queries, "text")
    n = terms.count()
    return score_bm25(TextIndex(docs, key, text, maybe_broadcast(terms.select("term").distinct(), n)), terms, n, k, k1, b)


def bm25_within(docs: DataFrame, group: str, key: str, text: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """r02 with an index of each group's own: numbers, mean lengths, document frequencies and ranks are those of the group.
    Keys need to be unique within their group only. Queries that have the group's column are put to that group alone."""
    terms, on = query_terms(queries, "text"), ["term"]
    if group in queries.columns:
        terms, on = terms.join(queries.select("qid", group), "qid"), [group, "term"]
    n = terms.count()
    words = docs.select(group, F.col(key).alias("doc"), X.letter_runs(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    stats = words.groupBy(group).agg(F.count("*").alias("N"), F.avg("length").alias("avgdl"))
    sized = words.select(group, "doc", "length", F.explode("w").alias("term")).join(maybe_broadcast(terms.select(*on).distinct(), n), on, "left_semi")
    postings = sized.groupBy(group, "doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = postings.groupBy(group, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    scored = postings.join(df, [group, "term"]).join(stats, group).select(group, "doc", "term", weight.alias("w")).join(maybe_broadcast(terms, n), on)
    total = scored.groupBy(group, "qid", "doc").agg(F.round(F.sum("w"), 4).alias("score")).where("score > 0")
    return top_per_group(total, [group, "qid"], [F.desc("score"), F.asc("doc")], k)


def tfidf(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """r03: tf = count / length, idf = ln((N+1)/(df+1)) + 1; repeated query terms add."""
    terms = query_terms(queries, "text")
    n = terms.count()
    return score_tfidf(TextIndex(docs, key, text, maybe_broadcast(terms.select("term").distinct(), n)), terms, n, k)


def dedupe_hits(hits: DataFrame, docs: DataFrame, key: str, text: str, chars: int, n: int) -> DataFrame:
    """r04: of hits whose texts begin alike the best stays, then the best n of each query."""
    named = hits.join(docs.select(F.col(key).alias("doc"), F.substring(text, 1, chars).alias("head")), "doc")
    once = top_per_group(named.drop("rank"), ["qid", "head"], [F.desc("score"), F.asc("doc")], 1).drop("rank")
    return top_per_group(once.drop("head"), ["qid"], [F.desc("score"), F.asc("doc")], n)


def accumulate(hits: DataFrame, docs: DataFrame, key: str, text: str, chars: int, k: int) -> DataFrame:
    """r05: scores of all queries summed over texts that begin alike."""
    named = hits.join(docs.select(F.col(key).alias("doc"), F.substring(text, 1, chars).alias("head")), "doc")
    return named.groupBy("head").agg(F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("hits")).orderBy(F.desc("score"), "head").limit(k)


def mail_queries(mails: DataFrame, key: str, text: str, company: str, terms: list[str]) -> DataFrame:
    """r05: up to three queries of each mail: its text, its company, and the finance terms found in it."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(terms)})\b"), 1))
    asked = F.posexplode(F.array(F.col(text), F.col(company), F.array_join(found, " "))).alias("part", "text")
    return mails.select(key, asked).where("text <> ''").select((F.col(key) * 3 + F.col("part")).alias("qid"), F.col(key).alias("mail"), "text")


def search_for_mails(docs: DataFrame, key: str, text: str, queries: DataFrame, chars: int, k: int) -> DataFrame:
    """r05: the scores of a mail's queries are added over texts that begin alike; the best k of each mail."""
    hits = bm25(docs, key, text, queries, k).join(queries.select("qid", "mail"), "qid")
    named = hits.join(docs.select(F.col(key).alias("doc"), F.substring(text, 1, chars).alias("head")), "doc")
    total = named.groupBy("mail", "head").agg(F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("hits"))
    return top_per_group(total, ["mail"], [F.desc("score"), F.asc("head")], k)


def density(text: Column, terms: list[str]) -> Column:
    """r06: occurrences of terms over two characters per word, times 50."""
    low = F.lower(text)
    total = sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms if len(t) > 2), F.lit(0.0))
    return F.round(total / F.greatest(F.size(X.blank_split(text)), F.lit(1)) * 50, 3)


def keyword_score(text: Column, query: str) -> Column:
    """r07: Jaccard similarity of the word sets, and a half if the phrase is contained."""
    a = F.array_distinct(X.blank_split(X.search_form(text)))
    b = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    any_ = F.size(F.array_union(a, b))
    return F.round(F.when(any_ > 0, F.size(F.array_intersect(a, b)) / any_).otherwise(0.0) + F.when(X.search_form(text).contains(query.lower()), 0.5).otherwise(0.0), 6)


METRICS = {"cosine": V.cosine, "l2": lambda a, b: -V.l2(a, b), "inner": V.dot}


def scores(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """Scores of all vectors (id, v) for a few queries (qid, v), as expressions; nothing is ordered."""
    pairs = vectors.join(queries.select("qid", F.col("v").alias("qv")), F.col("qid") != F.col("id"))
    scored = pairs.select("qid", "id", F.round(METRICS[metric](F.col("v"), F.col("qv")), 6).alias("score"))
    return scored if least is None else scored.where(F.col("score") >= least)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """r11: the best k of each query, of those that score `least` or more."""
    return knn_blocks(vectors, queries, k, metric, least)


def _products(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs; a vector of no length has the cosine 0."""
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None] - 2 * (q @ v.T), 0))
    if metric == "cosine":
        q, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (q, v))
    return q @ v.T


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """r11: a task holds one block of vectors, and all queries stream past it row by row; a bounded number of them is multiplied with it
    at once. Every block returns its best k of each query, and the best of those stay. Rows without id or vector take no part."""
    kept = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = kept.count()
    n = max(1, -(-rows // BLOCK_ROWS), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)))
    kind = vectors.schema["v"].dataType if vectors.schema["v"].dataType == queries.schema["v"].dataType == ArrayType(FloatType(), True) else ArrayType(DoubleType(), True)
    of = lambda df, key, asks, block: df.select(block.alias("b"), F.lit(asks).alias("asks"), F.col(key).cast("long").alias("id"), F.col("v").cast(kind).alias("v"))
    held = of(kept, "id", False, F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n)).cast("int"))
    asked = of(queries.where(F.col("qid").isNotNull() & F.col("v").isNotNull()), "qid", True, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the vectors as one matrix."""
        v = batch.column("v")
        if pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
            raise ValueError("vectors differ in length")
        return batch.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)

    def best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        # rounded, with ties to the smaller id
        scores = np.round(_products(q, v, metric), 6)
        scores[(qid[:, None] == ids[None, :]) | np.isnan(scores) | (scores < (-np.inf if least is None else least))] = -np.inf
        cut = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        row, at = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
        order = np.lexsort((ids[at], -scores[row, at], row))
        row, at = row[order], at[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at = row[top], at[top]
        return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[at]), pa.array(scores[row, at])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = -1, []  # a block's vectors come before its queries
        for batch in batches:
            at, b, asks = 0, batch.column("b").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            while at < len(b):
                same = (b[at:] == b[at]) & (asks[at:] == asks[at])
                end = at + (len(same) if same.all() else int(same.argmin()))
                if b[at] != block:
                    block, parts = b[at], []
                if not asks[at]:
                    parts.append(matrix(batch.slice(at, end - at)))
                elif parts:
                    if len(parts) > 1:
                        if len({v.shape[1] for _, v in parts}) > 1:
                            raise ValueError("vectors differ in length")
                        parts = [tuple(np.concatenate(x) for x in zip(*parts, strict=True))]
                    qid, q = matrix(batch.slice(at, end - at))
                    for i in range(0, len(qid), size := max(1, SCORES // len(parts[0][0]))):
                        yield best(qid[i : i + size], q[i : i + size], *parts[0])
                at = end

    dealt = held.unionByName(asked).repartitionById(n, "b").sortWithinPartitions("b", "asks", "id")
    return top_per_group(dealt.mapInArrow(run, "qid long, id long, score double"), ["qid"], [F.desc("score"), F.asc("id")], k)


def hybrid_gated(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """r08: keyword matches (id, kw) with the vector similarity (id, sim) where it is known; .3 and .7 of each."""
    j = keyword.join(vector, "id", "left")
    return j.select("id", F.round(0.3 * F.col("kw") + 0.7 * F.coalesce("sim", F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_merge(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """r09: in both .3 and .7, semantic only .7, keyword only in full."""
    j = keyword.join(semantic, "id", "full")
    score = F.when(F.col("kw").isNull(), 0.7 * F.col("sim")).when(F.col("sim").isNull(), F.col("kw")).otherwise(0.3 * F.col("kw") + 0.7 * F.col("sim"))
    return j.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_concat(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """r10: per query the first method's hits by rank, then the second's that aren't among them."""
    rows = first.select("qid", "id", F.lit(0).alias("method"), "rank").unionByName(second.select("qid", "id", F.lit(1).alias("method"), "rank"))
    once = rows.groupBy("qid", "id").agg(F.min(F.struct("method", F.col("rank").alias("r"))).alias("m"))
    return top_per_group(once.select("qid", "id", F.col("m.method").alias("method"), F.col("m.r").alias("r")), ["qid"], [F.asc("method"), F.asc("r"), F.asc("id")], k).select("qid", "id", "method", "rank")


def cell_knn(vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.9) -> DataFrame:
    """r12: builds an index of the vectors for this search alone; `annindex.VectorIndex` keeps one."""
    from dealspark.operators.annindex import VectorIndex
    from dealspark.streaming.streams import shared_folder

    return VectorIndex.build(vectors, shared_folder(vectors.sparkSession), k, recall).search(queries, k)


def mean_vector(vectors: DataFrame, key: list[str]) -> DataFrame:
    """g04, r13: component means per key, by a mergeable aggregate: a task gives on one row for a key. Vectors that are null or hold a
    null take no part; of several lengths under one key that of most vectors counts (ties: the shortest)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    whole = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select(*key, F.size("v").alias("_size"), array_to_vector(F.col("v").cast("array<double>")).alias("_v"))
    means = whole.groupBy(*key, "_size").agg(Summarizer.mean(F.col("_v")).alias("_mean"), F.count("*").alias("_n"))
    return means.groupBy(*key).agg(F.max_by("_mean", F.struct("_n", -F.col("_size"))).alias("_mean")).select(*key, vector_to_array("_mean").alias("v"))


def vector_arithmetic(vectors: DataFrame, positive: Column, negative: Column, k: int) -> DataFrame:
    """r13: nearest to the mean of the positive less that of the negative vectors."""
    p = mean_vector(vectors.where(positive).select(F.lit(0).alias("g"), "v"), ["g"]).select("g", F.col("v").alias("p"))
    n = mean_vector(vectors.where(negative).select(F.lit(0).alias("g"), "v"), ["g"]).select("g", F.col("v").alias("n"))
    target = p.join(n, "g").select(F.lit(-1).cast("long").alias("qid"), F.zip_with("p", "n", lambda a, b: a - b).alias("v"))
    return knn(vectors, target, k)


def contextual_rank(cands: DataFrame, k: int) -> DataFrame:
    """r15: cands: qid, id, distance, same_type, entities, topics, importance, expired."""
    score = 1 / (1 + F.col("distance")) * F.when(F.col("same_type"), 1.3).otherwise(1.0) * (1 + 0.2 * F.col("entities")) * (1 + 0.15 * F.col("topics")) * (0.5 + F.col("importance")) * F.when(F.col("expired"), 0.5).otherwise(1.0)
    return top_per_group(cands.select("qid", "id", F.round(score, 6).alias("score")), ["qid"], [F.desc("score"), F.asc("id")], k)


def assemble_context(hits: DataFrame, docs: DataFrame, key: str, text: str, n: int, rows: int | None = None) -> DataFrame:
    """r16: the hits' texts of each query joined in the order of rank, at most n characters. rows: how many hits there are at most, if that is
    known; few go to the texts, which then aren't shuffled."""
    named = (hits if rows is None else maybe_broadcast(hits, rows)).join(docs.select(F.col(key).alias("doc"), F.col(text).alias("_t")), "doc")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda s: s["_t"]), "\n")
    return named.groupBy("qid").agg(F.substring(joined, 1, n).alias("context"))


def with_background(contexts: DataFrame, projections: DataFrame, history: DataFrame) -> DataFrame:
    """r16: contexts (qid, context) followed by the known projections (qid, yr, value) and the turns so far (qid, turn, role,
    text), each in order."""

    def lines(df: DataFrame, order: str, line: Column, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda r: r["line"])
        return df.groupBy("qid").agg(F.array_join(ordered, "\n").alias(name))

    known = lines(projections, "yr", F.format_string("- Revenue for %s: %s", "yr", "value"), "known")
    said = lines(history, "turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))), "said")
    parts = F.concat_ws("\n\n", F.col("context"), F.concat(F.lit("Known projections:\n"), F.col("known")), F.concat(F.lit("Conversation so far:\n"), F.col("said")))
    return contexts.join(known, "qid", "left").join(said, "qid", "left").select("qid", parts.alias("context"))


def compare_methods(hits: DataFrame) -> DataFrame:
    """a26: hits and best score per query and method (qid, method, score)."""
    return hits.groupBy("qid").pivot("method", ["bm25", "tfidf"]).agg(F.count("score").alias("hits"), F.max("score").alias("top"))


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """r18: hashed term counts, weighted by inverse document frequency and normalised; needs no remote model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.select(key, X.letter_runs(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    model = Pipeline(stages=[HashingTF(inputCol="w", outputCol="tf", numFeatures=dim), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="f")]).fit(words)
    return model.transform(words).select(key, vector_to_array("f", "float32").alias("v"))
