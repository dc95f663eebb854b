"""r01: a stored inverted index. Searches (r02-r05, a26, r16) read the buckets of their terms and build nothing.

Under one folder lie, by epoch (one for each change) and, where it says so, by bucket of the term's hash:

    postings (bucket)  term, doc, tf, length; in bucket -1 every document once with a null term, and its number of words (null for a null text) as length
    df (bucket)        term, df: how much the epoch adds to the number of documents with the term (less than 0: takes away)
    lengths            doc, n: words of a document, null for a null text
    stats              N, sized, total: the same for the number of documents, of those with a text, and of words
    gone               doc: documents whose postings of earlier epochs no longer count
    manifest           written last; an epoch without it is not read

Files of a bucket are written by document, about S.DOCS each, so a term of very many documents is no single task. Texts are cut into runs of letters.
Null and empty texts are documents without words (a null text counts in N, not in the mean length); documents without a key are left out. Rows that repeat a key in one change are
one document whose words add up. A document that is added again replaces the earlier one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspark.functions import text as X
from dealspark.operators import retrieve as S

BUCKETS = 32


def bucket(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class View:
    """What the scoring of a search needs: of the index's tables the rows of some terms, or all."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame

    def size(self) -> int:
        """Number of documents."""
        return self.stats.first()["N"] or 0


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Opens an index; a folder without one is an empty index once `create` has been called."""
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> InvertedIndex:
        index = cls(spark, path)
        index._write(spark.createDataFrame([], "at int, taken long"), "manifest", -1)
        return index.add(docs, key, text)

    def _write(self, df: DataFrame, table: str, epoch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}/epoch={epoch}")

    def _epochs(self) -> dict[int, int]:
        """Committed changes, and how many documents each took out."""
        return {r["at"]: r["taken"] for r in self.spark.read.schema("at int, taken long").parquet(f"{self.path}/manifest").collect()}

    def _commit(self, epoch: int, taken: int = 0) -> None:
        self._write(self.spark.createDataFrame([(epoch, taken)], "at int, taken long").coalesce(1), "manifest", epoch)

    _SCHEMAS = {"postings": "term string, doc long, tf long, length int, bucket int", "df": "term string, df long, bucket int", "lengths": "doc long, n long", "stats": "N long, sized long, total long", "gone": "doc long"}

    def _read(self, table: str, epochs: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        """Rows of the committed epochs; of some buckets alone their folders are listed and read."""
        df = self.spark.read.schema(f"{self._SCHEMAS[table]}, epoch int").parquet(f"{self.path}/{table}").where(F.col("epoch").isin(list(epochs)))
        if buckets is not None:
            return df.where(F.col("bucket").isin(buckets))
        return df.where("bucket >= 0") if table == "postings" else df

    def _live(self, rows: DataFrame, epochs: dict[int, int]) -> DataFrame:
        """Rows of documents that have not gone since."""
        taken = sum(epochs.values())
        if not taken:
            return rows
        gone = self._read("gone", epochs).groupBy("doc").agg(F.max("epoch").alias("until"))
        return rows.join(S.maybe_broadcast(gone, taken), "doc", "left").where("until is null or epoch > until").drop("until")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> InvertedIndex:
        """Adds documents, replacing those of the same key."""
        epochs = self._epochs()
        epoch = max(epochs, default=-1) + 1
        keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        if epochs:
            self._drop(keyed.select("doc").distinct(), epoch)
            epoch += 1
        # texts alone are shuffled, and cut into words once: a document's postings are counted where its text is, and written to their buckets from there
        parts = S.parts_of(self.spark, keyed.count())
        whole = keyed.repartition(parts, "doc").groupBy("doc").agg(F.collect_list("text").alias("texts"))
        words = whole.select("doc", F.when(F.size("texts") > 0, F.flatten(F.transform("texts", X.letter_runs))).alias("w"))
        each = words.select("doc", F.size("w").alias("length"), F.explode(F.array_append(F.coalesce("w", F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("term"))
        counted = each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
        rows = counted.select("term", "doc", "tf", "length", F.when(F.col("term").isNull(), -1).otherwise(bucket(F.col("term"))).alias("bucket"))
        self._write(rows.sortWithinPartitions("bucket", "term"), "postings", epoch, "bucket")
        every = self.spark.read.schema(self._SCHEMAS["postings"]).parquet(f"{self.path}/postings/epoch={epoch}")
        self._write(every.where("bucket = -1").select("doc", F.col("length").cast("long").alias("n")), "lengths", epoch)
        lengths = self.spark.read.schema(self._SCHEMAS["lengths"]).parquet(f"{self.path}/lengths/epoch={epoch}")
        self._write(every.where("bucket >= 0").groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket"), "df", epoch, "bucket")
        self._write(self._sums(lengths, 1), "stats", epoch)
        self._write(self.spark.createDataFrame([], "doc long"), "gone", epoch)
        self._commit(epoch)
        return self

    def remove(self, keys: DataFrame, key: str = "doc_id") -> InvertedIndex:
        """Takes documents out."""
        self._drop(keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc")).distinct(), max(self._epochs(), default=-1) + 1)
        return self

    def _drop(self, docs: DataFrame, epoch: int) -> None:
        """An epoch that takes away what the documents' postings, read once, gave."""
        self._write(docs, "gone", epoch)
        docs = self.spark.read.schema("doc long").parquet(f"{self.path}/gone/epoch={epoch}")
        epochs = self._epochs()
        old = self._live(self._read("postings", epochs).join(docs, "doc", "left_semi"), epochs)
        self._write(old.groupBy("bucket", "term").agg((-F.count("*")).alias("df")), "df", epoch, "bucket")
        self._write(self._sums(self._live(self._read("lengths", epochs).join(docs, "doc", "left_semi"), epochs), -1), "stats", epoch)
        self._write(self.spark.createDataFrame([], self._SCHEMAS["lengths"]), "lengths", epoch)
        self._write(self.spark.createDataFrame([], "term string, doc long, tf long, length int, bucket int"), "postings", epoch, "bucket")
        self._commit(epoch, docs.count())

    @staticmethod
    def _sums(lengths: DataFrame, sign: int) -> DataFrame:
        return lengths.agg(*[(F.lit(sign) * c).alias(name) for c, name in ((F.count("*"), "N"), (F.count("n"), "sized"), (F.coalesce(F.sum("n"), F.lit(0)), "total"))])

    def stats(self) -> DataFrame:
        """One row: N documents with mean length avgdl."""
        return self._read("stats", self._epochs()).agg(F.sum("N").alias("N"), F.try_divide(F.sum("total"), F.sum("sized")).alias("avgdl"))

    def lengths(self) -> DataFrame:
        epochs = self._epochs()
        return self._live(self._read("lengths", epochs), epochs).select("doc", "n")

    def view(self, terms: DataFrame | None = None, n: int = 0) -> View:
        """All of the index, or the rows of some terms (term; n: about how many): their buckets alone are read."""
        buckets = None if terms is None else [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]
        epochs = self._epochs()
        postings, df = self._read("postings", epochs, buckets), self._read("df", epochs, buckets)
        if terms is not None:
            wanted = S.maybe_broadcast(terms.select("term").distinct(), n)
            postings, df = postings.join(wanted, "term", "left_semi"), df.join(wanted, "term", "left_semi")
        return View(self._live(postings, epochs).select("doc", "term", "tf", "length"), df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), self.stats())

    def bm25(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """r02 on the stored index."""
        terms = S.query_terms(queries, "text")
        n = terms.count()
        return S.score_bm25(self.view(terms, n), terms, n, k, k1, b)

    def tfidf(self, queries: DataFrame, k: int) -> DataFrame:
        """r03 on the stored index."""
        terms = S.query_terms(queries, "text")
        n = terms.count()
        return S.score_tfidf(self.view(terms, n), terms, n, k)
