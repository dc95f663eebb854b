"""c00: texts scored by a table of terms.

A lexicon is a table of category, ord (order of the categories), term, weight and kind:
substring (anywhere in the lower-cased text; occurrences don't overlap), word (one word or a phrase, as whole words between
anything but letters, digits and apostrophes) and regex (on the lower-cased text). Rows count as they stand: a term listed twice in a
category is two hits. Null and empty terms, null texts and texts without a hit have no occurrence; rows that share a key are one
document; a lexicon without rows finds nothing.

Substrings go through an automaton that every task builds once from the broadcast terms, words by a join of word n-grams, regexes as
unrolled expressions. A lexicon of more characters than `limit` isn't broadcast: its substrings are joined by their rarest grams (j04)
and its words by a shuffle, with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dealspark.functions import text as X
from dealspark.operators.classify import padded
from dealspark.operators.relational import mention_join

#: Characters of all terms up to which they are broadcast (an automaton of some 200 MB in a task at most).
LIMIT = 1_000_000
LEXICON = "category string, ord int, term string, weight double, kind string"


def automaton(terms: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, (i, len(t)))
    out.make_automaton()
    return out


def counts(found, text: str) -> dict[int, int]:
    """How often each term of the automaton occurs in a text, from the left and without overlap with itself."""
    free: dict[int, int] = {}
    times: dict[int, int] = {}
    for end, (i, n) in found.iter(text):
        if end - n + 1 >= free.get(i, 0):
            free[i] = end + 1
            times[i] = times.get(i, 0) + 1
    return times


def net_weight(weights: dict[str, float]) -> Callable[[], Callable[[pd.Series], pd.Series]]:
    """A model for `pluggable.verdict` (g02): the weighted occurrences of the terms in lower-cased texts, 0 for null."""

    def load():
        terms = list(weights)
        found, values = automaton(terms), [weights[t] for t in terms]
        return lambda texts: pd.Series([round(sum(n * values[i] for i, n in counts(found, t).items()), 6) if t else 0.0 for t in texts], dtype="float64")

    return load


def _by_automaton(low: DataFrame, terms: list[str]) -> DataFrame:
    """low: k, low. Rows of k, term, n."""
    held = low.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(held.value)
        for batch in batches:
            rows = [(at, held.value[i], n) for at, text in enumerate(batch.column(1).to_pylist()) for i, n in counts(found, text).items()]
            at, words, times = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["k", "term", "n"])

    return low.mapInArrow(run, StructType([low.schema["k"], StructField("term", StringType()), StructField("n", LongType())]))


def _by_grams(low: DataFrame, terms: DataFrame) -> DataFrame:
    pairs = mention_join(terms.select("term"), "term", low, "low")
    return pairs.select("k", "term", ((F.length("low") - F.length(F.replace("low", "term", F.lit("")))) / F.length("term")).cast("long").alias("n"))


def _by_words(low: DataFrame, terms: DataFrame, sizes: list[int]) -> DataFrame:
    words = F.filter(F.split(padded(F.col("low")), " "), lambda w: w != "")
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    every = X.let(words, lambda w: F.flatten(F.array(*[w if n == 1 else runs(w, n) for n in sizes])))
    # explode_outer here and below: Spark works out the argument of explode again in a filter that it puts before it
    return low.select("k", F.explode_outer(every).alias("term")).join(terms.select("term"), "term").groupBy("k", "term").agg(F.count("*").alias("n"))


def _by_patterns(low: DataFrame, patterns: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("term"), F.regexp_count("low", F.lit(p)).cast("long").alias("n")) for p in patterns])
    return low.select("k", F.explode_outer(F.filter(each, lambda x: x["n"] > 0)).alias("x")).where("x is not null").select("k", "x.term", "x.n")


def occurrences(df: DataFrame, key: str, text: str, lexicon: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, ord, category, term, weight, kind and n, for every row of the lexicon that a document has. The kinds, lengths and sizes of
    the terms are asked for while the plan is made."""
    rows = lexicon.where(F.length("term") > 0).select("category", "ord", F.when(F.col("kind") == "regex", F.col("term")).when(F.col("kind") == "word", F.trim(padded(F.col("term")))).otherwise(F.lower("term")).alias("term"), "weight", "kind").where("term <> ''")
    terms = rows.select("kind", "term").distinct()
    held = {r["kind"]: r for r in terms.groupBy("kind").agg(F.sum(F.length("term")).alias("chars"), F.collect_set(F.size(F.split("term", " "))).alias("sizes")).collect()}
    if unknown := sorted(set(map(str, held)) - {"substring", "word", "regex"}):
        raise ValueError(f"unknown kinds of terms: {', '.join(unknown)}")
    small = lambda kind: held[kind]["chars"] <= limit
    of = lambda kind: terms.where(F.col("kind") == kind).select("term")
    low = df.select(F.col(key).alias("k"), F.lower(text).alias("low")).where("low is not null")
    parts: list[DataFrame] = []
    if "substring" in held:
        parts.append((_by_automaton(low, sorted(r.term for r in of("substring").collect())) if small("substring") else _by_grams(low, of("substring"))).withColumn("kind", F.lit("substring")))
    if "word" in held:
        parts.append(_by_words(low, F.broadcast(of("word")) if small("word") else of("word"), sorted(held["word"]["sizes"])).withColumn("kind", F.lit("word")))
    if "regex" in held:
        parts.append(_by_patterns(low, sorted(r.term for r in of("regex").collect())).withColumn("kind", F.lit("regex")))
    if not parts:
        parts = [low.limit(0).select("k", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit("").alias("kind"))]
    found = reduce(DataFrame.unionByName, parts).groupBy("k", "kind", "term").agg(F.sum("n").alias("n"))
    entries = F.broadcast(rows) if sum(r["chars"] for r in held.values()) <= limit else rows
    return found.join(entries, ["kind", "term"]).select(F.col("k").alias(key), "ord", "category", "term", "weight", "kind", "n")


def score(df: DataFrame, key: str, text: str, lexicon: DataFrame, mode: str = "count", none: str | None = None, tie: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Modes: `any`: key and every category with a hit. `count`: those with hits (rows of the lexicon found), occurrences and their weighted
    score (weights to six decimals; a row without a weight adds nothing). `first_class`: one row per key with the category that comes first by ord.
    `argmax`: one row per key with the category of most hits; of equals the first, or `tie` where that is given. `none` is the category of a
    key without a hit."""
    weighted = F.sum(F.col("n") * F.coalesce(F.col("weight"), F.lit(0.0)).cast("decimal(18,6)"))
    found = occurrences(df, key, text, lexicon, limit)
    per = found.groupBy(key, "ord", "category").agg(F.count("*").alias("hits"), F.sum("n").alias("occurrences"), weighted.cast("double").alias("score"))
    if mode == "any":
        return found.select(key, "category").distinct()
    if mode == "count":
        return per.select(key, "category", "hits", "occurrences", "score")
    if mode == "first_class":
        best = found.groupBy(key).agg(F.min_by("category", "ord").alias("category"))
    elif mode == "argmax":
        ranked = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hits", (-F.col("ord")).alias("o"), "category")), asc=False).alias("r"))
        top, level = F.col("r")[0]["category"], F.size(F.filter("r", lambda x: x["hits"] == F.col("r")[0]["hits"])) > 1
        best = ranked.select(key, (top if tie is None else F.when(level, tie).otherwise(top)).alias("category"))
    else:
        raise ValueError("mode is any, count, first_class or argmax")
    named = best.select(F.col(key).alias("_k"), F.col("category"))
    return df.select(key).distinct().join(named, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("category", F.lit(none)).alias("category"))


def table_of(classes: list[tuple[str, list[str]]], kind: str = "substring") -> list[tuple[str, int, str, float, str]]:
    """Rows of a lexicon table from lists of terms, each of weight 1."""
    return [(name, i, t, 1.0, kind) for i, (name, terms) in enumerate(classes) for t in terms]


def words_of(text: Column) -> Column:
    """Blank-separated words of a text, the measure of c01."""
    return F.size(X.blank_split(F.coalesce(text, F.lit(""))))
