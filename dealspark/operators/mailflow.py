"""Incoming mails from classification to follow-up (m08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.operators import classify as C
from dealspark.operators import relational as R
from dealspark.operators import retrieve as S
from dealspark.operators.templates import fill

#: Decks read for a mail that names a company (among that company's) and for one that doesn't (among all).
NAMED, UNNAMED = 6, 4
CONTEXT = ("interested", "due_diligence", "follow_up", "question")


def retrieved(asked: DataFrame, decks: DataFrame) -> DataFrame:
    """asked: qid, text, company (null: none); decks: doc_id, company, text. Best decks of each question by BM25: qid, doc, rank. Numbers,
    lengths and document frequencies are those of the company's decks where one is named (upper and lower case alike)."""
    every = S.bm25(decks, "doc_id", "text", asked.where("company is null").select("qid", "text"), UNNAMED)
    named = asked.where("company is not null").select("qid", "text", F.lower("company").alias("_of"))
    own = decks.select("doc_id", "text", F.lower("company").alias("_of")).join(named.select("_of").distinct(), "_of", "left_semi")
    return every.select("qid", "doc", "rank").unionByName(S.bm25_within(own, "_of", "doc_id", "text", named, NAMED).select("qid", "doc", "rank"))


def answer_mails(mails: DataFrame, decks: DataFrame, replies: list[tuple], rules: DataFrame, as_of: str) -> DataFrame:
    """One row per mail (id, body): intent, sender, company, number of decks read, revenue found in them, recommendation, reply and
    follow-up. Equal mails are searched for once; null and empty bodies read no deck. replies: intent and text, the first for other intents."""
    c = C.classify_email(F.coalesce("body", F.lit("")))
    rows = mails.select("id", *[c[k].alias(k) for k in ("intent", "sender", "company", "needs_context")], F.col("body").alias("text"))
    rows = rows.withColumn("qid", F.when(F.col("needs_context") | F.col("intent").isin(*CONTEXT), F.sha2("text", 256)))
    # a mail's company follows from its text
    asked = rows.where("qid is not null").groupBy("qid").agg(F.first("text").alias("text"), F.first("company").alias("company"))
    texts = retrieved(asked, decks).join(decks.select(F.col("doc_id").alias("doc"), "text"), "doc")
    context = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hits"))
    m = C.pitch_fallback(F.array_join(F.transform("hits", lambda h: h["text"]), "\n"))
    analysed = context.select("qid", F.size("hits").alias("decks"), m["revenue"].alias("revenue"))
    joined = rows.join(analysed, "qid", "left").select("id", "intent", "sender", "company", F.coalesce("decks", F.lit(0)).alias("decks"), "revenue", F.when(F.col("revenue").isNotNull(), "CONSIDER").otherwise("WATCH").alias("recommendation"))
    answered = fill(joined.withColumn("_name", F.coalesce("company", F.lit("your company"))), F.col("intent"), [(i, t.replace("{company}", "{_name}")) for i, t in replies], ["reply"], ["_name"], replies[0][0]).drop("_name")
    return R.schedule_followup(answered, rules, as_of)
