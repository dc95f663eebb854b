"""First mails and answers to mails: intents, contradictions, templates, response times, hybrid hits, the whole flow."""

import datetime as dt
import itertools
import math
import re

from pyspark.sql import functions as F

from dealspark.functions import lexicons as L
from dealspark.operators import aggregates as A
from dealspark.operators import classify as C
from dealspark.operators import mailflow
from dealspark.operators import retrieve as S
from dealspark.operators.templates import fill

KEYS = ("revenue", "growth_rate", "users", "market_size")


def plain_intent(values, sures, claims, high, medium, against, sure):
    # hundredths of the signal, tenths of the risk
    best, some = (25, 20, 20, 15), (10, 5, 5, 5)
    signal = sum((b if (c or 0) > 0.7 else a) for v, c, b, a in zip(values, sures, best, some) if v) + (10 if (claims or 0) > 2 else 5 if (claims or 0) > 0 else 0)
    sure = sure or 0.0
    points = 30 * (high or 0) + 15 * (medium or 0) + 20 * (against or 0) + (20 if sure < 0.5 else 10 if sure < 0.7 else 0)
    risk = ["low", "medium", "high"][(points >= 20) + (points >= 50)]
    if signal >= 70 and risk == "low" and sure >= 0.7:
        intent = "strong_interest"
    elif signal >= 50 and risk != "high":
        intent = "moderate_interest"
    elif sure < 0.5 or risk == "high":
        intent = "needs_clarification"
    else:
        intent = "soft_decline" if signal < 30 else "initial_outreach"
    return round(signal / 100, 4), risk, intent


def test_intents_over_all_cases(spark):
    cases = list(itertools.product([("$5M", "9%", "8K", "$1B"), ("$5M", None, "", "$1B"), (None,) * 4], [(0.8,) * 4, (0.7,) * 4, (0.9, None, 0.2, 0.71)], [None, 0, 1, 2, 3], [0, 1, None], [0, 1, 3], [0, 1], [None, 0.0, 0.49, 0.5, 0.6, 0.7, 0.9]))
    rows = [(i, *v, *c, n, h, m, a, s) for i, (v, c, n, h, m, a, s) in enumerate(cases)]
    cols = ["id long", *[f"{k} string" for k in KEYS], *[f"{k}_c double" for k in KEYS], "n int", "h int", "m int", "a int", "s double"]
    df = spark.createDataFrame(rows, ", ".join(cols))
    got = df.select("id", C.outreach_intent({k: (F.col(k), F.col(f"{k}_c")) for k in KEYS}, *[F.col(x) for x in "nhmas"]).alias("j")).select("id", "j.*").collect()
    assert len(got) == len(cases)
    for r in got:
        assert (r.signal, r.risk, r.intent) == plain_intent(*cases[r.id])
        assert r.reasoning == f"Intent: {r.intent}, Tone: {r.tone}. Signal strength: {r.signal:.2f}, Risk level: {r.risk}"
        sure = cases[r.id][-1] or 0
        assert r.priority == {"strong_interest": "high", "needs_clarification": "medium", "moderate_interest": "medium" if sure >= 0.6 else "low"}.get(r.intent, "low")
    assert {r.intent for r in got} == set(C.TONES)


def test_contradictions(spark):
    rows = [(10.0, 4.0, 5.0, 9.0), (10.0, 5.0, 9.0, 9.0), (4.0, 10.0, 9.0, 5.0), (0.0, 10.0, 0.0, 5.0), (None, 10.0, 3.0, None), (10.0, None, None, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, r double, a double, g double, m double")
    got = {x.id: x.f for x in df.select("id", C.contradictions(*[F.col(c) for c in "ragm"]).alias("f")).collect()}
    assert got == {0: ["revenue and ARR differ", "growth below market"], 1: [], 2: ["revenue and ARR differ"], 3: [], 4: [], 5: []}


def test_templates(spark):
    df = spark.createDataFrame([(1, "a", "Acme", "x"), (2, "b", None, "{name}"), (3, "zzz", "Zed", None), (4, None, "Nil", "x")], "id int, kind string, name string, body string")
    got = {r.id: (r.t, r.body, r.name) for r in fill(df, F.col("kind"), [("a", "Hi {name}"), ("b", "To {name}, {name}.")], ["t"], ["name"], "b").collect()}
    assert got == {1: ("Hi Acme", "x", "Acme"), 2: ("To , .", "{name}", None), 3: ("To Zed, Zed.", None, "Zed"), 4: ("To Nil, Nil.", "x", "Nil")}
    assert fill(df.limit(0), F.col("kind"), [("a", "x")], ["t"], [], "a").count() == 0


def test_response_times(spark):
    at = dt.datetime(2024, 1, 1)
    m = lambda n: at + dt.timedelta(minutes=n)
    rows = [("x", "u", at, m(10)), ("x", "v", at, m(20)), ("x", "v", at, None), ("y", None, None, m(5)), ("y", "u", at, m(60))]
    got = {(r.dim, r.value): (r.n, r.processed, r.mean_minutes, r.median_minutes) for r in A.reply_stats(spark.createDataFrame(rows, "s string, i string, a timestamp, p timestamp"), ["s", "i"], "a", "p").collect()}
    assert got == {("total", ""): (5, 3, 30.0, 20.0), ("s", "x"): (3, 2, 15.0, 15.0), ("s", "y"): (2, 1, 60.0, 60.0), ("i", "u"): (2, 2, 35.0, 35.0), ("i", "v"): (2, 1, 20.0, 20.0), ("i", None): (1, 0, None, None)}


def test_first_hits_come_before_the_others(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "qid long, id long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3), (3, 9, 1)], "qid long, id long, rank int")
    got = sorted((r.qid, r["rank"], r.id, r.method) for r in S.hybrid_concat(one, two, 3).collect())
    assert got == [(1, 1, 10, 0), (1, 2, 11, 0), (1, 3, 12, 1), (2, 1, 5, 0), (3, 1, 9, 1)]


def plain_bm25(docs, query, k):
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / max(1, len(words))
    scores = {}
    for i, w in words.items():
        total = 0.0
        for term in set(re.findall(r"[^\W\d_]+", query.lower())):
            df = sum(term in x for x in words.values())
            total += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(term) * 2.5 / (w.count(term) + 1.5 * (0.25 + 0.75 * len(w) / mean))
        scores[i] = round(total, 4)
    return [i for i in sorted(scores, key=lambda i: (-scores[i], i)) if scores[i] > 0][:k]


def test_mails_are_answered_as_by_a_plain_loop(spark):
    topics = ["call term sheet schedule", "data room due diligence", "revenue $4M growth", "questions pricing", "company market"]
    decks = [(i, "Acme" if i % 3 == 0 else "Zed", " ".join(topics[(i + j) % 5] for j in range(1 + i % 4)) + (f" ${i}M" if i % 2 else "")) for i in range(40)]
    bodies = [
        "We are interested in your company Acme and would like to schedule a call about the term sheet.", "We are interested and would like to schedule a call about the term sheet.",
        "Please open the data room for due diligence at startup Zed, we need the cap table.", "Unfortunately this is not a fit for our fund, we will pass.", "Interested in the company Nobody, schedule a call", "", None, "Thanks.",
    ]
    mails = spark.createDataFrame([(i, bodies[i % len(bodies)]) for i in range(24)], "id long, body string")
    replies = [("interested", "Yes {company}"), ("not_interested", "No {company}")]
    rules = spark.createDataFrame(L.FOLLOW_UPS, "intent string, recommendation string, days int, priority string, action string")
    got = {r.id: r for r in mailflow.answer_mails(mails, spark.createDataFrame(decks, "doc_id long, company string, text string"), replies, rules, "2024-02-01").collect()}
    assert len(got) == 24
    follow = {(i, r): (days, p, a) for i, r, days, p, a in L.FOLLOW_UPS}
    text = {i: t for i, _, t in decks}
    read = set()
    for i, r in got.items():
        body = bodies[i % len(bodies)] or ""
        name = re.search(L.MAIL_COMPANY, body)
        assert r.company == (name and name[1])
        hits = []
        if r.intent in mailflow.CONTEXT and body:
            own = [(k, t) for k, c, t in decks if name is None or c.lower() == name[1].lower()]
            hits = plain_bm25(own, body, mailflow.NAMED if name else mailflow.UNNAMED)
        money = re.search(r"\$[0-9][0-9,.]*[MBK]?", "\n".join(text[k] for k in hits))
        assert (r.decks, r.revenue) == (len(hits), money and money[0])
        assert r.recommendation == ("CONSIDER" if money else "WATCH")
        assert r.reply == ("No " if r.intent == "not_interested" else "Yes ") + (name[1] if name else "your company")
        days, priority, action = follow.get((r.intent, r.recommendation), (7, "low", "Review and determine next step"))
        assert (r.priority, r.action) == (priority, action)
        assert r.followup_date == (str(dt.date(2024, 2, 1) + dt.timedelta(days)) if days > 0 else None)
        read.add(r.decks)
    assert {0, 4, 6} <= read
    empty = mailflow.answer_mails(mails.limit(0), spark.createDataFrame(decks, "doc_id long, company string, text string"), replies, rules, "2024-02-01")
    assert empty.count() == 0
