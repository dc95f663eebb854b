"""Domain operators on hand rows: thresholds at their boundaries, nulls, empty and accented texts."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealspark.functions import text as X
from dealspark.functions import vectors as V
from dealspark.operators import aggregates as A
from dealspark.operators import chunking as K
from dealspark.operators import classify as C
from dealspark.operators import relational as R
from dealspark.operators import retrieve as S
from dealspark.plans import composite, registry, retrieval  # noqa: F401  they register their queries
from dealspark.sources import io as IO
from dealspark.streaming import stateful as SO
from dealspark.streaming import streams as ST


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("$25K", "$25,000"), ("$5M", "$5,000,000"), ("$1.5B", "$1,500,000,000"), ("Revenue: $100K per month", "Revenue: $100,000 per month"),
        ("$10M ARR growing to $50M", "$10,000,000 ARR growing to $50,000,000"), ("₹5 Crore", "₹50,000,000"), ("₹10 Lakh", "₹1,000,000"), ("25M and 5M", "25,000,000 and 5,000,000"), ("nothing", "nothing"), ("", ""),
    ],
)
def test_number_normalisation(spark, given, want):
    assert one(spark, X.normalise_numbers(F.col("t")), t=given) == want


def test_money(spark):
    assert one(spark, X.money_value(F.lit("$1,234.5K"))) == 1234500.0
    assert one(spark, X.money_value(F.lit("n/a"))) is None
    assert [one(spark, X.money_display(F.lit(v).cast("double"))) for v in (999.0, 1e3, 1e6, 1e9, None)] == ["$999", "$1K", "$1.0M", "$1.0B", None]
    assert one(spark, X.normal_year(F.lit("Year 3"))) == 2026 and one(spark, X.normal_year(F.lit("1999"))) == 1999 and one(spark, X.normal_year(F.lit("21"))) is None


def test_risk_buckets_at_boundaries(spark):
    rows = spark.createDataFrame([("a", 0.3), ("b", 0.29), ("c", 0.6), ("d", 0.59)], "company string, ratio double")
    got = {r.company: (r.bucket, r.members) for r in A.portfolio_risk(rows).collect()}
    assert got == {"a": ("medium", 2), "b": ("high", 1), "c": ("low", 1), "d": ("medium", 2)}


def test_scope_or_all(spark):
    df = spark.range(5)
    assert R.scope_or_all(df, F.col("id") == 3).count() == 1 and R.scope_or_all(df, F.col("id") == 9).count() == 5 and R.scope_or_all(df.limit(0), F.col("id") == 9).count() == 0


def test_intents(spark):
    said = {"not interested": "not_interested", "We are interested": "interested", "thanks": "pending", "maybe": "pending", "": "pending"}
    for text, want in said.items():
        assert one(spark, C.email_intent(F.col("t"))["intent"], t=text) == want
    assert one(spark, C.email_intent(F.lit(None).cast("string"))["intent"]) == "pending"
    assert one(spark, C.sender_type(F.lit("our fund"))) == "investor" and one(spark, C.sender_type(F.lit("été"))) == "unknown"


def test_sentiment_of_nothing(spark):
    for text in ("", None):
        s = C.sentiment(F.lit(text).cast("string"))
        row = spark.range(1).select(*[c.alias(k) for k, c in s.items()]).first()
        assert row.sentiment == "neutral" and row.score == 0.0


def test_blend(spark):
    lit = F.lit
    b = lambda m, c, w, k: spark.range(1).select(*[v.alias(n) for n, v in C.blend(lit(m).cast("string"), lit(c).cast("double"), lit(w), lit(k)).items()]).first()
    assert b(None, None, "x", 0.5).method == "keyword_only" and b("y", 0.71, "x", 0.5).label == "y" and b("y", 0.7, "x", 0.5).label == "x"
    assert b("x", 0.41, "x", 0.5).method == "model+keyword" and b("x", 0.4, "x", 0.5).method == "keyword"


def test_chunkers_cover_and_advance():
    text = "First sentence is here. " * 60 + "tail without end"
    spans = K.sliding(text)
    starts = [s for s, _ in spans]
    assert starts == sorted(set(starts)) and all(51 <= len(t) <= 500 for _, t in spans)
    covered = np.zeros(len(text), bool)
    for s, t in spans:
        covered[s : s + len(t) + 1] = True
    assert covered[: len(text) - 1].all()
    assert K.sliding("") == K.paragraphs("") == K.sentences("") == K.token_budget("") == []
    assert K.sliding("x" * 1200, overlap=600)[-1][0] + 500 >= 1200  # an overlap beyond the window still gets ahead
    assert [len(t) for _, t in K.paragraphs("a" * 3200)] == [1500, 1500, 200]
    assert "".join(t for _, t in K.sentences(text)) == text
    parts = K.token_budget("word " * 290 + ".\n\n" + "more " * 200)
    assert [len(t.split()) for _, t in parts] == [291, 200]


def test_chunks_on_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Some text that is long enough to be kept as a chunk, yes.")], "doc_id long, text string")
    assert [r.doc_id for r in K.chunk(df).collect()] == [3] and K.chunk(df.limit(0)).count() == 0


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a)) == 5.0 and one(spark, V.cosine(a, b)) == 0.0 and one(spark, V.l2(a, b)) == 5.0
    assert one(spark, V.parse_vector(F.lit("[1,2.5]"))) == [1.0, 2.5] and len(one(spark, V.fit_dim(F.array(F.lit(1.0).cast("float")), 3))) == 3


def test_knn_forms_agree(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "v")
    rows = lambda df: {(r.qid, r["rank"]): (r.id, round(r.score, 5)) for r in df.collect()}
    scored = S.scores(e, q)
    exact = rows(S.knn(e, q, 5))
    assert exact == rows(S.top_per_group(scored, ["qid"], [F.desc("score"), F.asc("id")], 5))
    assert {m: rows(S.knn(e, q, 5, m, 0.1 if m == "inner" else None)) for m in ("l2", "inner")} == {m: rows(S.top_per_group(S.scores(e, q, m, 0.1 if m == "inner" else None), ["qid"], [F.desc("score"), F.asc("id")], 5)) for m in ("l2", "inner")}
    near = rows(S.cell_knn(e, q, 5))
    recall = len({(k[0], v[0]) for k, v in exact.items()} & {(k[0], v[0]) for k, v in near.items()}) / len(exact)
    assert recall >= 0.9


def test_knn_of_many_queries(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(S, "BLOCK_ROWS", 60, raising=False)
    monkeypatch.setattr(S, "QUERY_ROWS", 7, raising=False)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    twins = e.where("id < 12").select((F.col("id") + 10_000).alias("id"), "v")
    e = e.unionByName(twins).unionByName(twins.selectExpr("id + 100 as id", "v"))
    q = e.where("id % 10 = 0").select(F.col("id").alias("qid"), "v")
    rows = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    assert rows(S.knn_blocks(e, q, 5)) == rows(S.top_per_group(S.scores(e, q), ["qid"], [F.desc("score"), F.asc("id")], 5))
    assert S.knn_blocks(e, q.limit(0), 5).count() == S.knn_blocks(e.limit(0), q, 5).count() == 0


def test_ann_recall_of_every_20th_vector(spark, sf):
    """Against the exact search, on vectors without structure: the hardest case."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")
    exact, near = ({(r.qid, r.id) for r in f(e, q, 5).collect()} for f in (S.knn, S.cell_knn))
    assert len(exact & near) >= 0.9 * len(exact)


def test_ann_searches_every_20th_vector(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert registry.QUERIES["r12_ann"](spark, sf).select("qid").distinct().count() == n > 20


def test_deck_pipeline_equals_brute_force(spark, tmp_path):
    """One record a document, from searches in its own chunks."""
    rng = random.Random(4)
    pool = "the tion ment que ung der cion los alpha beta gamma delta epsilon".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([5, 40, 900, 2500]))) for _ in range(12)]
    texts = [f"{t} Revenue: ${i + 1}M. {t} {i}% growth" for i, t in enumerate(texts)] + ["", "zeta " * 30, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["m07_deck_pipeline"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    cleaned = {r.doc_id: r.text or "" for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", X.clean_text(F.col("text"), ascii_only=False).alias("text")).collect()}
    contexts = {}
    for i, text in cleaned.items():
        chunks = [t for _, t in K.paragraphs(text)]
        split = [re.findall(r"[^\W\d_]+", c.lower()) for c in chunks]
        mean = sum(map(len, split)) / max(1, len(split))
        found = []
        for _, theme in composite._THEMES:
            scores = []
            for pos, w in enumerate(split):
                score = 0.0
                for term in set(theme.split()):
                    df, tf = sum(term in x for x in split), w.count(term)
                    if tf:
                        score += np.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
                scores.append((-round(score, 4), pos))
            found += [chunks[p] for s, p in sorted(scores)[:2] if s < 0]
        contexts[i] = list(dict.fromkeys(found))
    assert {i: (r.chars, r.nodes) for i, r in got.items()} == {i: (len(cleaned[i]), len(contexts[i])) for i in got}
    assert max(map(len, contexts.values())) > 2
    m = C.mined_metrics(F.col("text"))
    want = {r.doc_id: r for r in spark.createDataFrame([(i, "\n\n---\n\n".join(c)) for i, c in contexts.items()], "doc_id long, text string").select("doc_id", *[m[k].alias(k) for k in m]).collect()}
    assert all(got[i][k] == want[i][k] for i in got for k in m) and len({got[i]["revenue"] for i in got}) > 5


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"company": "A", "date": "2024-02-03"}, {"date": "bad"}]')
    rows = IO.read_json_table(spark, str(tmp_path / "t.json"), "company string, date string", {"company": "?"}, ("date",)).collect()
    assert [r.company for r in rows] == ["A", "?"] and rows[0].date == dt.datetime(2024, 2, 3) and rows[1].date is None
    (tmp_path / "k.json").write_text('{"X": [{"metric": "m", "value": "1"}, {"metric": "n"}]}')
    assert [(r.key, r.pos, r.metric, r.value) for r in IO.read_keyed_records(spark, str(tmp_path / "k.json"), "metric:string,value:string").collect()] == [("X", 0, "m", "1"), ("X", 1, "n", None)]
    (tmp_path / "sym" / "ACME").mkdir(parents=True)
    (tmp_path / "sym" / "ACME" / "a.csv").write_text("year,revenue\n2023,5\n")
    assert [(r.symbol, r.text) for r in IO.read_symbol_csv(spark, str(tmp_path / "sym/*/*.csv")).collect()] == [("ACME", "year: 2023, revenue: 5")]


def test_rate_verdicts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 7, t), (2, 7, t + dt.timedelta(minutes=1)), (3, 7, t + dt.timedelta(minutes=2)), (4, 7, t + dt.timedelta(minutes=62)), (5, 8, t)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    events = ST.read_events(spark, str(tmp_path))
    got = {r.event_id: (r.allowed, r.remaining) for r in SO.run_to_end(events, lambda e: SO.rate_verdicts(e, 2, 60), ST.shared_folder(spark)).collect()}
    assert got == {1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 1), 5: (True, 1)}


def test_late_rows_are_counted(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    for k, ts in enumerate([t, t + dt.timedelta(hours=9), t + dt.timedelta(hours=9), t]):
        spark.createDataFrame([(k, ts)], "event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"events{k}.parquet"))
    schema = spark.read.parquet(str(tmp_path / "events0.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    _, dropped = ST.late_rows(stream)
    assert dropped >= 1


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Nimbus Labs - Pitch Deck\nmore", "Nimbus Labs"), ("All about Orchid.", "Orchid"), ("Acme Foods is a new platform for cooks", "Acme Foods"), ("x\nBlue River\nline", "Blue River"), ("welcome to Zephyr!", "Zephyr"),
        ("see https://quill.io now", "quill"), ("about the market", None), ("CONFIDENTIAL\nDelta 4 Co.\n 12 and a longer line of words", "Delta 4 Co."), ("confidential page", None), ("", None), (None, None),
    ],
)
def test_company_from_text(spark, given, want):
    row = spark.createDataFrame([(given,)], "t string")
    assert row.select(C.company_from_text(F.col("t")).alias("x")).first()["x"] == want


def test_founders_in_order_of_patterns(spark):
    assert one(spark, C.founders(F.col("t")), t="CEO: bo lund\nFounders: ada pike\nteam - cy orr") == ["Ada Pike", "Cy Orr", "Bo Lund"]


def test_importance_with_metadata(spark):
    plain, flagged = C.detect_context(F.col("t")), C.detect_context(F.col("t"), F.lit(True), F.lit(True))
    assert one(spark, plain["importance"], t="x") == 0.5
    assert one(spark, flagged["importance"], t="x") == 0.8
    assert one(spark, C.detect_context(F.col("t"))["context"], t="acme inc. office") == "company"


def test_insights(spark):
    m = C.document_insights(F.col("t"))
    text = "Users: 500, churn: 3%, burn rate high, TAM: 5b, Q3 plan, risk assessment"
    assert one(spark, m["technical"], t=text) == "Users: 500;churn: 3%"
    assert one(spark, m["risk"], t=text) == "risk assessment;burn rate"
    assert one(spark, m["insights"], t="plain words") == ""


def test_mail_queries(spark):
    mails = spark.createDataFrame([(1, "Revenue and ARR, revenue", "Acme"), (2, "hello", None), (3, None, "")], "id long, text string, company string")
    rows = S.mail_queries(mails, "id", "text", "company", ["revenue", "arr"]).collect()
    assert sorted((r["qid"], r["mail"], r["text"]) for r in rows) == [(3, 1, "Revenue and ARR, revenue"), (4, 1, "Acme"), (5, 1, "revenue arr"), (6, 2, "hello")]


def test_context_with_background(spark):
    contexts = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, context string")
    known = spark.createDataFrame([(1, "2024", "5"), (1, "2023", "4")], "qid long, yr string, value string")
    turns = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi")], "qid long, turn long, role string, text string")
    found = {r["qid"]: r["context"] for r in S.with_background(contexts, known, turns).collect()}
    assert found == {1: "a\n\nKnown projections:\n- Revenue for 2023: 4\n- Revenue for 2024: 5\n\nConversation so far:\nUSER: hi\nASSISTANT: ", 2: "b"}


def test_market_comparison(spark):
    rows = [(f"c{i}", "x", float(i)) for i in range(7)] + [("d", "y", 1.0), ("e", None, 1.0), ("f", "x", None)]
    got = R.market_comparison(spark.createDataFrame(rows, "company string, industry string, market double"), "company", "industry", "market").collect()
    of = lambda k: sorted(r["peer"] for r in got if r["company"] == k and not r["highlight"])
    assert of("c0") == ["c3", "c4", "c5", "c6"] and of("c6") == ["c2", "c3", "c4", "c5"] and of("d") == []
    assert {r["company"] for r in got if r["highlight"]} == {*(f"c{i}" for i in range(7)), "d"}


def test_visual_summary(spark):
    pages = spark.createDataFrame([(1, 1, "growth 10 20"), (1, 0, "Revenue"), (2, 0, None)], "doc long, pos int, page string")
    got = {r["doc"]: r for r in A.visual_summary(pages, "doc", "pos", "page", ["growth", "revenue"], ["many", "few", "charts", "none"]).collect()}
    assert (got[1]["charts"], got[1]["terms"], got[1]["text"], got[1]["advice"]) == (2, "growth,revenue", "Revenue\ngrowth 10 20", "few")


def test_capped_sessions(spark, sf):
    """Against a walk through every user's events."""
    idle, cap = dt.timedelta(minutes=600), dt.timedelta(hours=12)
    want, users = set(), {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts").orderBy("ts").collect():
        users.setdefault(r["user_id"], []).append(r["ts"])
    for user, times in users.items():
        spans = []
        for t in times:
            if spans and t < spans[-1][1] + idle and t < spans[-1][0] + cap:
                spans[-1][1:] = [t, spans[-1][2] + 1]
            else:
                spans.append([t, t, 1])
        want |= {(user, a, min(b + idle, a + cap), n) for a, b, n in spans}
    got = {(r["user_id"], r["started"].replace(tzinfo=None), r["ended"].replace(tzinfo=None), r["n"]) for r in composite.capped(spark, sf).collect()}
    assert got == want


def test_concurrent_sessions(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", t(0), t(5)), ("a", t(1), t(6)), ("a", t(2), t(7)), ("a", t(3), t(4)), ("b", t(0), t(1)), ("b", t(1), t(2))]
    got = ST.concurrent_sessions(spark.createDataFrame(rows, "user string, started timestamp, ended timestamp"), "user").collect()
    assert {r["user"]: (r["most"], r["over_limit"]) for r in got} == {"a": (4, True), "b": (1, False)}


def test_sql_functions_equal_columns(spark):
    from dealspark.functions import sql as SF

    SF.create_functions(spark)
    texts = ["$25K and 5 crore, 25M and 5M", "Strong growth, not a problem", "burn rate is high, stable", "We are not interested, let's talk", "series b of acme inc.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = {"normal_numbers": X.normalise_numbers(F.col("t")), "sentiment_score": C.sentiment(F.col("t"))["score"], "risk_score": C.risk_score(F.col("t")), "email_intent": C.email_intent(F.col("t"))["intent"], "context_type": C.detect_context(F.col("t"))["context"], "money_value": X.money_value(F.col("t"))}
    for name, column in both.items():
        rows = df.select(F.expr(f"{name}(t)").alias("a"), column.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], name
