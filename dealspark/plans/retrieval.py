"""Queries on retrieval and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealspark.functions import lexicons as L
from dealspark.functions import vectors as V
from dealspark.operators import aggregates as A
from dealspark.operators import classify as C
from dealspark.operators import relational as R
from dealspark.operators import retrieve as S
from dealspark.operators.annindex import VectorIndex, recall_of
from dealspark.operators.textindex import InvertedIndex
from dealspark.plans.adapters import view
from dealspark.plans.registry import register, table
from dealspark.plans.text import sql_hits
from dealspark.streaming.streams import shared_folder


def documents(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


_INDEXES: dict[tuple[str, str], InvertedIndex] = {}


def indexed(s, d) -> InvertedIndex:
    """The stored index of the documents: built at the first search of an application, opened by the others."""
    at = (s.sparkContext.applicationId, d)
    if at not in _INDEXES:
        _INDEXES[at] = InvertedIndex.create(s, shared_folder(s), documents(s, d))
    return _INDEXES[at]


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')"
_INDEX = f"""w as (select doc_id as doc, {_WORDS} as w from documents), q as (select item_id as qid, {_WORDS} as w from benchmark),
    qt as (select qid, term, count(*) as qtf from (select qid, unnest(w) as term from q) t group by 1, 2), st as (select count(*) as n, avg(len(w)) as avgdl from w),
    p as (select doc, term, count(*) as tf, any_value(length) as length from (select doc, len(w) as length, unnest(w) as term from w) t where term in (select term from qt) group by 1, 2), df as (select term, count(*) as df from p group by 1)"""
_BM = f"""{_INDEX}, bm as (select qid, doc, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / avgdl))), 4) as score from p join df using (term) join qt using (term), st group by 1, 2)"""
_TF = f"""{_INDEX}, tfi as (select qid, doc, round(sum(tf / cast(length as double) * (ln((n + 1) / cast(df + 1 as double)) + 1) * qtf), 4) as score from p join df using (term) join qt using (term), st group by 1, 2)"""
_RN = "row_number() over (partition by qid order by score desc, doc)"
register("r01_bm25_index", lambda s, d: indexed(s, d).view().df, f"with w as (select doc_id, list_distinct({_WORDS}) as w from documents) select term, count(*) as df from (select unnest(w) as term from w) t group by 1")
register("r01_postings", lambda s, d: (lambda v: v.postings.join(S.maybe_broadcast(v.df, v.df.count()), "term"))(indexed(s, d).view()), f"with w as (select doc_id as doc, {_WORDS} as w from documents), p as (select doc, term, count(*) as tf, any_value(length) as length from (select doc, cast(len(w) as int) as length, unnest(w) as term from w) t group by 1, 2), f as (select term, count(*) as df from p group by 1) select term, doc, tf, length, df from p join f using (term)")
register("r01_lengths", lambda s, d: indexed(s, d).lengths(), f"select doc_id as doc, cast(len({_WORDS}) as bigint) as n from documents")
register("r02_bm25", lambda s, d: indexed(s, d).bm25(queries(s, d), 5), f"with {_BM} select qid, doc, score, cast({_RN} as int) as rank from bm where score > 0 qualify {_RN} <= 5")
register("r03_tfidf", lambda s, d: indexed(s, d).tfidf(queries(s, d), 5), f"with {_TF} select qid, doc, score, cast({_RN} as int) as rank from tfi where score > 0 qualify {_RN} <= 5")
_DEDUP = f"h as (select * from bm where score > 0 qualify {_RN} <= 20), n as (select h.*, substr(text, 1, 100) as head from h join documents on doc_id = doc), o as (select * from n qualify row_number() over (partition by qid, head order by score desc, doc) = 1)"
register("r04_dedupe_hits", lambda s, d: S.dedupe_hits(indexed(s, d).bm25(queries(s, d), 20), documents(s, d), "doc_id", "text", 100, 5), f"with {_BM}, {_DEDUP} select qid, doc, score, cast({_RN} as int) as rank from o qualify {_RN} <= 5")
register("r05_accumulate", lambda s, d: S.accumulate(indexed(s, d).bm25(queries(s, d), 20), documents(s, d), "doc_id", "text", 80, 10), f"with {_BM}, h as (select * from bm where score > 0 qualify {_RN} <= 20) select substr(text, 1, 80) as head, round(sum(score), 4) as score, count(*) as hits from h join documents on doc_id = doc group by 1 order by score desc, head limit 10")
_SEG = r"s as (select doc_id, unnest(list_filter(string_split_regex(text, '\n+'), lambda x: trim(x) <> '')[1:8]) as segment from documents)"
_DENS = "round((" + " + ".join(f"(length(lower(segment)) - length(replace(lower(segment), '{t}', ''))) / cast({len(t)} as double)" for t in ("the", "tion", "ment")) + r") / greatest(cast(len(list_filter(string_split_regex(segment, '[ \t\n\r\f]+'), lambda x: x <> '')) as double), 1.0) * 50, 3)"
register("r06_segment_density", lambda s, d: documents(s, d).select("doc_id", F.explode(F.slice(F.filter(F.split("text", "\n+"), lambda x: F.trim(x) != ""), 1, 8)).alias("segment")).select("doc_id", S.density(F.col("segment"), ["the", "tion", "ment", "of"]).alias("density")).groupBy("doc_id").agg(F.max("density").alias("best"), F.count("*").alias("segments")), f"with {_SEG} select doc_id, max({_DENS}) as best, count(*) as segments from s group by 1")
_FORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\r]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"
_KW = f"kw as (select doc_id, round(len(list_intersect(w, ['the','of'])) / cast(len(list_distinct(list_concat(w, ['the','of']))) as double) + case when contains(form, 'the of') then 0.5 else 0.0 end::double, 6) as kw from (select doc_id, {_FORM} as form, list_distinct(list_filter(string_split({_FORM}, ' '), lambda x: x <> '')) as w from documents) t)"
register("r07_keyword_score", lambda s, d: documents(s, d).select("doc_id", S.keyword_score(F.col("text"), "the of").alias("kw")), f"with {_KW} select doc_id, kw from kw")


def embeddings(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def probes(s, d):
    return embeddings(s, d).where("id % 20 = 0").select(F.col("id").alias("qid"), "v")


_V = "v as (select vec_id as id, cast(embedding as double[]) as v, label from embeddings)"
_COS = f"{_V}, c as (select q.id as qid, x.id as id, round(list_cosine_similarity(q.v, x.v), 6) as score from v q join v x on q.id <> x.id where q.id % 20 = 0)"
_TOP = "row_number() over (partition by qid order by score desc, id)"
register("r11_knn_cosine", lambda s, d: S.knn(embeddings(s, d), probes(s, d), 5), f"with {_COS} select qid, id, score, cast({_TOP} as int) as rank from c qualify {_TOP} <= 5")
register("r11_knn_l2", lambda s, d: S.knn(embeddings(s, d), probes(s, d), 5, "l2"), f"with {_V}, c as (select q.id as qid, x.id as id, round(-list_distance(q.v, x.v), 6) as score from v q join v x on q.id <> x.id where q.id % 20 = 0) select qid, id, score, cast({_TOP} as int) as rank from c qualify {_TOP} <= 5")
register("r11_knn_inner", lambda s, d: S.knn(embeddings(s, d), probes(s, d), 5, "inner", 0.1), f"with {_V}, c as (select q.id as qid, x.id as id, round(list_inner_product(q.v, x.v), 6) as score from v q join v x on q.id <> x.id where q.id % 20 = 0) select qid, id, score, cast({_TOP} as int) as rank from c where score >= 0.1 qualify {_TOP} <= 5")
register("r11_knn_blocks", lambda s, d: S.knn_blocks(embeddings(s, d), probes(s, d), 5), f"with {_V}, c as (select q.id as qid, x.id as id, round(list_cosine_similarity(q.v, x.v), 6) as score from v q join v x on q.id <> x.id where q.id % 20 = 0) select qid, id, score, cast({_TOP} as int) as rank from c qualify {_TOP} <= 5")


def approximate_recall(s, d):
    """r12: whether nine of ten true neighbours are found by comparing under a twentieth of the table exactly."""
    index = VectorIndex.build(embeddings(s, d), shared_folder(s), 5)
    r = recall_of(index.search(probes(s, d), 5), S.knn(embeddings(s, d), probes(s, d), 5), embeddings(s, d), index.compared)
    return r.select("queries", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share") < 0.05).alias("few_compared"))


register("r12_ann", lambda s, d: S.cell_knn(embeddings(s, d), probes(s, d), 5))
register("r12_ann_recall", approximate_recall, "select count(*) as queries, true as recall_reached, true as few_compared from embeddings where vec_id % 20 = 0")
_MEAN = "u as (select label, i, avg(v[i]) as x from v, unnest(range(1, 65)) t(i) group by 1, 2), m as (select label, list(x order by i) as m from u group by 1)"
register("r13_vector_arithmetic", lambda s, d: S.vector_arithmetic(embeddings(s, d), F.col("label") == 1, F.col("label") == 2, 10).select("id", "score", "rank"), f"with {_V}, {_MEAN}, t as (select list_transform(range(1, 65), lambda i: a.m[i] - b.m[i]) as t from m a, m b where a.label = 1 and b.label = 2), c as (select -1 as qid, id, round(list_cosine_similarity(v, t), 6) as score from v, t) select id, score, cast({_TOP} as int) as rank from c qualify {_TOP} <= 10")
register("r14_vector_forms", lambda s, d: embeddings(s, d).select("id", F.round(V.norm(V.normalise(F.col("v"))), 6).alias("unit"), F.size(V.fit_dim(F.col("v"), 100)).alias("padded"), F.size(V.fit_dim(F.col("v"), 10)).alias("cut"), F.round(V.norm(V.parse_vector(F.to_json("v"))) / V.norm(F.col("v")), 6).alias("parsed")), f"with {_V} select id, 1.0::double as unit, 100 as padded, 10 as cut, 1.0::double as parsed from v")
_SIM = "sim as (select x.id, round(list_cosine_similarity(q.v, x.v), 6) as sim from v q join v x on q.id = 7 and x.id <> 7)"


def similar_to(s, d, vec: int):
    q = embeddings(s, d).where(F.col("id") == vec).select(F.lit(vec).cast("long").alias("qid"), "v")
    return S.scores(embeddings(s, d), q).select("id", F.col("score").alias("sim"))


def label_keywords(s, d):
    """Labels as text: a whole match counts 1, a neighbouring label a half."""
    return embeddings(s, d).select("id", F.when(F.col("label") == 3, 1.0).when(F.col("label").isin(2, 4), 0.5).alias("kw")).where("kw is not null")


_LK = "lk as (select id, case when label = 3 then 1.0 else 0.5 end::double as kw from v where label in (2, 3, 4))"
register("r08_hybrid_gated", lambda s, d: S.hybrid_gated(label_keywords(s, d), similar_to(s, d, 7).where("1 - sim < 0.5"), 10), f"with {_V}, {_SIM}, {_LK} select lk.id, round(0.3 * kw + 0.7 * coalesce(sim, 0.0), 6) as score from lk left join sim on sim.id = lk.id and 1 - sim < 0.5 order by score desc, id limit 10")
register("j02_left_scores", lambda s, d: label_keywords(s, d).join(similar_to(s, d, 7).where("1 - sim < 0.5"), "id", "left").select("id", "kw", F.coalesce("sim", F.lit(0.0)).alias("sim")), f"with {_V}, {_SIM}, {_LK} select lk.id, kw, coalesce(sim, 0.0) as sim from lk left join sim on sim.id = lk.id and 1 - sim < 0.5")
register("r09_hybrid_merge", lambda s, d: S.hybrid_merge(label_keywords(s, d), similar_to(s, d, 7).where("sim > 0.2"), 10), f"with {_V}, {_SIM}, {_LK}, h as (select * from sim where sim > 0.2) select coalesce(lk.id, h.id) as id, round(case when kw is null then 0.7 * sim when sim is null then kw else 0.3 * kw + 0.7 * sim end, 6) as score from lk full join h on h.id = lk.id order by score desc, id limit 10")


def concatenated(s, d):
    """r10: the three best documents of each item by BM25, then the six nearest vectors; a document's and an item's vector is that of its number."""
    e = embeddings(s, d)
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("qid"))
    near = S.knn(e, e.select(F.col("id").alias("qid"), "v").join(asked, "qid", "left_semi"), 6).select("qid", "id", "rank")
    bm = indexed(s, d).bm25(queries(s, d), 3).select("qid", F.col("doc").alias("id"), "rank")
    return S.hybrid_concat(bm, near, 6)


register("r10_hybrid_concat", concatenated, f"""with {_BM}, b as (select qid, doc as id, {_RN} as r from bm where score > 0 qualify {_RN} <= 3), {_COS.replace("q.id % 20 = 0", "q.id in (select item_id from benchmark)")}, n as (select qid, id, {_TOP} as r from c qualify {_TOP} <= 6),
    u as (select qid, id, 0 as method, r from b union all select qid, id, 1, r from n), o as (select * from u qualify row_number() over (partition by qid, id order by method, r) = 1)
    select qid, id, method, cast(row_number() over (partition by qid order by method, r, id) as int) as rank from o qualify row_number() over (partition by qid order by method, r, id) <= 6""")


def contextual(s, d):
    e = embeddings(s, d).select("id", "label")
    near = S.knn(embeddings(s, d), probes(s, d), 15).join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("qid"), F.col("label").alias("qlabel")), "qid")
    return S.contextual_rank(near.select("qid", "id", (1 - F.col("score")).alias("distance"), (F.col("label") == F.col("qlabel")).alias("same_type"), (F.col("id") % 3).alias("entities"), (F.col("id") % 4).alias("topics"), (F.col("id") % 10 / 10).alias("importance"), (F.col("id") % 5 == 0).alias("expired")), 5)


register("r15_contextual_rank", contextual, f"""with {_COS}, n as (select * from c qualify {_TOP} <= 15), k as (select n.qid, n.id, round(1 / (1 + (1 - n.score)) * case when a.label = b.label then 1.3 else 1.0 end::double * (1 + 0.2::double * (n.id % 3)) * (1 + 0.15::double * (n.id % 4)) * (0.5::double + (n.id % 10) / 10::double) * case when n.id % 5 = 0 then 0.5 else 1.0 end::double, 6) as score from n join v a on a.id = n.id join v b on b.id = n.qid)
    select qid, id, score, cast({_TOP} as int) as rank from k qualify {_TOP} <= 5""")
register("r16_assemble_context", lambda s, d: S.assemble_context(indexed(s, d).bm25(queries(s, d), 5), documents(s, d), "doc_id", "text", 4000, 5 * queries(s, d).count()), f"with {_BM}, h as (select qid, doc, {_RN} as r from bm where score > 0 qualify {_RN} <= 5) select qid, substr(string_agg(text, chr(10) order by r), 1, 4000) as context from h join documents on doc_id = doc group by qid")
register("r17_advanced_search", lambda s, d: R.apply_filters(view(s, d, "vDrafts"), "created_at", "1997-01-01", confidence="High").select("id", S.keyword_score(F.col("company"), "customer 000000012").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(50), r"""
    , f as (select id, trim(regexp_replace(lower(company), '[^\p{L}\p{N}_ \t\n\r]', ' ', 'g')) as form from vDrafts where created_at >= timestamp '1997-01-01' and confidence = 'High'), w as (select id, form, list_distinct(string_split(form, ' ')) as w from f)
    select id, round(len(list_intersect(w, ['customer','000000012'])) / cast(len(list_distinct(list_concat(w, ['customer','000000012']))) as double) + case when contains(form, 'customer 000000012') then 0.5 else 0.0 end::double, 6) as score from w
    order by score desc, id limit 50""", ("vDrafts",))
register("r18_hash_embed", lambda s, d: S.hash_embed(documents(s, d), "doc_id", "text").select("doc_id", F.size("v").alias("dims"), F.round(V.norm(F.col("v")), 3).alias("norm")))
_HITS = f"{_BM}, tfi as (select qid, doc, round(sum(tf / cast(length as double) * (ln((n + 1) / cast(df + 1 as double)) + 1) * qtf), 4) as score from p join df using (term) join qt using (term), st group by 1, 2), a as (select qid, 'bm25' as method, score from bm where score > 0 qualify {_RN} <= 5), b as (select qid, 'tfidf' as method, score from tfi where score > 0 qualify {_RN} <= 5), h as (select * from a union all select * from b)"
register("a26_compare_methods", lambda s, d: S.compare_methods(indexed(s, d).bm25(queries(s, d), 5).withColumn("method", F.lit("bm25")).unionByName(indexed(s, d).tfidf(queries(s, d), 5).withColumn("method", F.lit("tfidf")))), f"with {_HITS} select qid, count(*) filter (where method = 'bm25') as bm25_hits, max(score) filter (where method = 'bm25') as bm25_top, count(*) filter (where method = 'tfidf') as tfidf_hits, max(score) filter (where method = 'tfidf') as tfidf_top from h group by 1")


# summaries over classified text
def context_summary(s, d):
    """a17: per context type the number, mean importance, how many are of each sentiment, and the ten most frequent entities."""
    t = F.col("text")
    m = C.detect_context(t)
    rows = view(s, d, "vDecks").select("doc_id", m["context"].alias("context"), m["importance"].alias("importance"), m["sentiment"].alias("sentiment"), C.entities(t).alias("entities"))
    top = R.top_per_group(rows.select("context", F.explode("entities").alias("entity")).groupBy("context", "entity").agg(F.count("*").alias("n")), ["context"], [F.desc("n"), F.asc("entity")], 10)
    names = top.groupBy("context").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]), ";").alias("top_entities"))
    return rows.groupBy("context").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 4).alias("importance"), *[F.count(F.when(F.col("sentiment") == m, 1)).alias(m) for m in ("positive", "negative", "neutral")]).join(names, "context", "left")


def _context_sql():
    from dealspark.plans.text import _CSENT, _CTX, _IMP

    ent = r"""list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(text, '\b([A-Z][a-zA-Z]*(?:[ \t\n]+[A-Z][a-zA-Z]*)*)', 1), lambda e: length(e) > 2), regexp_extract_all(text, '"([^"]+)"', 1))))[1:10]"""
    return f""", {_CTX}, r as (select doc_id, context, {_IMP} as importance, {_CSENT} as mood, {ent} as e from k), x as (select context, entity, count(*) as n from (select context, unnest(e) as entity from r) t group by 1, 2), y as (select *, row_number() over (partition by context order by n desc, entity) as rank from x qualify rank <= 10), z as (select context, string_agg(entity, ';' order by rank) as top_entities from y group by 1)
    select r.context, count(*) as n, round(avg(importance), 4) as importance, count(*) filter (where mood = 'positive') as positive, count(*) filter (where mood = 'negative') as negative, count(*) filter (where mood = 'neutral') as neutral, any_value(top_entities) as top_entities from r left join z on z.context = r.context group by 1"""


register("a17_context_summary", context_summary, _context_sql(), ("vDecks",))


def scored_texts(s, d):
    """a15, a16: texts of three sources with sentiment and risk."""
    decks = view(s, d, "vDecks").select("company", "text")
    files = view(s, d, "vLibrary").select("company", F.concat("file_name", F.lit(" strong growth")).alias("text")).where("file_name like '%v1.pdf'")
    drafts = view(s, d, "vDrafts").select("company", F.concat(F.lit("debt is a problem "), "confidence").alias("text")).where("confidence = 'Low'")
    rows = decks.unionByName(files).unionByName(drafts)
    m = C.sentiment(F.col("text"))
    return rows.select("company", m["score"].alias("score"), C.risk_score(F.col("text")).alias("risk"))


def _level():
    return F.when(F.col("risk") > 0.7, "high").when(F.col("risk") > 0.4, "medium").otherwise("low")


def _mood():
    return F.when(F.col("score") > 0.3, "positive").when(F.col("score") < -0.3, "negative").otherwise("neutral")
#: What the report says for a mood and a level of risk.
ADVICE = [
    ("positive", "low", "Company shows positive indicators with low risk - good investment candidate"), ("positive", "medium", "Positive sentiment but moderate risk - monitor closely"), ("positive", "high", "Positive outlook but high risk factors present"),
    ("negative", "low", "Negative sentiment but low structural risk"), ("negative", "medium", "Negative sentiment with moderate risk - caution advised"), ("negative", "high", "High risk company with negative indicators - avoid investment"),
]


def _mean3(name: str):
    """Mean to three digits, through whole thousandths, so that it doesn't depend on the order of the sum."""
    return F.round(F.sum(F.round(F.col(name) * 1000).cast("long")) / F.count("*")) / 1000


def company_sentiment(s, d):
    per = scored_texts(s, d).groupBy("company").agg(_mean3("score").alias("score"), _mean3("risk").alias("risk"), F.count("*").alias("sources"))
    named = per.select("company", "score", "risk", "sources", _mood().alias("sentiment"), _level().alias("risk_level"))
    advice = s.createDataFrame(ADVICE, "sentiment string, risk_level string, advice string")
    return named.join(F.broadcast(advice), ["sentiment", "risk_level"], "left").withColumn("advice", F.coalesce("advice", F.lit("Neutral sentiment - gather more information")))


def _sentiment_sql(last: str) -> str:
    from dealspark.plans.text import _RISK, sql_sentiment

    return f""", src as (select company, text from vDecks union all select company, file_name || ' strong growth' from vLibrary where file_name like '%v1.pdf' union all select company, 'debt is a problem ' || confidence from vDrafts where confidence = 'Low'), {sql_sentiment('src')},
    sc as (select company, score, {_RISK} as risk from s) {last}"""


_ADV = " ".join(f"when sentiment = '{a}' and risk_level = '{b}' then '{t}'" for a, b, t in ADVICE)
_LV, _MD = "case when risk > 0.7 then 'high' when risk > 0.4 then 'medium' else 'low' end", "case when score > 0.3 then 'positive' when score < -0.3 then 'negative' else 'neutral' end"
register("a15_company_sentiment", company_sentiment, _sentiment_sql(f", p as (select company, round(sum(cast(round(score * 1000) as bigint)) / cast(count(*) as double)) / 1000 as score, round(sum(cast(round(risk * 1000) as bigint)) / cast(count(*) as double)) / 1000 as risk, count(*) as sources from sc group by 1), n as (select *, {_MD} as sentiment, {_LV} as risk_level from p) select *, case {_ADV} else 'Neutral sentiment - gather more information' end as advice from n"), ("vDecks", "vLibrary", "vDrafts"))
register("a16_sentiment_summary", lambda s, d: scored_texts(s, d).groupBy(_mood().alias("sentiment"), _level().alias("risk_level")).agg(F.count("*").alias("n")), _sentiment_sql(f"select {_MD} as sentiment, {_LV} as risk_level, count(*) as n from sc group by 1, 2"), ("vDecks", "vLibrary", "vDrafts"))


def email_stats(s, d, company: str | None = None):
    """a08 over mails that the next event of the log has processed, unless it is an error; company: only mails that name it."""
    b = F.col("body")
    done = table(s, d, "events").where("event_type <> 'error'").select((F.col("event_id") - 1).alias("id"), F.col("ts").alias("processed_at"))
    mails = view(s, d, "vEmails").join(done, "id", "left")
    if company:
        mails = mails.where(F.lower(b).contains(company.lower()))
    rows = mails.select("received_at", "processed_at", F.when(F.col("processed_at").isNull(), "pending").otherwise("processed").alias("status"), C.email_intent(b)["intent"].alias("intent"), C.sender_type(b).alias("sender"))
    return A.reply_stats(rows, ["status", "intent", "sender"], "received_at", "processed_at")


def _email_sql(where: str = "true"):
    from dealspark.plans.text import _INTENT, _SENDER

    agg = "count(*) as n, count(seconds) as processed, round(sum(seconds) / 60.0::double / count(seconds), 4) as mean_minutes, quantile_cont(seconds::double, 0.5) / 60 as median_minutes"
    dims = " ".join(f"union all select '{n}', {n}, {agg} from e group by 2" for n in ("status", "intent", "sender"))
    return f", {_INTENT}, e as (select intent, {_SENDER} as sender, case when p.ts is null then 'pending' else 'processed' end as status, cast(floor(epoch(p.ts)) as bigint) - cast(floor(epoch(o.ts)) as bigint) as seconds from i join events o on o.event_id = id left join events p on p.event_id = id + 1 and p.event_type <> 'error' where {where}) select 'total' as dim, '' as value, {agg} from e {dims}"


register("a08_email_stats", email_stats, _email_sql(), ("vEmails",))
register("a08_email_stats_of", lambda s, d: email_stats(s, d, "the founder"), _email_sql("contains(lower(body), 'the founder')"), ("vEmails",))


_FT = L.FINANCE_TERMS
register("a25_visual_summary", lambda s, d: A.visual_summary(documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n+")).alias("pos", "page")), "doc_id", "pos", "page", _FT, L.VISUAL_ADVICE), f"""with p as (select doc_id, unnest(string_split_regex(text, '\n+')) as page, unnest(range(len(string_split_regex(text, '\n+')))) as pos from documents),
    v as (select doc_id, cast(sum(len(regexp_extract_all(page, '[0-9]{{2,}}'))) as bigint) as charts, string_agg(page, chr(10) order by pos) as text from p group by 1), w as (select *, list_sort(list_filter([{', '.join(f"case when contains(lower(text), '{t}') then '{t}' end" for t in _FT)}], lambda x: x is not null)) as t from v)
    select doc_id, charts, array_to_string(t, ',') as terms, text, array_to_string(list_filter([case when len(t) > 10 then '{L.VISUAL_ADVICE[0]}' when len(t) < 3 then '{L.VISUAL_ADVICE[1]}' end, case when charts > 5 then '{L.VISUAL_ADVICE[2]}' when charts = 0 then '{L.VISUAL_ADVICE[3]}' end], lambda x: x is not null), '; ') as advice from w""")


def mails(s, d):
    """Benchmark items as mails whose first word is the company."""
    rows = table(s, d, "benchmark").select("item_id", "text", F.split("text", " ")[0].alias("company"))
    return S.mail_queries(rows, "item_id", "text", "company", L.MAIL_TERMS)


_MAILS = _BM.replace(f"select item_id as qid, {_WORDS} as w from benchmark", f"select qid, {_WORDS} as w from (select item_id * 3 as qid, text from benchmark union all select item_id * 3 + 1, string_split(text, ' ')[1] from benchmark) t")
register("r05_mail_search", lambda s, d: S.search_for_mails(documents(s, d), "doc_id", "text", mails(s, d), 80, 6), f"with {_MAILS}, h as (select * from bm where score > 0 qualify {_RN} <= 6), a as (select qid // 3 as mail, substr(text, 1, 80) as head, round(sum(score), 4) as score, count(*) as hits from h join documents on doc_id = doc group by 1, 2) select *, cast(row_number() over (partition by mail order by score desc, head) as int) as rank from a qualify rank <= 6")


def background(s, d):
    """r16: items of the benchmark with the revenue of the company and the conversation of the same number."""
    contexts = S.assemble_context(indexed(s, d).bm25(queries(s, d), 5), documents(s, d), "doc_id", "text", 4000, 5 * queries(s, d).count())
    asked = queries(s, d).select("qid").distinct()
    few = S.maybe_broadcast(asked, asked.count())  # what is said and known of other numbers is neither joined nor shuffled
    decks = view(s, d, "vDecks").select(F.col("doc_id").alias("qid"), "company").join(few, "qid", "left_semi")
    known = view(s, d, "vRevenue").join(decks, "company").select("qid", "yr", F.round(F.col("revenue") / 1e6, 1).cast("string").alias("value"))
    return S.with_background(contexts, known, table(s, d, "conversations").withColumnRenamed("conv_id", "qid").join(few, "qid", "left_semi"))


register("r16_context_with_background", background, f""", {_BM}, h as (select qid, doc, {_RN} as r from bm where score > 0 qualify {_RN} <= 5), x as (select qid, substr(string_agg(text, chr(10) order by r), 1, 4000) as context from h join documents on doc_id = doc group by qid),
    k as (select v.doc_id as qid, string_agg('- Revenue for ' || yr || ': ' || cast(round(revenue / 1e6, 1) as varchar), chr(10) order by yr) as known from vRevenue r join vDecks v on v.company = r.company group by 1), c as (select conv_id as qid, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) order by turn) as said from conversations group by 1)
    select x.qid, concat_ws(chr(10) || chr(10), context, 'Known projections:' || chr(10) || known, 'Conversation so far:' || chr(10) || said) as context from x left join k on k.qid = x.qid left join c on c.qid = x.qid""", ("vRevenue", "vDecks"))
