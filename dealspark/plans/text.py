"""Queries on text: scalar functions, extraction, classification and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.functions import lexicons as L
from dealspark.functions import text as X
from dealspark.operators import classify as C
from dealspark.operators import lexicon as LX
from dealspark.operators import relational as R
from dealspark.plans.adapters import view
from dealspark.plans.registry import register, table

def T() -> Column:
    return F.col("text")


def decks(s, d):
    return view(s, d, "vDecks")


def docs(s, d):
    return table(s, d, "documents")


def q(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def pick(df, key: list[str], cols: dict[str, Column]):
    return df.select(*key, *[c.alias(n) for n, c in cols.items()])


def sql_hits(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains(lower({text}), {q(t)}) as int)" for t in terms) + ")"


def sql_first(text: str, classes) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({text}), {q(t)})" for t in terms) + f" then {q(n)}" for n, terms in classes) + " end"


def sql_match(text: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, {q(p)}, 1)), '')" for p in patterns) + ")"


def sql_all(text: str, patterns: list[str]) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in patterns) + ")"


def sql_join(items: list[tuple[str, str]], sep: str = ",") -> str:
    return f"array_to_string(list_filter([{', '.join(f'case when {c} then {q(t)} end' for c, t in items)}], lambda x: x is not null), {q(sep)})"


def sql_money(v: str) -> str:
    """Text of an amount as a number."""
    bare = f"lower(regexp_replace({v}, '[$₹, ]', '', 'g'))"
    unit = f"regexp_extract({bare}, '^[0-9.]+([a-z]*)$', 1)"
    return f"try_cast(nullif(regexp_extract({bare}, '^([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) * case when {unit} in ('k','thousand') then 1e3 when {unit} in ('m','million') then 1e6 when {unit} in ('b','bn','billion') then 1e9 when {unit} = 'crore' then 1e7 when {unit} = 'lakh' then 1e5 else 1.0 end"


def sql_display(v: str) -> str:
    return f"case when {v} >= 1e9 then printf('$%.1fB', {v} / 1e9) when {v} >= 1e6 then printf('$%.1fM', {v} / 1e6) when {v} >= 1e3 then printf('$%.0fK', {v} / 1e3) else '$' || cast(cast(floor({v} + 0.5) as bigint) as varchar) end"


# filters and scalar functions
register("f06_safe_join", lambda s, d: docs(s, d).select("doc_id", X.safe_join([F.col("source"), F.lit(" "), F.col("lang"), F.lit(None).cast("string")], "/").alias("label")), "select doc_id, source || '/' || lang as label from documents")
register("f07_preview", lambda s, d: docs(s, d).select("doc_id", X.preview(T(), 100).alias("preview")), "select doc_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview from documents")
register("f08_clean_placeholder", lambda s, d: decks(s, d).select("doc_id", X.clean_placeholder(F.when(F.col("doc_id") % 3 == 0, "Unavailable").when(F.col("doc_id") % 3 == 1, "Not found in document").otherwise(F.col("company")), "n/a").alias("value")), "select doc_id, case when doc_id % 3 < 2 then 'n/a' else company end as value from vDecks", ("vDecks",))
register("f09_validate_document", lambda s, d: decks(s, d).select("doc_id", X.is_valid_document(T(), 100).alias("valid")), f"select doc_id, length(trim(text)) >= 100 and {sql_hits('text', X.DECK_KEYWORDS)} >= 2 as valid from vDecks", ("vDecks",))
register("x01_clean_text", lambda s, d: docs(s, d).select("doc_id", X.clean_text(T()).alias("clean")), r"select doc_id, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n\t]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) as clean from documents")
register("x02_search_form", lambda s, d: docs(s, d).select("doc_id", X.search_form(T()).alias("form")), r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\r]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) as form from documents")
register("x03_tokens", lambda s, d: docs(s, d).select("doc_id", F.size(X.words_and_money(T())).alias("n"), F.array_join(F.slice(X.words_and_money(T()), 1, 5), " ").alias("head")), r"with t as (select doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_$% \t\n\r]', ' ', 'g'), '[ \t\n\r]+'), lambda x: length(x) > 1) as w from documents) select doc_id, cast(len(w) as int) as n, array_to_string(w[1:5], ' ') as head from t")
register("x04_letter_runs", lambda s, d: docs(s, d).select("doc_id", F.size(X.letter_runs(T())).alias("n"), F.array_join(F.slice(X.letter_runs(T()), 1, 5), " ").alias("head")), r"with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') as w from documents) select doc_id, cast(len(w) as int) as n, array_to_string(w[1:5], ' ') as head from t")
register("x05_blank_split", lambda s, d: docs(s, d).select("doc_id", F.size(X.blank_split(T())).alias("n")), r"select doc_id, cast(len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '')) as int) as n from documents")
register("x06_normalise_numbers", lambda s, d: decks(s, d).select("doc_id", X.normalise_numbers(F.concat(F.lit("Raised $"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit("M last year"))).alias("text")), "select doc_id, 'Raised $' || cast(doc_id % 90 + 1 as varchar) || ',000,000 last year' as text from vDecks", ("vDecks",))
register("x07_chart_noise", lambda s, d: docs(s, d).select("doc_id", X.drop_chart_noise(T()).alias("clean")), r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?:\b[0-9]{1,3}\b[ \t]+){2,}[0-9]{1,3}\b', ' ', 'g'), '(^|[ \t\n])[0-9]{1,3}($|[ \t\n])', ' ', 'g'), '[ \t]+', ' ', 'g')) as clean from documents")
register("k05_segments", lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.slice(F.filter(F.split(T(), "\n+"), lambda x: F.trim(x) != ""), 1, 8)).alias("pos", "segment")), r"with s as (select doc_id, list_filter(string_split_regex(text, '\n+'), lambda x: trim(x) <> '')[1:8] as s from documents) select doc_id, cast(i - 1 as int) as pos, s[i] as segment from s, unnest(range(1, len(s) + 1)) t(i)")


def sql_argmax(text: str, classes, none: str) -> str:
    most = "greatest(" + ", ".join(sql_hits(text, t) for _, t in classes) + ")"
    return f"case when {most} = 0 then {q(none)} " + " ".join(f"when {sql_hits(text, t)} = {most} then {q(n)}" for n, t in classes) + " end"


register("k06_chunk_type", lambda s, d: decks(s, d).select("doc_id", X.argmax_class(T(), L.CHUNK_TYPES, "general").alias("chunk_type")), f"select doc_id, {sql_argmax('text', L.CHUNK_TYPES, 'general')} as chunk_type from vDecks", ("vDecks",))
register("k07_block_class", lambda s, d: decks(s, d).select("doc_id", F.when(T().contains("|"), "table").when(F.lower(T()).contains("revenue"), "financial").otherwise("other").alias("block")), "select doc_id, case when contains(text, '|') then 'table' when contains(lower(text), 'revenue') then 'financial' else 'other' end as block from vDecks", ("vDecks",))
register("a20_chunk_type_counts", lambda s, d: decks(s, d).select(X.argmax_class(T(), L.CHUNK_TYPES, "general").alias("chunk_type")).groupBy("chunk_type").agg(F.count("*").alias("n")), f"select {sql_argmax('text', L.CHUNK_TYPES, 'general')} as chunk_type, count(*) as n from vDecks group by 1", ("vDecks",))
register("s06_html_to_text", lambda s, d: table(s, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text")), r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages")

# extraction
_E1 = ", ".join(f"coalesce({sql_match('text', p)}, 'Not found') as {k}" for k, p in L.MINED_PATTERNS.items())
register("e01_mined_metrics", lambda s, d: pick(decks(s, d), ["doc_id"], C.mined_metrics(T())), f"select doc_id, {_E1} from vDecks", ("vDecks",))
_E2 = ", ".join(f"{sql_match('text', p)} as {k}" for k, p in L.DECK_PATTERNS.items())
_E2C = ", ".join(f"case when {k} is not null then {c} else 0.0 end::double as {k}_confidence" for k, c in L.DECK_CONFIDENCE.items())
register("e02_deck_metrics", lambda s, d: pick(decks(s, d), ["doc_id"], C.deck_metrics(T())), f", m as (select doc_id, {_E2} from vDecks) select *, {_E2C} from m", ("vDecks",))
_SIZE = "coalesce(" + ", ".join(f"case when try_cast(regexp_extract(lower(text), {q(p)}, 1) as int) between 1 and 10000 then try_cast(regexp_extract(lower(text), {q(p)}, 1) as int) end" for p in L.TEAM_SIZE_PATTERNS) + ")"
_E3 = f""", m as (select doc_id, {_E2}, {_SIZE} as size from vDecks), n as (select doc_id, {sql_money('revenue')} as revenue, {sql_money('market_size')} as tam, {sql_money('users')} as users_n, try_cast(nullif(regexp_extract(growth_rate, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), '') as double) as g, size from m),
    o as (select *, case when g > 0 and g < 1000 then g end as growth from n)"""
register("e03_numeric_metrics", lambda s, d: pick(decks(s, d), ["doc_id"], C.numeric_metrics(T())), f"{_E3} select doc_id, revenue, case when revenue is not null then {sql_display('revenue')} end as revenue_display, growth, tam, users_n, round(((revenue is not null)::int + (growth is not null)::int + (tam is not null)::int + (users_n is not null)::int + (size is not null)::int) / cast(5 as double), 4) as completeness from o", ("vDecks",))


def extraction_struct(s, d):
    """e04: a nested record with source and confidence of each metric."""
    m = C.deck_metrics(T())
    metric = lambda k: F.struct(m[k].alias("value"), m[f"{k}_confidence"].alias("confidence"), F.when(m[k].isNotNull(), "text").alias("source"))
    return decks(s, d).select("doc_id", F.struct(metric("revenue").alias("revenue"), metric("stage").alias("stage"), metric("users").alias("users")).alias("metrics")).select("doc_id", F.col("metrics.revenue.value").alias("revenue"), F.col("metrics.revenue.source").alias("source"), F.col("metrics.stage.value").alias("stage"), F.col("metrics.users.confidence").alias("users_confidence"))


register("e04_extraction_struct", extraction_struct, f", m as (select doc_id, {_E2} from vDecks) select doc_id, revenue, case when revenue is not null then 'text' end as source, stage, case when users is not null then 0.45 else 0.0 end::double as users_confidence from m", ("vDecks",))
_TEAM = "text || case when doc_id % 2 = 0 then ' Founders: ada pike' || cast(doc_id % 9 as varchar(2)) || '\n CEO: bo lund. Team of ' || cast(doc_id % 60 as varchar(3)) else '' end"
def _team() -> Column:
    return F.concat(T(), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Founders: ada pike"), (F.col("doc_id") % 9).cast("string"), F.lit("\n CEO: bo lund. Team of "), (F.col("doc_id") % 60).cast("string"))).otherwise(""))
register("e05_founders", lambda s, d: decks(s, d).withColumn("text", _team()).select("doc_id", F.array_join(C.founders(T()), ";").alias("founders")), f""", t as (select doc_id, {_TEAM} as text from vDecks), f as (select doc_id, {sql_all('lower(text)', L.FOUNDER_PATTERNS)} as f from t)
    select doc_id, array_to_string(list_filter(list_transform(f, lambda x: array_to_string(list_transform(string_split(trim(x), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')), lambda x: length(x) > 2)[1:5], ';') as founders from f""", ("vDecks",))
register("e06_team_size", lambda s, d: decks(s, d).withColumn("text", _team()).select("doc_id", C.team_size(T()).alias("team_size")), f", t as (select doc_id, {_TEAM} as text from vDecks) select doc_id, {_SIZE} as team_size from t", ("vDecks",))
register("e07_industry", lambda s, d: decks(s, d).select("doc_id", X.first_class(T(), L.INDUSTRIES[13]).alias("industry"), X.first_class(T(), L.INDUSTRIES[8]).alias("industry_8"), X.first_class(T(), L.INDUSTRIES[6]).alias("industry_6")), f"select doc_id, {sql_first('text', L.INDUSTRIES[13])} as industry, {sql_first('text', L.INDUSTRIES[8])} as industry_8, {sql_first('text', L.INDUSTRIES[6])} as industry_6 from vDecks", ("vDecks",))
_STAGE = "case " + " ".join(f"when contains(lower(text), {q(x)}) then {q('Pre-seed' if x in ('pre-seed', 'preseed') else x)}" for x in L.STAGES) + f" when {sql_hits('text', L.EARLY)} > {sql_hits('text', L.GROWTH)} then 'early stage' when {sql_hits('text', L.GROWTH)} > {sql_hits('text', L.EARLY)} then 'growth stage' end"
register("e08_funding_stage", lambda s, d: decks(s, d).select("doc_id", C.funding_stage(T()).alias("stage")), f"select doc_id, {_STAGE} as stage from vDecks", ("vDecks",))
register("e09_company_from_file", lambda s, d: view(s, d, "vLibrary").select("id", C.company_from_file(F.col("file_name")).alias("company")), r"""select id, regexp_replace(trim(regexp_replace(regexp_replace(file_name, '\.pdf$', ''), '[_-]', ' ', 'g')), '(?i)(^| )((pitch|deck|pitchdeck|presentation|final|draft)[0-9]*|v[0-9]+[^ ]*|[0-9]{8})( .*)?$', '') as company from vLibrary""", ("vLibrary",))
_TITLED = "case doc_id % 4 when 0 then replace(company, '#', ' ') || ' | Pitch Deck' || chr(10) when 1 then 'Confidential' || chr(10) || replace(company, '#', ' No') || chr(10) when 2 then 'Welcome to Orchid! ' else 'Our Team. ' end || text"


def sql_name(text: str) -> str:
    """The name of a company in a text, by patterns, else by a title line."""
    found = [f"trim(regexp_replace(regexp_extract(substr({text}, 1, 2000), {q(p)}, 1), '\\s+', ' ', 'g'))" for p in L.NAME_PATTERNS]
    valid = [f"case when length({n}) between 2 and 40 and lower({n}) not in ({', '.join(map(q, L.NOT_NAMES))}) then {n} end" for n in found]
    lines = f"list_transform(string_split(substr({text}, 1, 500), chr(10)), lambda x: trim(x))"
    return f"coalesce({', '.join(valid)}, list_filter({lines}, lambda x: length(x) between 2 and 35 and regexp_matches(x, {q(C.TITLE_LINE)}) and not regexp_matches(lower(x), {q('|'.join(L.NOT_TITLES))}))[1])"


register("e10_company_from_text", lambda s, d: decks(s, d).withColumn("text", F.expr(_TITLED)).select("doc_id", C.company_from_text(T()).alias("name")), f", t as (select doc_id, {_TITLED} as text from vDecks) select doc_id, {sql_name('text')} as name from t", ("vDecks",))
register("e10_company_from_page", lambda s, d: table(s, d, "pages").select("page_id", C.company_from_text(F.col("url")).alias("name")), f"select page_id, {sql_name('url')} as name from pages")
_YEARS = "'In 2023: $' || cast(doc_id % 50 + 1 as varchar(3)) || 'M and Year 2 - ' || cast(doc_id % 7 + 1 as varchar(3)) || ' crore, 2024 was quiet, 2023 = $9K'"
register("e11_year_revenues", lambda s, d: C.year_revenues(decks(s, d).select("doc_id", F.expr(_YEARS).alias("text")), "doc_id", "text"), "select doc_id, '2023' as yr, (doc_id % 50 + 1) * 1e6 as revenue from vDecks union all select doc_id, 'year 2', (doc_id % 7 + 1) * 1e7 from vDecks", ("vDecks",))


def revenue_statements(s, d):
    """e11: companies' yearly revenues as prose, odd years after their amount and even years before it, read back."""
    said = F.when(F.col("yr") % 2 == 0, F.format_string("%d: $%s", F.col("yr") + 20, "amount")).otherwise(F.format_string("$%s in %d", "amount", F.col("yr") + 20))
    rows = view(s, d, "vRevenue").select("company", F.col("yr").cast("int").alias("yr"), F.col("revenue").cast("decimal(18,2)").cast("string").alias("amount"))
    lines = rows.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("yr", said.alias("said")))).alias("l"))
    return C.year_revenues(lines.select("company", F.concat(F.lit("Revenue was "), F.array_join(F.transform("l", lambda x: x["said"]), " and ")).alias("text")), "company", "text").withColumn("revenue", F.round("revenue", 2))


register("e11_revenue_statements", revenue_statements, "select company, cast(cast(yr as int) + 20 as varchar) as yr, round(cast(cast(revenue as decimal(18,2)) as double), 2) as revenue from vRevenue", ("vRevenue",))
_LAKHS = "'2022: ₹' || cast(doc_id % 30 + 1 as varchar(3)) || ' lakh, 2021: 3 crore'"
register("e12_year_revenues_rupees", lambda s, d: C.year_revenues(decks(s, d).select("doc_id", F.expr(_LAKHS).alias("text")), "doc_id", "text"), "select doc_id, '2022' as yr, (doc_id % 30 + 1) * 1e5 as revenue from vDecks union all select doc_id, '2021', 3e7 from vDecks", ("vDecks",))
_PIPE = "'| Year | Revenue |\n| 2022 | $' || cast(doc_id % 9 + 1 as varchar(2)) || case when doc_id % 4 = 0 then '' else 'M' end || ' |\n| 2023 | $20M |\nnote | x'"
register("e13_pipe_tables", lambda s, d: C.pipe_tables(decks(s, d).select("doc_id", F.expr(_PIPE).alias("text")), "doc_id", "text"), "select doc_id, case when doc_id % 4 = 0 then 'unavailable' else 'ok' end as status, case when doc_id % 4 = 0 then 0 else 2 end as points, case when doc_id % 4 <> 0 then '$20.0M' end as display from vDecks", ("vDecks",))
register("e14_best_text_revenue", lambda s, d: decks(s, d).select("doc_id", C.best_text_revenue(F.expr("replace(text, company, '')")).alias("best")), f""", t as (select doc_id, replace(text, company, '') as text from vDecks), a as (select doc_id, text, list_transform(regexp_extract_all(text, '(?i)(\\$? *[0-9][0-9,]*(?:\\.[0-9]+)? *[kmb]?)', 1), lambda x: {sql_money('x')}) as v from t)
    select doc_id, case when regexp_matches(lower(text), 'revenue|arr') then list_max(list_filter(v, lambda x: x >= 1e4 and x < 1e9)) end as best from a""", ("vDecks",))
register("e16_ocr_metrics", lambda s, d: docs(s, d).select("doc_id", F.size(F.slice(F.regexp_extract_all(T(), F.lit("([0-9]+)"), 1), 1, 10)).alias("numbers"), F.array_join(F.slice(F.regexp_extract_all(T(), F.lit("((?:19|20)[0-9]{2})"), 1), 1, 5), ",").alias("years")), "select doc_id, cast(len(regexp_extract_all(text, '([0-9]+)', 1)[1:10]) as int) as numbers, array_to_string(regexp_extract_all(text, '((?:19|20)[0-9]{2})', 1)[1:5], ',') as years from documents")
register("e17_revenue_proxy", lambda s, d: decks(s, d).select("doc_id", F.coalesce(F.when(X.money_value(X.first_match(T(), L.DECK_PATTERNS["revenue"])) >= 10_000, X.money_value(X.first_match(T(), L.DECK_PATTERNS["revenue"]))), X.money_value(X.first_match(T(), L.DECK_PATTERNS["market_size"])) * 0.001).alias("proxy")), f", m as (select doc_id, {_E2} from vDecks) select doc_id, coalesce(case when {sql_money('revenue')} >= 10000 then {sql_money('revenue')} end, {sql_money('market_size')} * 0.001) as proxy from m", ("vDecks",))
_OPS = "'Fleet of ' || cast(doc_id % 500 as varchar(4)) || ' vehicles, ' || cast(doc_id % 100 as varchar(3)) || '% retention and occupancy: ' || cast(doc_id % 90 as varchar(3)) || '%'"
_OPS_PATTERNS = {"fleet": [r"(?i)fleet of ([0-9]+)"], "retention": [r"(?i)([0-9]+%) retention"], "occupancy": [r"(?i)occupancy: *([0-9]+%)"]}
register("e18_operational_metrics", lambda s, d: pick(decks(s, d).select("doc_id", F.expr(_OPS).alias("text")), ["doc_id"], {k: X.first_match(T(), p) for k, p in _OPS_PATTERNS.items()}), "select doc_id, cast(doc_id % 500 as varchar) as fleet, cast(doc_id % 100 as varchar) || '%' as retention, cast(doc_id % 90 as varchar) || '%' as occupancy from vDecks", ("vDecks",))
_FOUND = ", ".join(f"{sql_all('text', [f'(?i){x}' for x in p])} as {n}" for n, p in [("amounts", L.FIGURES), *[(n, p) for n, _, p in L.INSIGHTS]])
_KINDS = [f"case when len({n}) > 0 then {q(t)} end" for n, t, _ in L.INSIGHTS]
_SAID = ["case when len(amounts) > 0 then 'Financial figures detected: ' || array_to_string(amounts[1:5], ', ') end", _KINDS[0], *[f"case when regexp_matches(lower(text), {q(p)}) then {q(f'Business model: {n}')} end" for n, p in L.BUSINESS_MODELS], *_KINDS[1:]]
register("e20_document_insights", lambda s, d: C.insights_of(decks(s, d), "doc_id"), f", i as (select doc_id, text, {_FOUND} from vDecks) select doc_id, coalesce({sql_first('text', L.DOC_TYPES)}, 'unknown') as doc_type, {sql_join([(f'regexp_matches(lower(text), {q(p)})', n) for n, p in L.BUSINESS_MODELS])} as models, array_to_string(amounts[1:5], ', ') as figures, {', '.join(f"array_to_string({n}, ';') as {n}" for n, _, _ in L.INSIGHTS)}, array_to_string(list_filter([{', '.join(_SAID)}], lambda x: x is not null), ' | ') as insights from i", ("vDecks",))
register("e21_entities", lambda s, d: decks(s, d).select("doc_id", F.array_join(C.entities(T()), ";").alias("entities")), r"""select doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(text, '\b([A-Z][a-zA-Z]*(?:[ \t\n]+[A-Z][a-zA-Z]*)*)', 1), lambda e: length(e) > 2), regexp_extract_all(text, '"([^"]+)"', 1))))[1:10], ';') as entities from vDecks""", ("vDecks",))

# money and years
register("x20_money_value", lambda s, d: table(s, d, "orders").select("o_orderkey", X.money_value(X.money_display(F.col("o_totalprice"))).alias("value")), f"select o_orderkey, {sql_money('(' + sql_display('o_totalprice') + ')')} as value from orders")
register("x21_money_display", lambda s, d: table(s, d, "orders").select("o_orderkey", X.money_display(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(1)).alias("display")), f"select o_orderkey, {sql_display('(o_totalprice * case when o_orderkey % 2 = 0 then 1000 else 1 end)')} as display from orders")
_YR = "case when length(company) % 2 = 0 and cast(yr as int) % 3 = 0 then 'Year ' || cast(cast(yr as int) % 10 + 1 as varchar(2)) when cast(yr as int) % 3 = 1 then cast(cast(yr as int) % 20 + 1 as varchar(2)) else yr end"
register("x22_normal_year", lambda s, d: view(s, d, "vRevenue").select("company", "yr", X.normal_year(F.expr(_YR)).alias("year")), f"select company, yr, cast(case when regexp_matches(y, '^[0-9]{{4}}$') then cast(y as int) else 2024 + cast(regexp_extract(y, '^(?:Year )?([0-9]{{1,2}})$', 1) as int) - 1 end as int) as year from (select company, yr, {_YR} as y from vRevenue) t", ("vRevenue",))
register("x23_scenarios", lambda s, d: view(s, d, "vRevenue").select("company", "yr", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("by")) for n, m in (("best", 1.2), ("base", 1.0), ("worst", 0.7))])).alias("x"), "revenue").select("company", "yr", "x.scenario", F.concat(F.lit("$"), X.fixed(F.col("revenue") * F.col("x.by") / 1e6, 1), F.lit("M")).alias("value")), "select company, yr, scenario, printf('$%.1fM', revenue * m / 1e6) as value from vRevenue, (values ('best', 1.2), ('base', 1.0), ('worst', 0.7)) s(scenario, m)", ("vRevenue",))
register("x24_compound_projection", lambda s, d: pick(decks(s, d), ["doc_id"], {"projected": F.round(F.coalesce(X.money_value(X.first_match(T(), L.DECK_PATTERNS["revenue"])), F.lit(1e6)) * F.pow(1 + F.coalesce(X.percent_value(X.first_match(T(), L.DECK_PATTERNS["growth_rate"])), F.lit(50.0)) / 100, 5), 0)}), f", m as (select doc_id, {_E2} from vDecks) select doc_id, round(coalesce({sql_money('revenue')}, 1e6) * pow(1 + coalesce(try_cast(nullif(regexp_extract(growth_rate, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), '') as double), 50.0) / 100, 5), 0) as projected from m", ("vDecks",))
register("x25_growth_rate", lambda s, d: view(s, d, "vRevenue").groupBy("company").agg(F.round((F.max_by("revenue", "yr") - F.min_by("revenue", "yr")) / F.min_by("revenue", "yr") * 100, 4).alias("growth")), "select company, round((max_by(revenue, yr) - min_by(revenue, yr)) / min_by(revenue, yr) * 100, 4) as growth from vRevenue group by 1", ("vRevenue",))

# classification
_POS, _NEG = L.POSITIVE, L.NEGATIVE
_NET = " + ".join(f"((length(lower(text)) - length(replace(lower(text), {q(t)}, ''))) // {len(t)}) * ({w})" for t, w in {**_POS, **_NEG}.items())
_WORDS = r"len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> ''))"


def sql_sentiment(src: str) -> str:
    return f"s as (select *, {_WORDS} as words, round(greatest(-1.0, least(1.0, cast({_NET} as double) / ({_WORDS} * 0.1))), 3) as score from {src})"


_LABEL = "case when score > 0.3 then 'positive' when score < -0.3 then 'negative' else 'neutral' end"
register("c01_sentiment", lambda s, d: pick(decks(s, d), ["doc_id"], C.sentiment(T())), f""", {sql_sentiment('vDecks')} select doc_id, score, {_LABEL} as sentiment, round(least(1.0, {sql_hits('text', [*_POS, *_NEG])} / greatest(cast(words as double) * 0.05, 1.0)), 3) as confidence,
    {sql_join([(f'contains(lower(text), {q(t)})', t) for t in _POS])} as positive, {sql_join([(f'contains(lower(text), {q(t)})', t) for t in _NEG])} as negative, cast(words as int) as words from s""", ("vDecks",))
_RISK_TEXT = "text || case doc_id % 5 when 0 then ' High burn rate and volatile cash, a default on the loan.' when 1 then ' Stable and manageable with moderate concern.' else '' end"
_CNT = [(f"len(regexp_extract_all(lower(text), {q(p)}))", s, L.RISK_WEIGHTS[lv]) for lv, p, s in L.RISKS]
_RISK = f"round(case when {' + '.join(f'{c} * {w}' for c, _, w in _CNT)} > 0 then least(1.0, cast({' + '.join(f'{c} * cast({s} as double) * {w}' for c, s, w in _CNT)} as double) / ({' + '.join(f'{c} * {w}' for c, _, w in _CNT)})) else 0.0 end, 6)"
register("c02_risk", lambda s, d: decks(s, d).withColumn("text", F.expr(_RISK_TEXT)).select("doc_id", C.risk_score(T()).alias("risk")), f", t as (select doc_id, {_RISK_TEXT} as text from vDecks) select doc_id, {_RISK} as risk from t", ("vDecks",))
_IND = " union all ".join(f"select doc_id, low, {q(lv)} as level, {s} as score, unnest(regexp_extract_all(low, {q('(' + p + ')')}, 1)) as indicator from t" for lv, p, s in L.RISKS)
register("c02_risk_indicators", lambda s, d: C.risk_indicators(decks(s, d).withColumn("text", F.expr(_RISK_TEXT)), "doc_id", "text"), f", t as (select doc_id, lower({_RISK_TEXT}) as low from vDecks), i as ({_IND}) select doc_id, level, cast(score as double) as score, indicator, trim(substr(low, greatest(1, strpos(low, indicator) - 50), strpos(low, indicator) + length(indicator) + 50 - greatest(1, strpos(low, indicator) - 50))) as context from i", ("vDecks",))
register("c03_risk_categories", lambda s, d: pick(decks(s, d), ["doc_id"], {n: X.hits(T(), t) > 0 for n, t in L.RISK_CATEGORIES}), "select doc_id, " + ", ".join(f"{sql_hits('text', t)} > 0 as {n}" for n, t in L.RISK_CATEGORIES) + " from vDecks", ("vDecks",))
_LEX = [("up", t, w) for t, w in L.POSITIVE.items() if " " not in t] + [("down", t, w) for t, w in L.NEGATIVE.items()]
register("c00_lexicon_join", lambda s, d: C.score_lexicon(decks(s, d), "text", "doc_id", s.createDataFrame(_LEX, "category string, term string, weight double")), f", w as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) as term from vDecks), l(category, term, weight) as (values {', '.join(f'({q(c)}, {q(t)}, {w}::double)' for c, t, w in _LEX)}) select doc_id, category, count(distinct term) as hits, cast(count(*) as bigint) as occurrences, round(sum(weight), 6) as score from w join l using (term) group by 1, 2", ("vDecks",))
def B() -> Column:
    return F.col("body")


_PAD = r"(' ' || trim(regexp_replace(lower(body), '[^\p{L}\p{N}'']+', ' ', 'g')) || ' ')"


def sql_words(terms: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains(p, {q(' ' + t + ' ')}) as int)" for t in terms) + ")"


def sql_word_list(terms: list[str]) -> str:
    return sql_join([(f"contains(p, {q(' ' + t + ' ')})", t) for t in terms])


_INTENT = f"""p as (select *, {_PAD} as p from vEmails), n as (select *, {sql_words(L.INTERESTED)} * 2 as y, {sql_words(L.NOT_INTERESTED)} * 3 as n, {sql_words(L.PENDING)} as m from p),
    i as (select *, case when n > y and n > 0 then 'not_interested' when y > 0 then 'interested' else 'pending' end as intent, round(least(1.0, case when n > y and n > 0 then n / 3.0 when y > 0 then y / 4.0 else m / 2.0 end::double), 2) as confidence from n)"""
register("c04_email_intent", lambda s, d: pick(view(s, d, "vEmails"), ["id"], C.email_intent(B())), f", {_INTENT} select id, intent, confidence, case when n > y and n > 0 then {sql_word_list(L.NOT_INTERESTED)} when y > 0 then {sql_word_list(L.INTERESTED)} else {sql_word_list(L.PENDING)} end as keywords from i", ("vEmails",))
_SENDER = f"case when {sql_hits('body', L.INVESTOR)} > {sql_hits('body', L.CLIENT)} then 'investor' when {sql_hits('body', L.CLIENT)} > {sql_hits('body', L.INVESTOR)} then 'client' else 'unknown' end"
register("c05_sender_type", lambda s, d: view(s, d, "vEmails").select("id", C.sender_type(B()).alias("sender")), f"select id, {_SENDER} as sender from vEmails", ("vEmails",))


def by_table(s, rows) -> DataFrame:
    return s.createDataFrame(rows, LX.LEXICON)


_MOODS = [("up", 0, t, w, "substring") for t, w in _POS.items()] + [("down", 1, t, w, "substring") for t, w in _NEG.items()]
_ANSWERS = [("not_interested", L.NOT_INTERESTED), ("interested", L.INTERESTED), ("pending", L.PENDING)]
_LEVELS = [(level, 9, p, score, "regex") for level, p, score in L.RISKS]


def sentiment_by_table(s, d):
    """c01 from a lexicon table."""
    net = LX.score(decks(s, d), "doc_id", "text", by_table(s, _MOODS)).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("net"))
    words = LX.words_of(T())
    score = F.when(words > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("net", F.lit(0.0)) / (words * 0.1)))).otherwise(0.0)
    return decks(s, d).join(net, "doc_id", "left").select("doc_id", F.round(score, 3).alias("score"))


register("c00_sentiment_by_table", sentiment_by_table, f", {sql_sentiment('vDecks')} select doc_id, score from s", ("vDecks",))
register("c00_sender_by_table", lambda s, d: LX.score(view(s, d, "vEmails"), "id", "body", by_table(s, LX.table_of([("investor", L.INVESTOR), ("client", L.CLIENT)])), "argmax", none="unknown", tie="unknown").withColumnRenamed("category", "sender"), f"select id, {_SENDER} as sender from vEmails", ("vEmails",))
register("c00_industry_by_table", lambda s, d: LX.score(decks(s, d), "doc_id", "text", by_table(s, LX.table_of(L.INDUSTRIES[13])), "first_class").withColumnRenamed("category", "industry"), f"select doc_id, {sql_first('text', L.INDUSTRIES[13])} as industry from vDecks", ("vDecks",))
register("c00_chunk_type_by_table", lambda s, d: LX.score(table(s, d, "documents"), "doc_id", "text", by_table(s, LX.table_of(L.CHUNK_TYPES)), "argmax", none="general").withColumnRenamed("category", "chunk_type"), f"select doc_id, {sql_argmax('text', L.CHUNK_TYPES, 'general')} as chunk_type from documents")
register("c00_risks_by_table", lambda s, d: LX.score(docs(s, d), "doc_id", "text", by_table(s, LX.table_of(L.RISK_CATEGORIES)), "any"), " union all ".join(f"select doc_id, {q(n)} as category from documents where {sql_hits('text', t)} > 0" for n, t in L.RISK_CATEGORIES))
register("c00_answers_by_table", lambda s, d: LX.score(view(s, d, "vEmails"), "id", "body", by_table(s, LX.table_of(_ANSWERS, "word"))).select("id", "category", "hits"), f", p as (select *, {_PAD} as p from vEmails) " + " union all ".join(f"select id, {q(n)} as category, cast({sql_words(t)} as bigint) as hits from p where {sql_words(t)} > 0" for n, t in _ANSWERS), ("vEmails",))


def sql_times(rows) -> str:
    """Occurrences of the rows of a lexicon in documents, kind by kind."""
    values = lambda kind: ", ".join(f"({q(c)}, {q(t)}, {w}::decimal(18,6))" for c, _, t, w, k in rows if k == kind)
    sizes = sorted({len(t.split(" ")) for *_, t, _, k in rows if k == "word"})
    grams = " union all ".join(f"select doc_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as term from w" for n in sizes)
    return f"""with t as (select doc_id, lower(text) as low from documents), w as (select doc_id, list_filter(string_split_regex(low, '[^\\p{{L}}\\p{{N}}'']+'), lambda x: x <> '') as w from t), g as ({grams}),
        f as (select doc_id, category, weight, (length(low) - length(replace(low, term, ''))) // length(term) as n from t, (values {values('substring')}) v(category, term, weight)
            union all select doc_id, category, weight, len(regexp_extract_all(low, term)) from t, (values {values('regex')}) v(category, term, weight)
            union all select doc_id, category, any_value(weight), count(*) from g join (select row_number() over () as r, * from (values {values('word')}) v(category, term, weight)) using (term) group by doc_id, category, r)
        select doc_id, category, count(*) as hits, cast(sum(n) as bigint) as occurrences, cast(sum(n * weight) as double) as score from f where n > 0 group by 1, 2"""


_EVERY_KIND = [*_MOODS, *LX.table_of([(f"answer_{n}", t) for n, t in _ANSWERS], "word"), *_LEVELS]
register("c00_every_kind", lambda s, d: LX.score(docs(s, d), "doc_id", "text", by_table(s, _EVERY_KIND)), sql_times(_EVERY_KIND))


def blended(s, d):
    """c06: keyword verdicts beside a table of model verdicts."""
    words = pick(view(s, d, "vEmails"), ["id"], C.email_intent(B()))
    model = view(s, d, "vEmails").where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, "interested").otherwise("pending").alias("model_label"), ((F.col("id") % 10) / 10).alias("model_conf"))
    j = words.join(model, "id", "left")
    return pick(j, ["id"], C.blend(F.col("model_label"), F.col("model_conf"), F.col("intent"), F.col("confidence")))


register("c06_blend", blended, f""", {_INTENT}, j as (select id, intent as wl, confidence as wc, case when id % 3 <> 0 then case when id % 2 = 0 then 'interested' else 'pending' end end as ml, (id % 10) / 10.0::double as mc from i)
    select id, case when ml is not null and mc > 0.7 then ml else wl end as label, round(case when ml is null then wc when mc > 0.7 then mc when mc > 0.4 and ml = wl then (mc + wc) / 2 else wc end, 4) as confidence,
    case when ml is null then 'keyword_only' when mc > 0.7 then 'model' when mc > 0.4 and ml = wl then 'model+keyword' else 'keyword' end as method from j""", ("vEmails",))
_EI = sql_argmax("body", L.EMAIL_INTENTS, "other")
_EMAX = "greatest(" + ", ".join(sql_hits("body", t) for _, t in L.EMAIL_INTENTS) + ")"
register("c07_classify_email", lambda s, d: pick(view(s, d, "vEmails"), ["id"], C.classify_email(B())), f""", i as (select *, {_EI} as intent from vEmails) select id, intent, round(least({_EMAX} / cast(3 as double), 1.0), 6) as confidence, intent in ('interested','due_diligence','question') as needs_context,
    coalesce({sql_first('body', L.EMAIL_SENDERS)}, 'unknown') as sender, case when intent in ('due_diligence','interested') then 'high' else 'medium' end as urgency, {sql_join([(f"{sql_hits('body', t)} > 0", n) for n, t in L.EMAIL_INTENTS])} as topics, nullif(regexp_extract(body, {q(L.MAIL_COMPANY)}, 1), '') as company from i""", ("vEmails",))
_CC = [(n, "(" + " + ".join(f"cast(regexp_matches(lower(text), {q(C._context_pattern(p))}) as int)" for p in ps) + ")") for n, ps in L.CONTEXTS]
_CMAX = "greatest(" + ", ".join(c for _, c in _CC) + ")"
_CTX = f"k as (select *, case when {_CMAX} = 0 then 'general' " + " ".join(f"when {c} = {_CMAX} then {q(n)}" for n, c in _CC) + " end as context from vDecks)"
_FLAGS = " + case when doc_id % 11 = 0 then 0.2 else 0.0 end + case when doc_id % 13 = 0 then 0.1 else 0.0 end"
_IMP = f"round(least(1.0, 0.5 + case when regexp_matches(lower(text), '\\$[0-9]|[0-9] *(million|billion) *usd') then 0.2 else 0.0 end + case when context = 'deal' then 0.15 else 0.0 end + case when regexp_matches(lower(text), {q(C._context_pattern('ceo|cto|founder|board|decided|approved'))}) then 0.1 else 0.0 end + case when length(text) > 500 then 0.05 else 0.0 end)::double, 4)"
_CSENT = f"case when {sql_hits('text', L.CONTEXT_POSITIVE)} > {sql_hits('text', L.CONTEXT_NEGATIVE)} then 'positive' when {sql_hits('text', L.CONTEXT_NEGATIVE)} > {sql_hits('text', L.CONTEXT_POSITIVE)} then 'negative' else 'neutral' end"
register("c08_detect_context", lambda s, d: pick(decks(s, d), ["doc_id"], C.detect_context(T(), F.col("doc_id") % 11 == 0, F.col("doc_id") % 13 == 0)), f", {_CTX} select doc_id, context, {sql_join([(f"{sql_hits('text', t)} > 0", n) for n, t in L.TOPICS])} as topics, {_CSENT} as sentiment, {_IMP.replace(')::double', _FLAGS + ')::double')} as importance from k", ("vDecks",))
register("x26_expiry", lambda s, d: decks(s, d).select("doc_id", C.detect_context(T())["context"].alias("context")).select("doc_id", "context", C.expiry(F.col("context"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 100).cast("int"))).alias("expires")).withColumn("expired", F.coalesce(F.col("expires") < F.lit("2024-06-01").cast("date"), F.lit(False))), f", {_CTX}, e as (select doc_id, context, cast(case context when 'market' then date '2024-01-01' + cast(doc_id % 100 + 30 as int) when 'financial' then date '2024-01-01' + cast(doc_id % 100 + 90 as int) when 'deal' then date '2024-01-01' + cast(doc_id % 100 + 180 as int) when 'company' then date '2024-01-01' + cast(doc_id % 100 + 365 as int) end as date) as expires from k) select *, coalesce(expires < date '2024-06-01', false) as expired from e", ("vDecks",))
_NICE = {"interested": "Interested", "not_interested": "Not Interested", "pending": "Pending"}
register("c10_intent_summary", lambda s, d: pick(view(s, d, "vEmails"), ["id"], C.email_intent(B())).select("id", F.create_map(*[F.lit(x) for kv in _NICE.items() for x in kv])[F.col("intent")].alias("label"), F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence")), f", {_INTENT} select id, case intent when 'interested' then 'Interested' when 'not_interested' then 'Not Interested' else 'Pending' end as label, printf('%.0f%%', confidence * 100) as confidence from i", ("vEmails",))
register("c11_pitch_fallback", lambda s, d: pick(decks(s, d), ["doc_id"], C.pitch_fallback(T())), f""", m as (select doc_id, text, {sql_match('text', [r'([$][0-9][0-9,.]*[MBK]?)'])} as revenue, {sql_match('text', ['(?i)([0-9]+%) +(?:growth|yoy|cagr)'])} as growth_rate, {sql_match('text', ['(?i)([0-9]+) +months? +runway'])} || ' months' as runway from vDecks)
    select doc_id, revenue, growth_rate, runway, {sql_join([('revenue is null', 'No revenue data found in pitch materials'), ("contains(lower(text), 'competiti')", 'Competitive landscape mentioned')], '; ')} as flags from m""", ("vDecks",))
register("c12_chart_shape", lambda s, d: pick(table(s, d, "part"), ["p_partkey"], C.chart_shape(F.col("p_size"), F.col("p_partkey") % 50 + 1)), "select p_partkey, case when p_size / (p_partkey % 50 + 1) > 2 then 'timeline' when p_size / (p_partkey % 50 + 1) > 1.2 then 'bar' when p_size / (p_partkey % 50 + 1) > 0.8 then 'pie' else 'column' end as chart, case when p_size * (p_partkey % 50 + 1) > 1000 then 'high' when p_size * (p_partkey % 50 + 1) > 300 then 'medium' else 'low' end as density from part")
register("j09_schedule_followup", lambda s, d: R.schedule_followup(pick(view(s, d, "vEmails"), ["id"], {"intent": C.classify_email(B())["intent"], "recommendation": F.element_at(F.array(*map(F.lit, ("PROCEED", "CONSIDER", "WATCH", "PASS"))), (F.col("id") % 4 + 1).cast("int"))}), s.createDataFrame(L.FOLLOW_UPS, "intent string, recommendation string, days int, priority string, action string"), "2024-02-01"), f""", e as (select id, {_EI} as intent, ['PROCEED','CONSIDER','WATCH','PASS'][id % 4 + 1] as recommendation from vEmails), f(intent, recommendation, days, priority, action) as (values {', '.join(f'({q(a)}, {q(b)}, {n}, {q(p)}, {q(t)})' for a, b, n, p, t in L.FOLLOW_UPS)})
    select id, e.intent, e.recommendation, coalesce(action, 'Review and determine next step') as action, coalesce(priority, 'low') as priority, case when coalesce(days, 7) > 0 then strftime(date '2024-02-01' + coalesce(days, 7), '%Y-%m-%d') end as followup_date from e left join f on f.intent = e.intent and f.recommendation = e.recommendation""", ("vEmails",))
