"""Queries on aggregations, filters, joins, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealspark.operators import aggregates as A
from dealspark.operators import relational as R
from dealspark.plans.adapters import view
from dealspark.plans.registry import register, table

AS_OF, ORDERS_AS_OF = "2024-01-20 12:00:00", "2001-06-01 00:00:00"

# aggregations
register("a01_top_companies", lambda s, d: A.top_counts(view(s, d, "vDrafts"), "company", 10), "select company, count(*) as n from vDrafts group by 1 order by n desc, company limit 10", ("vDrafts",))
register("a02_confidence_distribution", lambda s, d: A.distribution(view(s, d, "vDrafts"), "confidence"), "select confidence, count(*) as n from vDrafts group by 1", ("vDrafts",))
register(
    "a03_dashboard_summary",
    lambda s, d: A.dashboard_summary({"drafts": (table(s, d, "orders"), "o_orderdate"), "library": (table(s, d, "lineitem"), "l_shipdate"), "events": (table(s, d, "events"), "ts"), "conversations": (table(s, d, "conversations").select(F.lit(ORDERS_AS_OF).cast("timestamp").alias("ts")), "ts")}, ORDERS_AS_OF, 30),
    f"""select 'drafts' as source, count(*) as total, count(*) filter (where o_orderdate >= timestamp '{ORDERS_AS_OF}' - interval 30 day) as recent from orders
    union all select 'library', count(*), count(*) filter (where l_shipdate >= timestamp '{ORDERS_AS_OF}' - interval 30 day) from lineitem
    union all select 'events', count(*), count(*) filter (where ts >= timestamp '{ORDERS_AS_OF}' - interval 30 day) from events
    union all select 'conversations', count(*), count(*) from conversations""",
)
register(
    "a04_activity_timeline",
    lambda s, d: A.activity_timeline(s, {"drafts": (table(s, d, "orders"), "o_orderdate"), "library": (table(s, d, "lineitem"), "l_shipdate")}, "2001-05-01", 45),
    """with days as (select cast(date '2001-05-01' + cast(i as integer) as date) as day from range(45) t(i)),
    o as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1), l as (select cast(l_shipdate as date) as day, count(*) as n from lineitem group by 1)
    select days.day, coalesce(o.n, 0) as drafts, coalesce(l.n, 0) as library from days left join o on o.day = days.day left join l on l.day = days.day""",
)
register("a05_storage_metrics", lambda s, d: A.storage_metrics(view(s, d, "vLibrary"), "file_size"), "select count(*) as files, cast(sum(file_size) as bigint) as bytes, round(sum(file_size) / 1048576.0, 2) as mb from vLibrary", ("vLibrary",))
register(
    "a06_recent_activity",
    lambda s, d: A.recent_activity(table(s, d, "events"), "ts", AS_OF),
    f"""select count(*) filter (where ts > timestamp '{AS_OF}' - interval 1 hour and ts <= timestamp '{AS_OF}') as last_hour,
    count(*) filter (where ts > timestamp '{AS_OF}' - interval 1 day and ts <= timestamp '{AS_OF}') as last_day from events""",
)
register(
    "a07_deck_stats",
    lambda s, d: A.counts_by(table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"), (F.col("o_custkey") % 8).alias("industry")), ["status", "stage", "industry"]),
    """select 'total' as dim, cast(null as varchar) as value, count(*) as n from orders union all select 'status', o_orderstatus, count(*) from orders group by 2
    union all select 'stage', o_orderpriority, count(*) from orders group by 2 union all select 'industry', cast(o_custkey % 8 as varchar), count(*) from orders group by 2""",
)
register("a09_company_rollup", lambda s, d: A.company_rollup(view(s, d, "vDrafts"), view(s, d, "vLibrary")), """, r as (select company, confidence, status, 'draft' as source, 0 as src, id from vDrafts union all select company, null, null, 'library', 1, id from vLibrary),
    b as (select *, row_number() over (partition by company order by src, id) as rn, count(*) over (partition by company) as interactions from r)
    select company, confidence, status, source, interactions from b where rn = 1""", ("vDrafts", "vLibrary"))
_RATIO = "r as (select company, count(*) as drafts, count(*) filter (where confidence = 'High') as high, count(*) filter (where confidence = 'High') / cast(count(*) as double) as ratio from vDrafts group by 1)"
_BUCKET = "case when ratio < 0.3 then 'high' when ratio < 0.6 then 'medium' else 'low' end"


def ratios(s, d):
    return A.confidence_ratio(view(s, d, "vDrafts"))


register("a10_confidence_ratio", ratios, f", {_RATIO} select * from r", ("vDrafts",))
register("a11_portfolio_risk", lambda s, d: A.portfolio_risk(ratios(s, d)), f", {_RATIO} select {_BUCKET} as bucket, company, ratio, count(*) over (partition by {_BUCKET}) as members from r", ("vDrafts",))
register("a12_total_companies", lambda s, d: A.total_companies(view(s, d, "vDrafts"), view(s, d, "vLibrary")), "select count(distinct company) as companies from (select company from vDrafts union all select company from vLibrary) t", ("vDrafts", "vLibrary"))
register("a13_opportunities", lambda s, d: A.opportunities(ratios(s, d)), f", {_RATIO} select company, ratio, case when ratio > 0.7 then 'increase' else 'monitor' end as action from r where ratio > 0.7 or ratio < 0.3", ("vDrafts",))
register("a14_portfolio_health", lambda s, d: A.portfolio_health(ratios(s, d)), f""", {_RATIO}, c as (select count(*) as total, count(*) filter (where ratio >= 0.6) as low, count(*) filter (where ratio < 0.3) as high from r)
    select total, low, high, round(low * 100.0 / total, 4) as low_pct, case when low * 100.0 / total > 70 then 'Excellent' when low * 100.0 / total > 50 then 'Good' when low * 100.0 / total > 30 then 'Moderate' else 'Poor' end as status,
    case when high > total / 3.0 then 'Reduce exposure to high-risk companies' else 'Keep the current allocation' end as recommendation from c""", ("vDrafts",))
register("a18_tag_clusters", lambda s, d: A.tag_clusters(table(s, d, "events").select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))).alias("tags")), "ts", "tags", 100, 10),
    """with t as (select event_id as id, ts, case when event_id % 7 = 0 then 'general' when event_type < 'u' || cast(user_id % 5 as varchar) then event_type || ',u' || cast(user_id % 5 as varchar) else 'u' || cast(user_id % 5 as varchar) || ',' || event_type end as cluster from events order by ts desc, event_id limit 100)
    select cluster, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as members from t group by 1 order by n desc, cluster limit 10""")
register("a19_memory_stats", lambda s, d: A.memory_stats(table(s, d, "embeddings"), "embedding"), "select count(*) as total, count(embedding) as with_vector, cast(max(len(embedding)) as int) as dims from embeddings")
register("a21_security_dashboard", lambda s, d: A.security_dashboard(table(s, d, "events"), AS_OF), f"""with c as (select count(distinct user_id) filter (where ts > timestamp '{AS_OF}' - interval 8 hour and ts <= timestamp '{AS_OF}') as active_sessions,
    count(*) filter (where d) as events_24h, count(distinct user_id) filter (where d and event_type = 'error') as failed_users,
    count(*) filter (where d and event_type = 'click') as n_click, count(*) filter (where d and event_type = 'error') as n_error, count(*) filter (where d and event_type = 'purchase') as n_purchase, count(*) filter (where d and event_type = 'signup') as n_signup, count(*) filter (where d and event_type = 'view') as n_view
    from (select *, ts > timestamp '{AS_OF}' - interval 1 day and ts <= timestamp '{AS_OF}' as d from events) e)
    select *, cast(100 - case when failed_users > 10 then 30 when failed_users > 5 then 20 when failed_users > 0 then 10 else 0 end - case when events_24h > 1000 then 20 when events_24h > 500 then 10 else 0 end as int) as health from c""")
register("a22_suspicious_users", lambda s, d: A.suspicious_users(table(s, d, "events").select("user_id", "ts", "event_type", F.to_date("ts").alias("session"), (F.col("event_id") % 4).alias("ip")), AS_OF), f"""with p as (select user_id, count(*) filter (where event_type = 'error' and ts > timestamp '{AS_OF}' - interval 1 hour) as failures, count(distinct cast(ts as date)) as sessions, count(distinct event_id % 4) as ips from events where ts <= timestamp '{AS_OF}' group by 1),
    q as (select *, cast(case when failures > 5 then 30 else 0 end + case when sessions > 3 then 20 else 0 end + case when ips > 3 then 25 else 0 end as int) as score from p) select *, case when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end as level from q""")
register("a23_audit_log", lambda s, d: A.audit_log(table(s, d, "events").select("event_id", "ts", "user_id", "event_type"), event_type="error", limit=50), "select event_id, ts, user_id, event_type from events where event_type = 'error' order by ts desc, event_id desc limit 50")
register("a24_user_workspaces", lambda s, d: A.user_workspaces(table(s, d, "customer").select(F.col("c_custkey").alias("workspace_id"), F.col("c_nationkey").alias("creator")), table(s, d, "orders").select(F.col("o_custkey").alias("workspace_id"), (F.col("o_orderkey") % 25).alias("user_id"), F.min("o_orderpriority").over(Window.partitionBy("o_custkey", F.col("o_orderkey") % 25)).alias("permission")).distinct(), 7),
    """with m as (select distinct o_custkey as workspace_id, o_orderkey % 25 as user_id, min(o_orderpriority) over (partition by o_custkey, o_orderkey % 25) as permission from orders), mine as (select * from m where user_id = 7)
    select c_custkey as workspace_id, mine.permission, (select count(*) from m where m.workspace_id = c_custkey) as members, c_nationkey = 7 as is_creator from customer join mine on mine.workspace_id = c_custkey""")

# filters
register("f01_ilike_any", lambda s, d: R.ilike_any(table(s, d, "part"), ["p_name", "p_brand", "p_type"], "BRAND#1").select("p_partkey", "p_name", "p_brand"), "select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1')")
register("f02_apply_filters", lambda s, d: R.apply_filters(view(s, d, "vDrafts"), "created_at", "1998-01-01", "customer#0000001", confidence="High", status="F").select("id", "company", "created_at"), "select id, company, created_at from vDrafts where created_at >= timestamp '1998-01-01' and contains(lower(company), 'customer#0000001') and confidence = 'High' and status = 'F'", ("vDrafts",))
register("f03_company_scope", lambda s, d: R.company_scope(table(s, d, "documents"), "source", "text", "src1").select("doc_id", "source"), "select doc_id, source from documents where contains(source, 'src1') or contains(text, 'src1')")
register("f04_scope_or_all", lambda s, d: R.scope_or_all(table(s, d, "part"), F.col("p_brand") == "no such brand").groupBy("p_brand").agg(F.count("*").alias("n")), "select p_brand, count(*) as n from part where p_brand = 'no such brand' or not exists (select 1 from part where p_brand = 'no such brand') group by 1")
register("f05_recent", lambda s, d: R.recent(table(s, d, "events"), "ts", "7 days", AS_OF).groupBy("event_type").agg(F.count("*").alias("n")), f"select event_type, count(*) as n from events where ts >= timestamp '{AS_OF}' - interval 7 day group by 1")

# joins
register("j01_search_by_context", lambda s, d: R.newest_matches(table(s, d, "orders"), table(s, d, "customer"), F.expr("o_custkey = c_custkey"), F.col("c_mktsegment") == "BUILDING", "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_orderdate", "c_name"), "select o_orderkey, o_orderdate, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' order by o_orderdate desc, o_orderkey limit 20")
register("j03_enrich", lambda s, d: R.enrich(table(s, d, "lineitem"), table(s, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")), "select p_brand, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem left join part on l_partkey = p_partkey group by 1")
_MENTIONS = "select unnest(string_split_regex(lower(query), '[^a-z0-9]+')) as word from vConversations"


def mentions(s, d):
    """j04: words of three letters and more that are used twice or more, wherever they stand in a query, inside words too."""
    talks = view(s, d, "vConversations").select("id", "query")
    words = talks.select(F.explode(F.split(F.lower("query"), "[^a-z0-9]+")).alias("word")).where("length(word) >= 3").groupBy("word").agg(F.count("*").alias("uses")).where("uses >= 2").select("word")
    return R.mention_counts(words, "word", talks, "query")


register("j04_mention_join", mentions, f", w as (select word from ({_MENTIONS}) t where length(word) >= 3 group by word having count(*) >= 2) select word, count(*) as mentions from w join vConversations on contains(lower(query), word) group by word", ("vConversations",))
register("j05_visible_to", lambda s, d: R.visible_to(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("user_id")), 7, "o_custkey"), "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)")


def shared_resources(s, d):
    """j06: what is shared in a workspace, typed, with the sharer and the number of accesses."""
    shares = table(s, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("sharer"), (F.col("c_custkey") % 3).alias("kind"), F.length("c_name").cast("long").alias("accesses"))
    drafts = table(s, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("title"))
    library = table(s, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("title"))
    talks = table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("ref"), F.col("role").alias("title"))
    pick = lambda k, name, right: shares.where(F.col("kind") == k).join(right, "ref").select(F.lit(name).alias("type"), "ref", "title", "sharer", "accesses")
    return pick(0, "draft", drafts).unionByName(pick(1, "library", library)).unionByName(pick(2, "conversation", talks))


register("j06_workspace_resources", shared_resources, """with s as (select c_custkey as ref, c_nationkey as sharer, c_custkey % 3 as kind, cast(length(c_name) as bigint) as accesses from customer)
    select 'draft' as type, ref, o_orderstatus as title, sharer, accesses from s join orders on o_orderkey = ref where kind = 0 union all select 'library', ref, p_name, sharer, accesses from s join part on p_partkey = ref where kind = 1
    union all select 'conversation', ref, role, sharer, accesses from s join conversations on conv_id = ref and turn = 0 where kind = 2""")
_SRC = lambda s, d: table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
_TGT = lambda s, d: table(s, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal")).unionByName(table(s, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")))
register("j07_classify_upserts", lambda s, d: R.classify_upserts(_SRC(s, d), _TGT(s, d), "c_custkey").select("c_custkey", "action"), "select c_custkey, case when c_custkey % 3 <> 0 then 'update' else 'create' end as action from customer")
register("j08_reconcile", lambda s, d: R.reconcile(_SRC(s, d), _TGT(s, d), "c_custkey", ["c_name", "c_acctbal"]), """with t as (select c_custkey, c_name, case when c_custkey % 5 = 0 then 0.0 else c_acctbal end as c_acctbal from customer where c_custkey % 3 <> 0 union all select s_suppkey + 10000000, s_name, s_acctbal from supplier)
    select coalesce(a.c_custkey, t.c_custkey) as c_custkey, case when a.c_custkey is null then 'target' when t.c_custkey is null then 'source' else 'both' end as side,
    case when a.c_custkey is null or t.c_custkey is null then '' when a.c_acctbal is distinct from t.c_acctbal then 'c_acctbal' else '' end as differing from customer a full join t on a.c_custkey = t.c_custkey""")
register("j10_pair_turns", lambda s, d: R.pair_turns(table(s, d, "conversations")), "select conv_id, turn, query, response from vConversations", ("vConversations",))

# windows
register("w01_last_n", lambda s, d: R.last_n(table(s, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "rn"), "select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as rn from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20")
register("w02_trim_log", lambda s, d: R.trim_log(table(s, d, "events").select("event_id", "ts"), "ts", "event_id", 1000, 500), "select event_id, ts from (select event_id, ts, count(*) over () as n, row_number() over (order by ts desc, event_id desc) as rn from events) t where n <= 1000 or rn <= 500")
register("w03_ts_features", lambda s, d: R.ts_features(table(s, d, "events"), "ts", "user_id"), """with c as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2)
    select user_id, day, n, cast(isodow(day) - 1 as int) as dow, cast(month(day) as int) as month, cast(quarter(day) as int) as quarter, cast(dayofyear(day) as int) as doy,
    coalesce(lag(n, 1) over w, 0) as lag_1, coalesce(lag(n, 7) over w, 0) as lag_7 from c window w as (partition by user_id order by day)""")
register("w04_revenue_summary", lambda s, d: R.growth_summary(view(s, d, "vRevenue").withColumn("revenue", F.round("revenue", 2)), "company", "yr", "revenue"), """, r as (select company, yr, round(revenue, 2) as revenue from vRevenue), l as (select *, lag(revenue) over (partition by company order by yr) as previous, row_number() over (partition by company order by yr desc) as rn from r)
    select company, yr, revenue, previous, round((revenue - previous) / previous * 100, 1) as growth_pct, case when previous is null then 'No growth data' when round((revenue - previous) / previous * 100, 1) >= 0 then 'Up since the period before' else 'Down since the period before' end as summary from l where rn = 1""", ("vRevenue",))
register("w05_red_flags", lambda s, d: R.red_flags(view(s, d, "vRevenue"), "company", "yr", "revenue"), """, l as (select company, yr, revenue, lead(revenue) over w as nv, lead(yr) over w as ny from vRevenue window w as (partition by company order by yr)), f as (select company, 'Decline from ' || yr || ' to ' || ny as flag from l where nv < revenue)
    select * from f union all select distinct company, 'No red flags detected' from vRevenue where company not in (select company from f)""", ("vRevenue",))
register("w06_first_by", lambda s, d: R.first_by(table(s, d, "orders").select(F.col("o_custkey"), F.year("o_orderdate").alias("yr"), "o_orderkey", "o_totalprice"), ["o_custkey", "yr"], [F.asc("o_orderkey")]), "select o_custkey, cast(year(o_orderdate) as int) as yr, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderkey) = 1")
register("w07_latest_actual", lambda s, d: R.latest(view(s, d, "vRevenue").withColumn("revenue", F.round("revenue", 2)), "company", "yr", "revenue"), "select company, max(yr) as yr, round(max_by(revenue, yr), 2) as revenue from vRevenue group by company", ("vRevenue",))
_TREND = """t as (select company, case confidence when 'High' then 3 when 'Medium' then 2 else 1 end as v, cast(row_number() over (partition by company order by created_at, id) - 1 as double) as x from vDrafts),
    u as (select company, count(*) as n, round(case when count(*) > 1 then regr_slope(v, x) else 0.0 end, 6) as slope from t group by company)"""
register("w08_confidence_trend", lambda s, d: R.confidence_trend(view(s, d, "vDrafts")), f", {_TREND} select *, case when slope > 0.1 then 'improving' when slope < -0.1 then 'declining' else 'stable' end as trend from u", ("vDrafts",))
register("w09_scale_series", lambda s, d: R.scale_series(view(s, d, "vRevenue").withColumn("revenue", F.round("revenue", 2)), "company", "yr", "revenue"), """, r as (select company, yr, round(revenue, 2) as revenue from vRevenue), m as (select *, min(revenue) over w as lo, max(revenue) over w as hi, count(*) over w as points from r where revenue >= 1000 window w as (partition by company))
    select company, yr, revenue, round((revenue - lo) / case when hi = lo then 1.0 else hi - lo end, 6) as scaled, points from m where points >= 3""", ("vRevenue",))
register("w10_rate_limit", lambda s, d: R.rate_limit_audit(table(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], "ts", 3, 60 * 24).select("event_id", "in_window", "limited"), """select event_id, count(*) over w as in_window, count(*) over w > 3 as limited from (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as e from events) t window w as (partition by user_id order by e range between 86400 preceding and current row)""")

# sorts and sets
register("t01_newest", lambda s, d: R.newest(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50), "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50")
register("t02_global_top_k", lambda s, d: table(s, d, "documents").select("doc_id", F.col("n_chars").alias("score")).orderBy(F.desc("score"), "doc_id").limit(10), "select doc_id, n_chars as score from documents order by score desc, doc_id limit 10")
register("t03_top_k_per_group", lambda s, d: R.top_per_group(table(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 5), "select lang, doc_id, n_chars, cast(row_number() over (partition by lang order by n_chars desc, doc_id) as int) as rank from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) <= 5")
register("t04_top_performers", lambda s, d: ratios(s, d).orderBy(F.desc("ratio"), F.desc("drafts"), "company").limit(5), f", {_RATIO} select * from r order by ratio desc, drafts desc, company limit 5", ("vDrafts",))


def year_order(s, d):
    yr = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Year "), (F.col("o_orderkey") % 20 + 1).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.year("o_orderdate").cast("string")).otherwise(F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")))
    rows = table(s, d, "orders").groupBy(yr.alias("yr")).agg(F.count("*").alias("n"))
    kind, number = R.year_key(F.col("yr"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(kind, number, "yr")))  # a few dozen distinct keys


register("t05_year_order", year_order, """with y as (select case o_orderkey % 3 when 0 then 'Year ' || cast(o_orderkey % 20 + 1 as varchar) when 1 then cast(year(o_orderdate) as varchar) else 'FY' || cast(year(o_orderdate) as varchar) end as yr from orders), c as (select yr, count(*) as n from y group by 1)
    select yr, n, cast(row_number() over (order by case when yr like 'Year %' then 0 when yr like 'FY%' then 2 else 1 end, case when yr like 'Year %' then cast(substr(yr, 6) as int) when yr not like 'FY%' then cast(yr as int) end, yr) as int) as position from c""")
register("t06_suggestions", lambda s, d: R.ilike_any(table(s, d, "customer").select(F.col("c_name").alias("name")), ["name"], "#00000001").unionByName(R.ilike_any(table(s, d, "part").select(F.col("p_name").alias("name")), ["name"], "#00000001")).distinct().orderBy("name").limit(10), "select distinct name from (select c_name as name from customer union all select p_name from part) t where contains(lower(name), '#00000001') order by name limit 10")


def typed_union(s, d):
    """u01: hits of three tables in one shape."""
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.lit("draft").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("at"))
    p = table(s, d, "part").where("p_size = 10").select(F.lit("library").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    c = table(s, d, "conversations").where("turn = 1").select(F.lit("conversation").alias("type"), F.col("conv_id").alias("id"), F.col("role").alias("title"))
    return o.unionByName(p, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


register("u01_typed_union", typed_union, "select 'draft' as type, o_orderkey as id, o_orderpriority as title, o_orderdate as at from orders where o_orderstatus = 'P' union all select 'library', p_partkey, p_name, null from part where p_size = 10 union all select 'conversation', conv_id, role, null from conversations where turn = 1")
register("u02_distinct_union", lambda s, d: table(s, d, "part").select(F.col("p_brand").alias("name")).union(table(s, d, "part").select("p_type")).distinct(), "select p_brand as name from part union select p_type from part")
def halves(s, d):
    """u03: the words of the first and of the second half of every text, as sets."""
    words, n = F.split(F.lower("text"), " "), F.size(F.split(F.lower("text"), " "))
    half = F.ceil(n / 2).cast("int")
    a, b = F.array_distinct(F.slice(words, 1, half)), F.array_distinct(F.slice(words, half + 1, F.greatest(n - half, F.lit(0))))
    return table(s, d, "documents").select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", *[c.alias(name) for name, c in R.set_overlap(F.col("a"), F.col("b")).items()])


register("u03_set_overlap", halves, """with w as (select doc_id, string_split(lower(text), ' ') as w from documents), h as (select doc_id, w, cast(ceil(len(w) / 2.0) as int) as h from w), s as (select doc_id, list_distinct(w[1:h]) as a, list_distinct(w[h + 1:]) as b from h),
    n as (select doc_id, cast(len(list_intersect(a, b)) as int) as n_both, cast(len(list_distinct(list_concat(a, b))) as int) as n_any from s)
    select doc_id, n_both, n_any, round(case when n_any > 0 then n_both / cast(n_any as double) else 0.0 end, 6) as jaccard from n""")
register("u04_unseen", lambda s, d: R.unseen(table(s, d, "part").select("p_partkey"), table(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey"), "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
