"""Dashboards, portfolio and audit aggregations (a01-a27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL_RANK = {"High": 3, "Medium": 2, "Low": 1}


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """a01: the k most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """a02."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def dashboard_summary(tables: dict[str, tuple[DataFrame, str]], as_of: str, days: int) -> DataFrame:
    """a03: total and recent rows of each (table, time column), one row and one scan per table."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    rows = [df.agg(F.count("*").alias("total"), count_if(F.col(ts) >= since).alias("recent")).select(F.lit(name).alias("source"), "total", "recent") for name, (df, ts) in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def activity_timeline(spark, tables: dict[str, tuple[DataFrame, str]], start: str, days: int) -> DataFrame:
    """a04: rows per day and source, zero-filled; each table is scanned once, for the days asked for."""
    spine = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    first, last = F.lit(start).cast("timestamp"), F.lit(start).cast("timestamp") + F.expr(f"interval {days} days")
    per = [df.where((F.col(ts) >= first) & (F.col(ts) < last)).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias(name)) for name, (df, ts) in tables.items()]
    out = reduce(lambda a, b: a.join(b, "day", "left"), per, spine)
    return out.select("day", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in tables])


def storage_metrics(df: DataFrame, size: str) -> DataFrame:
    """a05."""
    return df.agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.round(F.sum(size) / 1048576, 2).alias("mb"))


def recent_activity(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """a06: rows of the last hour and day."""
    t = F.lit(as_of).cast("timestamp")
    inside = lambda by: (F.col(ts) > t - F.expr(by)) & (F.col(ts) <= t)
    return df.agg(count_if(inside("interval 1 hour")).alias("last_hour"), count_if(inside("interval 1 day")).alias("last_day"))


def counts_by(df: DataFrame, dims: list[str]) -> DataFrame:
    """a07: the total and the counts by each dimension, in one pass (as grouping sets do)."""
    named = F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select(named.alias("g")).groupBy("g.dim", "g.value").agg(F.count("*").alias("n"))


def company_rollup(drafts: DataFrame, library: DataFrame) -> DataFrame:
    """a09: the first draft's confidence and status, else the first file's; interactions over both."""
    rows = drafts.select("company", "confidence", "status", F.lit("draft").alias("source"), F.lit(0).alias("src"), "id").unionByName(library.select("company", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("status"), F.lit("library").alias("source"), F.lit(1).alias("src"), "id"))
    best = F.min(F.struct("src", "id", "confidence", "status", "source"))
    return rows.groupBy("company").agg(best.alias("b"), F.count("*").alias("interactions")).select("company", "b.confidence", "b.status", "b.source", "interactions")


def confidence_ratio(drafts: DataFrame) -> DataFrame:
    """a10."""
    return drafts.groupBy("company").agg(F.count("*").alias("drafts"), count_if(F.col("confidence") == "High").alias("high")).withColumn("ratio", F.col("high") / F.col("drafts"))


def risk_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.3, "high").when(ratio < 0.6, "medium").otherwise("low")


def portfolio_risk(ratios: DataFrame) -> DataFrame:
    """a11: companies of each bucket. One row per company and its bucket's size, so that no list grows with the input."""
    rated = ratios.withColumn("bucket", risk_bucket(F.col("ratio")))
    sizes = rated.groupBy("bucket").agg(F.count("*").alias("members"))
    return rated.join(F.broadcast(sizes), "bucket").select("bucket", "company", "ratio", "members")


def total_companies(*frames: DataFrame, approximate: bool = False) -> DataFrame:
    """a12."""
    names = reduce(DataFrame.unionByName, [f.select("company") for f in frames])
    return names.agg((F.approx_count_distinct if approximate else F.count_distinct)("company").alias("companies"))


def opportunities(ratios: DataFrame) -> DataFrame:
    """a13."""
    ratio = F.col("ratio")
    kind = F.when(ratio > 0.7, "increase").when(ratio < 0.3, "monitor")
    return ratios.select("company", "ratio", kind.alias("action")).where("action is not null")


def portfolio_health(ratios: DataFrame) -> DataFrame:
    """a14."""
    share = F.col("low") * 100.0 / F.col("total")
    status = F.when(share > 70, "Excellent").when(share > 50, "Good").when(share > 30, "Moderate").otherwise("Poor")
    advice = F.when(F.col("high") > F.col("total") / 3, "Reduce exposure to high-risk companies").otherwise("Keep the current allocation")
    counted = ratios.agg(F.count("*").alias("total"), count_if(F.col("ratio") >= 0.6).alias("low"), count_if(F.col("ratio") < 0.3).alias("high"))
    return counted.where("total > 0").select("total", "low", "high", F.round(share, 4).alias("low_pct"), status.alias("status"), advice.alias("recommendation"))


def visual_summary(pages: DataFrame, key: str, pos: str, text: str, terms: list[str], advice: list[str]) -> DataFrame:
    """a25: per document of recognised pages the figures that stand for charts, the distinct terms, the pages' text in order
    and advice by thresholds. Counts are added up before the shuffle; the text alone is gathered, as long as the document."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.contains(t), t) for t in terms]))
    rows = pages.select(key, F.regexp_count(text, F.lit("[0-9]{2,}")).alias("charts"), found.alias("terms"), F.struct(pos, text).alias("page"))
    whole = rows.groupBy(key).agg(F.sum("charts").alias("charts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"), F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p[text]), "\n").alias("text"))
    n, c = F.size("terms"), F.col("charts")
    said = F.array_compact(F.array(F.when(n > 10, advice[0]).when(n < 3, advice[1]), F.when(c > 5, advice[2]).when(c == 0, advice[3])))
    return whole.select(key, "charts", F.array_join("terms", ",").alias("terms"), "text", F.array_join(said, "; ").alias("advice"))


def tag_clusters(df: DataFrame, ts: str, tags: str, newest: int, n: int) -> DataFrame:
    """a18: the newest rows clustered by their first two tags in order; the n largest clusters."""
    key = F.when(F.size(tags) == 0, F.array(F.lit("general"))).otherwise(F.array_sort(F.slice(tags, 1, 2)))
    top = df.orderBy(F.desc(ts), "id").limit(newest).select("id", F.array_join(key, ",").alias("cluster"))
    return top.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members")).orderBy(F.desc("n"), "cluster").limit(n)


def memory_stats(df: DataFrame, vector: str) -> DataFrame:
    """a19."""
    return df.agg(F.count("*").alias("total"), count_if(F.col(vector).isNotNull()).alias("with_vector"), F.max(F.size(vector)).alias("dims"))


def security_dashboard(events: DataFrame, as_of: str, session_hours: int = 8) -> DataFrame:
    """a21: active sessions, events of the last day, users with failures, and a health score of 100 less steps."""
    t = F.lit(as_of).cast("timestamp")
    day = (F.col("ts") > t - F.expr("interval 1 day")) & (F.col("ts") <= t)
    active = (F.col("ts") > t - F.expr(f"interval {session_hours} hours")) & (F.col("ts") <= t)
    counted = events.agg(
        F.count_distinct(F.when(active, F.col("user_id"))).alias("active_sessions"),
        count_if(day).alias("events_24h"),
        F.count_distinct(F.when(day & (F.col("event_type") == "error"), F.col("user_id"))).alias("failed_users"),
        *[count_if(day & (F.col("event_type") == k)).alias(f"n_{k}") for k in ("click", "error", "purchase", "signup", "view")],
    )
    health = 100 - F.when(F.col("failed_users") > 10, 30).when(F.col("failed_users") > 5, 20).when(F.col("failed_users") > 0, 10).otherwise(0) - F.when(F.col("events_24h") > 1000, 20).when(F.col("events_24h") > 500, 10).otherwise(0)
    return counted.withColumn("health", health)


def suspicious_users(events: DataFrame, as_of: str) -> DataFrame:
    """a22: score by failures of an hour (> 5: 30), sessions (> 3: 20) and addresses (> 3: 25); levels at 50 and 25."""
    t = F.lit(as_of).cast("timestamp")
    failed = (F.col("event_type") == "error") & (F.col("ts") > t - F.expr("interval 1 hour")) & (F.col("ts") <= t)
    per = events.where(F.col("ts") <= t).groupBy("user_id").agg(count_if(failed).alias("failures"), F.count_distinct("session").alias("sessions"), F.count_distinct("ip").alias("ips"))
    score = F.when(F.col("failures") > 5, 30).otherwise(0) + F.when(F.col("sessions") > 3, 20).otherwise(0) + F.when(F.col("ips") > 3, 25).otherwise(0)
    return per.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def audit_log(events: DataFrame, user_id: int | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """a23: newest first."""
    for name, value in (("user_id", user_id), ("event_type", event_type)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def user_workspaces(workspaces: DataFrame, members: DataFrame, user: int) -> DataFrame:
    """a24: the workspaces of a user with member counts, their permission, and whether they made it."""
    mine = members.where(F.col("user_id") == user).select("workspace_id", "permission")
    sizes = members.join(mine.select("workspace_id"), "workspace_id", "left_semi").groupBy("workspace_id").agg(F.count("*").alias("members"))
    return workspaces.join(mine, "workspace_id").join(sizes, "workspace_id").select("workspace_id", "permission", "members", (F.col("creator") == user).alias("is_creator"))


def mean_of_positive(cols: list[Column]) -> Column:
    """a27: mean of the values above zero, 0 if there are none."""
    some = F.filter(F.array(*cols), lambda x: x > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)).otherwise(F.lit(0.0)).cast(T.DoubleType())


def reply_stats(mails: DataFrame, dims: list[str], received: str, processed: str) -> DataFrame:
    """a08: mails, processed ones, and mean and median minutes from receipt to processing, in total and by each value of the
    dimensions, in one pass. A mail that lacks a time counts as not processed; a time before the receipt counts as it is."""
    seconds = F.unix_timestamp(processed) - F.unix_timestamp(received)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), v.alias("value")) for n, v in [("total", F.lit("")), *[(n, F.col(n).cast("string")) for n in dims]]]))
    rows = mails.select(each.alias("g"), seconds.alias("seconds"))
    return rows.groupBy("g.dim", "g.value").agg(F.count("*").alias("n"), F.count("seconds").alias("processed"), F.round(F.sum("seconds") / 60 / F.count("seconds"), 4).alias("mean_minutes"), (F.percentile("seconds", 0.5) / 60).alias("median_minutes"))
