"""Filters, joins, windows, sorts and set operations (f*, j*, w*, t*, u*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ilike_any(df: DataFrame, cols: list[str], q: str) -> DataFrame:
    """f01: q in any of the columns, without regard to case."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(q.lower()) for c in cols]))


def apply_filters(df: DataFrame, ts: str, date_from: str | None = None, company: str | None = None, **equal) -> DataFrame:
    """f02: the filters that are given, all of them."""
    if date_from is not None:
        df = df.where(F.col(ts) >= F.lit(date_from).cast("timestamp"))
    if company is not None:
        df = df.where(F.lower("company").contains(company.lower()))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def company_scope(df: DataFrame, symbol: str, text: str, company: str) -> DataFrame:
    """f03."""
    return df.where(F.col(symbol).contains(company) | F.col(text).contains(company))


def scope_or_all(df: DataFrame, pred: Column) -> DataFrame:
    """f04: the rows that match, or all if none does. One row tells, so nothing but it is broadcast."""
    some = df.agg(F.coalesce(F.bool_or(pred), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some)).where(~F.col("_some") | F.coalesce(pred, F.lit(False))).drop("_some")


def recent(df: DataFrame, ts: str, interval: str, as_of: str) -> DataFrame:
    """f05."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {interval}"))


def newest_matches(left: DataFrame, right: DataFrame, on: Column, cond: Column, ts: str, tie: str, k: int) -> DataFrame:
    """j01: inner join, filter on the right side, newest k."""
    return left.join(right, on).where(cond).orderBy(F.desc(ts), tie).limit(k)


def enrich(hits: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """j03: one left join in place of a lookup per hit."""
    return hits.join(dim, on, "left")


#: Length of the grams that names are looked up by; shorter names are their own grams.
GRAM = 4
#: Up to so many names are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_NAMES = 100_000


def grams(text: Column, size: int) -> Column:
    """All distinct runs of `size` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


#: Up to so many different characters of names, texts are cut at all others.
LETTERS = 4096


def _mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Of every different text (_low) with a mention: _key, its hash, and _names, all names (_name) in it, each once. Texts are cut at the characters
    that no name has, as no mention crosses them. Every name is filed under the gram of it that the fewest of the different pieces have; only
    the pieces with that gram are verified, so no name is held against every piece, and no text is copied by its grams."""
    size = F.least(F.length("_name"), F.lit(GRAM))
    n = names.count()
    share = F.broadcast if n <= BROADCAST_NAMES else lambda df: df
    parts = names.select("_name").distinct().select("_name", F.explode(F.when(size == GRAM, grams(F.col("_name"), GRAM)).otherwise(F.array("_name"))).alias("_gram"))
    sizes = [r[0] for r in names.select(size).distinct().collect()]  # at most GRAM numbers
    letters = [r[0] for r in names.select(F.explode(F.array_distinct(F.split("_name", "")))).distinct().limit(LETTERS + 1).collect()]
    if not letters:
        return texts.select(F.lit(None).cast("binary").alias("_key"), F.lit(None).cast("array<string>").alias("_names")).limit(0)
    cut = F.split("_low", "[^" + "".join(rf"\x{{{ord(c):x}}}" for c in letters if c) + "]+") if len(letters) <= LETTERS else F.array("_low")
    pieces = texts.select(F.unhex(F.md5("_low")).alias("_key"), F.explode(F.array_distinct(F.array_remove(cut, ""))).alias("_piece"))
    by_gram = pieces.select("_piece").distinct().withColumn("_gram", F.explode(F.flatten(F.array(*[grams(F.col("_piece"), s) for s in sorted(sizes)]))))
    wanted = share(parts.select("_gram").distinct())
    uses = by_gram.select("_gram").join(wanted, "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_uses"))
    filed = parts.join(share(uses), "_gram", "left").groupBy("_name").agg(F.min_by("_gram", F.struct(F.coalesce("_uses", F.lit(0)), "_gram")).alias("_gram"))
    found = by_gram.join(share(filed), "_gram").where(F.contains("_piece", "_name")).groupBy("_piece").agg(F.collect_set("_name").alias("_names"))
    return pieces.join(found, "_piece").groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("_names"))).alias("_names"))


def _keyed_texts(names: DataFrame, name: str, texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    return names.where(F.length(name) > 0).withColumn("_name", F.lower(name)), texts.withColumn("_low", F.lower(text)).where("_low is not null")


def mention_join(names: DataFrame, name: str, texts: DataFrame, text: str) -> DataFrame:
    """j04: texts that contain a name, anywhere and without regard to case. Empty and null names are in no text; repeated names and texts pair each."""
    keyed, low = _keyed_texts(names, name, texts, text)
    pairs = low.withColumn("_key", F.unhex(F.md5("_low"))).join(_mentions(keyed, low), "_key").withColumn("_name", F.explode("_names"))
    return pairs.join(keyed, "_name").select(*names.columns, *texts.columns)


def mention_counts(names: DataFrame, name: str, texts: DataFrame, text: str) -> DataFrame:
    """j04: of each row of names the number of texts that contain it, where there are any; texts are counted where their names are found."""
    keyed, low = _keyed_texts(names, name, texts, text)
    times = low.groupBy(F.unhex(F.md5("_low")).alias("_key")).agg(F.count("*").alias("_times"))
    counts = _mentions(keyed, low).join(times, "_key").select("_times", F.explode("_names").alias("_name")).groupBy("_name").agg(F.sum("_times").alias("mentions"))
    return keyed.join(counts, "_name").select(*names.columns, "mentions")


def visible_to(resources: DataFrame, members: DataFrame, user: int, key: str) -> DataFrame:
    """j05."""
    return resources.join(members.where(F.col("user_id") == user).select(key), key, "left_semi")


def classify_upserts(src: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """j07: update where the key exists in the target, else create."""
    known = target.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    return src.join(known, key, "left").withColumn("action", F.when(F.col("_known"), "update").otherwise("create")).drop("_known")


def reconcile(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """j08: side (both, source or target) and the names of the columns that differ."""
    x = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    y = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    both = x.join(y, key, "full")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "source").otherwise("target")
    differing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in cols])), ",")
    return both.select(key, side.alias("side"), F.when(side == "both", differing).otherwise("").alias("differing"))


def schedule_followup(df: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """j09: (intent, recommendation) decides days, priority and action; others get 7 days, low."""
    j = df.join(F.broadcast(rules), ["intent", "recommendation"], "left")
    days = F.coalesce("days", F.lit(7))
    return j.select(
        *df.columns,
        F.coalesce("action", F.lit("Review and determine next step")).alias("action"),
        F.coalesce("priority", F.lit("low")).alias("priority"),
        F.when(days > 0, F.date_format(F.date_add(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")).alias("followup_date"),
    )


def pair_turns(df: DataFrame) -> DataFrame:
    """j10: user turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return df.select("conv_id", "turn", "role", F.col("text").alias("query"), F.lead("text").over(w).alias("response"), F.lead("role").over(w).alias("next_role")).where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "query", "response")


def last_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """w01: the newest n rows of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= n)


def trim_log(df: DataFrame, ts: str, tie: str, over: int = 10_000, keep: int = 5_000) -> DataFrame:
    """w02: of more than `over` rows the newest `keep` stay. The cut is found on the two order columns alone, as a
    distributed top-k, and applied as a filter."""
    size = df.agg(F.count("*").alias("_n"))
    cut = df.select(F.struct(F.col(ts).alias("t"), F.col(tie).alias("k")).alias("o")).orderBy(F.desc("o")).limit(keep).agg(F.min("o").alias("_cut"))
    return df.join(F.broadcast(size.join(cut))).where((F.col("_n") <= over) | (F.struct(F.col(ts).alias("t"), F.col(tie).alias("k")) >= F.col("_cut"))).drop("_n", "_cut")


def ts_features(df: DataFrame, ts: str, key: str) -> DataFrame:
    """w03: calendar features and running counts per day, lagged by 1 and 7 days, per entity."""
    days = df.groupBy(F.col(key), F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("day")
    lag = lambda k: F.coalesce(F.lag("n", k).over(w), F.lit(0))
    return days.select(key, "day", "n", F.weekday("day").alias("dow"), F.month("day").alias("month"), F.quarter("day").alias("quarter"), F.dayofyear("day").alias("doy"), lag(1).alias("lag_1"), lag(7).alias("lag_7"))


def growth_summary(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """w04: last value, the one before it, growth in percent and a sentence."""
    w = Window.partitionBy(key).orderBy(order)
    lagged = points.select(key, order, value, F.lag(value).over(w).alias("previous"))
    last = lagged.groupBy(key).agg(F.max_by(F.struct(F.col(order), F.col(value), F.col("previous")), order).alias("l"))
    growth = F.round((F.col(f"l.{value}") - F.col("l.previous")) / F.col("l.previous") * 100, 1)
    text = F.when(F.col("l.previous").isNull(), "No growth data").when(growth >= 0, F.lit("Up since the period before")).otherwise("Down since the period before")
    return last.select(key, F.col(f"l.{order}").alias(order), F.col(f"l.{value}").alias(value), F.col("l.previous").alias("previous"), F.when(F.col("l.previous").isNotNull(), growth).alias("growth_pct"), text.alias("summary"))


def growth_series(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """x35: growth in percent of every period on the one before, with its display form."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    rows = points.select(key, order, (F.round((F.col(value) - before) / before * 100, 1) + 0.0).alias("growth_pct")).where("growth_pct is not null")
    return rows.withColumn("display", F.format_string("%.1f%%", "growth_pct"))


def market_comparison(df: DataFrame, key: str, group: str, value: str, peers: int = 4) -> DataFrame:
    """x35: every row with a value beside the largest others of its group, at most `peers`; itself is highlighted."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(key, group, value)
    # the largest of each task first, so that no group is sorted whole
    one = F.struct((-F.col(value)).alias("down"), F.col(key).alias("peer"), F.col(value).alias("size"))
    part = known.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    top = top_per_group(part, [group, "_part"], [F.desc(value), F.asc(key)], peers + 1)
    best = top.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(one)), 1, peers + 1).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["peer"] != F.col(key)), 1, peers)
    self = F.struct(F.lit(None).cast("double").alias("down"), F.col(key).alias("peer"), F.col(value).alias("size"))
    rows = known.join(best, group).select(key, F.explode(F.concat(F.array(self), others)).alias("b"))
    return rows.select(key, F.col("b.peer").alias("peer"), F.col("b.size").alias(value), (F.col("b.peer") == F.col(key)).alias("highlight"))


def red_flags(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """w05: declines between consecutive points; a key without any gets one row that says so."""
    w = Window.partitionBy(key).orderBy(order)
    step = points.select(key, F.col(order).alias("period"), F.col(value).alias("v"), F.lead(value).over(w).alias("next_v"), F.lead(order).over(w).alias("next_period"))
    flags = step.where("next_v < v").select(key, F.concat(F.lit("Decline from "), F.col("period"), F.lit(" to "), F.col("next_period")).alias("flag"))
    none = points.select(key).distinct().join(flags.select(key).distinct(), key, "left_anti").select(key, F.lit("No red flags detected").alias("flag"))
    return flags.unionByName(none)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """w06: the first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """w07."""
    return points.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def slope_over_sequence(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Slope of a value over the position in its key's order, with the number of rows."""
    pos = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("double")
    return df.select(key, value.cast("double").alias("v"), pos.alias("x")).groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("v", "x").alias("slope"))


def confidence_trend(df: DataFrame) -> DataFrame:
    """w08: slope of the confidence rank; above .1 improving, below -.1 declining."""
    rank = F.when(F.col("confidence") == "High", 3).when(F.col("confidence") == "Medium", 2).otherwise(1)
    slope = F.round(F.coalesce("slope", F.lit(0.0)), 6)
    return slope_over_sequence(df, "company", ["created_at", "id"], rank).select("company", "n", slope.alias("slope"), F.when(slope > 0.1, "improving").when(slope < -0.1, "declining").otherwise("stable").alias("trend"))


def scale_series(points: DataFrame, key: str, order: str, value: str, least_points: int = 3, least_value: float = 1000) -> DataFrame:
    """w09: min-max scaling of series with enough points of enough size; a flat series scales to 0 (range 1)."""
    w = Window.partitionBy(key)
    span = F.max(value).over(w) - F.min(value).over(w)
    scaled = F.round((F.col(value) - F.min(value).over(w)) / F.when(span == 0, 1.0).otherwise(span), 6)
    return points.where(F.col(value) >= least_value).select(key, order, value, scaled.alias("scaled"), F.count("*").over(w).alias("points")).where(F.col("points") >= least_points)


def rate_limit_audit(df: DataFrame, keys: list[str], ts: str, limit: int, minutes: int) -> DataFrame:
    """w10: requests of the trailing window at each event, and whether they pass the limit."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("timestamp").cast("double").cast("long")).rangeBetween(-minutes * 60, 0)
    return df.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > limit)


def newest(df: DataFrame, ts: str, tie: str, k: int) -> DataFrame:
    """t01."""
    return df.orderBy(F.desc(ts), tie).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """t03: best k of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def year_key(col: Column) -> tuple[Column, Column]:
    """t05: 'Year N' first by N, then four-digit years, then the rest by text."""
    n = F.regexp_extract(col, r"^Year ([0-9]+)$", 1)
    kind = F.when(n != "", 0).when(col.rlike("^[0-9]{4}$"), 1).otherwise(2)
    return kind, F.when(kind == 0, n.try_cast("int")).when(kind == 1, col.try_cast("int"))


def set_overlap(a: Column, b: Column) -> dict[str, Column]:
    """u03: sizes of intersection and union, and Jaccard similarity."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {"n_both": both, "n_any": any_, "jaccard": F.round(F.when(any_ > 0, both / any_).otherwise(0.0), 6)}


def unseen(current: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """u04."""
    return current.join(seen.select(key), key, "left_anti")
