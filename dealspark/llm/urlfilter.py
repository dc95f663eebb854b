"""URL filtering by association rules, with DataFrame and SQL functions only.

Fixed host rules judge first (the longest fitting one wins). Their verdicts are the labels from which Spark's FP-growth
mines combinations of URL tokens; rules pruned by support and confidence judge the other urls through an inverted index
(each rule is filed under its rarest token). Tokens are the scheme, every label of the host by its place from the right,
every directory, the last segment and its ending, every query key, and whether there is a fragment; runs of digits stand
for one another. Tokens under `min_support` are left out before mining, as no rule can hold them. Null urls have empty host
and path and no tokens; a url that no mined rule fits gets `default`. Among mined rules that fit, higher confidence, then more tokens, then higher support, then the
smaller text wins. Mining reads at most about `train_rows` labelled rows, chosen by a hash of id and url. With no labelled
row nothing is mined. Extra columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import materialise, sampled

#: Fixed values: (rule, verdict).
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
ALLOW, BLOCK = "allow", "block"
_MARK = "verdict="


def _after_scheme(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, below = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, whole and of every part."""
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    named = lambda name, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(f"{name}:"), digits(p)))
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "[&;]"), lambda pair: F.regexp_extract(pair, "^([^=]*)", 1))
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda label, nth: F.concat(F.lit("host"), (nth + 1).cast("string"), F.lit(":"), digits(label)))
    one = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.when(last.rlike(r"\.[^.]+$"), F.concat(F.lit("ending:"), F.regexp_extract(last, r"\.([^.]+)$", 1))),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    return F.array_distinct(F.concat(F.array_compact(one), F.when(host != "", labels).otherwise(F.array().cast("array<string>")), named("dir", F.slice(segments, 1, F.size(segments) - 1)), named("leaf", F.array(last)), named("query", keys)))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, train_rows: int = 100_000, basket: int = 10) -> DataFrame:
    """labelled: id, url, tokens, verdict. Returns items, verdict, confidence, support, mined from a bounded sample. Of each
    sampled url the `basket` frequent tokens that tell most about the verdict are mined, as combinations of more would be
    too many; confidence counts one row more for either verdict, so that few rows don't make a rule."""
    share = min(1.0, train_rows / max(1, labelled.count()))
    sample = materialise(labelled.where(sampled(share, "id", "url")).withColumn("row", F.monotonically_increasing_id()).select("row", "tokens", (F.col("verdict") == BLOCK).cast("int").alias("block")))
    rows, blocks = sample.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    base = blocks / max(1, rows)
    told = sample.select("row", "block", F.explode("tokens").alias("token"))
    gain = (F.abs(F.sum("block") / F.count("*") - base) * F.sqrt(F.count("*"))).alias("gain")
    frequent = materialise(told.groupBy("token").agg(F.count("*").alias("n"), gain).where(F.col("n") >= min_support * rows).select("token", "gain"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), "token"))), 1, basket)
    baskets = told.join(frequent, "token").groupBy("row", "block").agg(best.alias("b"))
    verdict = F.concat(F.lit(_MARK), F.when(F.col("block") == 1, BLOCK).otherwise(ALLOW))
    items = materialise(baskets.select(F.concat("b.token", F.array(verdict)).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(1.0, min_confidence)).fit(items)
    said, n = F.element_at("consequent", 1), items.count()
    sure = (F.col("support") * n + 1) / (F.col("support") * n / F.col("confidence") + 2)
    return (
        model.associationRules.where(said.startswith(_MARK))
        .select(F.array_sort("antecedent").alias("items"), F.substring(said, len(_MARK) + 1, 99).alias("verdict"), sure.alias("confidence"), "support")
        .where((F.size("items") > 0) & (F.col("confidence") >= min_confidence))
    )


def judge_urls(pages: DataFrame, id_col: str = "page_id", default: str = ALLOW, **mining) -> DataFrame:
    """Returns id, host, path, rule, verdict, mined_rule (the tokens of the mined rule that judged, else null)."""
    base = pages.select(F.col(id_col), "url")
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "ruled": verdict, "tokens": F.when(F.col("url").isNull(), F.array().cast("array<string>")).otherwise(tokens(F.col("url"), F.col("host"), F.col("path")))})
    labelled = base.where(F.col("rule").isNotNull()).select(F.col(id_col).alias("id"), "url", "tokens", F.col("ruled").alias("verdict"))
    if labelled.isEmpty():
        found = base.select("tokens").where(F.lit(False)).withColumns({"mined_rule": F.lit(""), "mined": F.lit("")})
    else:
        rules = materialise(mine(labelled, **mining))
        rarity = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
        filed = (
            rules.withColumn("text", F.array_join("items", " "))
            .select("*", F.explode("items").alias("token"))
            .join(rarity, "token")
            .groupBy("text", "items", "verdict", "confidence", "support")
            .agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
        )
        open_sets = base.where(F.col("rule").isNull()).select("tokens").distinct()
        hits = open_sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token").where(F.size(F.array_except("items", "tokens")) == 0)
        found = hits.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.size("items")).alias("l"), (-F.col("support")).alias("s"), "text", "verdict")).alias("b")).select("tokens", F.col("b.text").alias("mined_rule"), F.col("b.verdict").alias("mined"))
    # (written first, so that the join reads it by a shuffle of its own and splits frequent token sets)
    joined = base.join(materialise(found), "tokens", "left")
    unruled = F.col("rule").isNull()
    return joined.select(id_col, "host", "path", "rule", F.when(unruled, F.coalesce("mined", F.lit(default))).otherwise(F.col("ruled")).alias("verdict"), F.when(unruled, F.col("mined_rule")).alias("mined_rule"))


def op3(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
