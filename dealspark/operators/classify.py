"""Lexicon classification (c00-c12) and metric extraction (e01-e21), as unrolled expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.functions import lexicons as L
from dealspark.functions import text as X

#: Rows of a lexicon up to which it is broadcast (some 20 MB).
LEXICON_ROWS = 200_000
TITLE_LINE = "^[A-Z][A-Za-z0-9&.]*(?:[ \\t]+[A-Za-z0-9&.]+){0,3}$"


def score_lexicon(df: DataFrame, text: str, key: str, lexicon: DataFrame) -> DataFrame:
    """c00 for long lexicons: words of the texts meet the terms (category, term, weight) in an equi-join. Returns key,
    category, hits (distinct terms), occurrences and weighted score. A lexicon of up to LEXICON_ROWS is broadcast before the words are
    counted; a longer one meets them in a shuffle. The words are never broadcast, however small their file lets Spark guess them."""
    words = df.select(key, F.explode_outer(X.letter_runs(F.col(text))).alias("term")).where("term is not null")
    if lexicon.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS:
        lexicon = F.broadcast(lexicon)
        words = words.join(F.broadcast(lexicon.select("term").distinct()), "term", "left_semi")
    else:
        lexicon = lexicon.hint("merge")
    counted = words.groupBy(key, "term").agg(F.count("*").alias("n"))
    return counted.join(lexicon, "term").groupBy(key, "category").agg(F.count("*").alias("hits"), F.sum("n").alias("occurrences"), F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("score"))


def sentiment(text: Column) -> dict[str, Column]:
    """c01. Texts are lower-cased once; only the terms that occur in them are counted, without overlap."""
    weighted = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in {**L.POSITIVE, **L.NEGATIVE}.items()])
    times = lambda low, x: ((F.length(low) - F.length(F.replace(low, x["term"], F.lit("")))) / F.length(x["term"])).cast("int")
    found = X.let(F.lower(text), lambda low: F.transform(F.filter(weighted, lambda x: low.contains(x["term"])), lambda x: times(low, x) * x["weight"]))
    words = F.size(X.blank_split(F.coalesce(text, F.lit(""))))
    net = F.aggregate(found, F.lit(0.0), lambda total, x: total + x)
    score = F.when(words > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net / (words * 0.1)))).otherwise(0.0)
    score = F.round(F.coalesce(score, F.lit(0.0)), 3)
    terms = lambda lexicon: F.array_join(X.let(F.lower(text), lambda low: X.present(low, list(lexicon))), ",")
    return {
        "score": score,
        "sentiment": X.let(score, lambda s: F.when(s > 0.3, "positive").when(s < -0.3, "negative").otherwise("neutral")),
        "confidence": F.round(F.least(F.lit(1.0), F.size(found) / F.greatest(words * 0.05, F.lit(1.0))), 3),
        "positive": terms(L.POSITIVE),
        "negative": terms(L.NEGATIVE),
        "words": words,
    }


def risk_score(text: Column) -> Column:
    """c02."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = F.array(*[F.regexp_count(low, F.lit(p)) for _, p, _ in L.RISKS])
    weights = [(s, L.RISK_WEIGHTS[level]) for level, _, s in L.RISKS]

    def share(n: Column) -> Column:
        total = reduce(lambda a, b: a + b, [n[i] * (s * w) for i, (s, w) in enumerate(weights)])
        weight = reduce(lambda a, b: a + b, [n[i] * w for i, (_, w) in enumerate(weights)])
        return F.round(F.when(weight > 0, F.least(F.lit(1.0), total / weight)).otherwise(0.0), 6)

    return X.let(counts, share)


def risk_indicators(df: DataFrame, key: str, text: str) -> DataFrame:
    """c02: a row per indicator with its surroundings."""
    low = F.lower(text)
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(s).alias("score"), F.regexp_extract_all(low, F.lit(f"({p})"), 1).alias("found")) for level, p, s in L.RISKS])
    rows = df.select(key, low.alias("low"), F.explode(each).alias("r")).select(key, "low", "r.level", "r.score", F.explode("r.found").alias("indicator"))
    # from 50 characters before the first occurrence to 50 after it
    return rows.select(key, "level", "score", "indicator", F.trim(F.expr("substring(low, greatest(1, locate(indicator, low) - 50), locate(indicator, low) + length(indicator) + 50 - greatest(1, locate(indicator, low) - 50))")).alias("context"))


def padded(text: Column) -> Column:
    """Lower-cased words between single blanks, for whole-word tests; apostrophes stay."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}']+", " ")), F.lit(" "))


def email_intent(text: Column) -> dict[str, Column]:
    """c04. The text is brought to single words once for all terms."""
    whole = lambda t, terms: F.transform(X.present(t, [f" {k} " for k in terms]), lambda k: F.trim(k))
    found = X.let(padded(text), lambda t: F.struct(whole(t, L.INTERESTED).alias("yes"), whole(t, L.NOT_INTERESTED).alias("no"), whole(t, L.PENDING).alias("maybe")))

    def pick(rejected, interested, open_) -> Column:
        def one(f: Column) -> Column:
            yes, no = F.size(f["yes"]) * 2, F.size(f["no"]) * 3
            return F.when((no > yes) & (no > 0), rejected(f)).when(yes > 0, interested(f)).otherwise(open_(f))

        return X.let(found, one)

    confidence = pick(lambda f: F.size(f["no"]) * 3 / 3, lambda f: F.size(f["yes"]) * 2 / 4, lambda f: F.size(f["maybe"]) / 2)
    return {
        "intent": pick(lambda _: F.lit("not_interested"), lambda _: F.lit("interested"), lambda _: F.lit("pending")),
        "confidence": F.round(F.least(F.lit(1.0), confidence), 2),
        "keywords": F.array_join(pick(lambda f: f["no"], lambda f: f["yes"], lambda f: f["maybe"]), ","),
    }


def sender_type(text: Column) -> Column:
    """c05."""
    a, b = X.hits(text, L.INVESTOR), X.hits(text, L.CLIENT)
    return F.when(a > b, "investor").when(b > a, "client").otherwise("unknown")


def blend(model_label: Column, model_conf: Column, word_label: Column, word_conf: Column) -> dict[str, Column]:
    """c06: above .7 the model; above .4 both if they agree, else the keywords; else the keywords; none: keywords only."""
    label = F.when(model_label.isNull(), word_label).when(model_conf > 0.7, model_label).otherwise(word_label)
    conf = F.when(model_label.isNull(), word_conf).when(model_conf > 0.7, model_conf).when((model_conf > 0.4) & (model_label == word_label), (model_conf + word_conf) / 2).otherwise(word_conf)
    how = F.when(model_label.isNull(), "keyword_only").when(model_conf > 0.7, "model").when((model_conf > 0.4) & (model_label == word_label), "model+keyword").otherwise("keyword")
    return {"label": label, "confidence": F.round(conf, 4), "method": how}


def classify_email(text: Column) -> dict[str, Column]:
    """c07."""
    intent = X.argmax_class(text, L.EMAIL_INTENTS, "other")
    most = F.greatest(*[X.hits(text, t) for _, t in L.EMAIL_INTENTS])
    return {
        "intent": intent,
        "confidence": F.round(F.least(most / 3, F.lit(1.0)), 6),
        "needs_context": intent.isin("interested", "due_diligence", "question"),
        "sender": F.coalesce(X.first_class(text, L.EMAIL_SENDERS), F.lit("unknown")),
        "urgency": F.when(intent.isin("due_diligence", "interested"), "high").otherwise("medium"),
        "topics": F.array_join(X.keep([(X.hits(text, t) > 0, n) for n, t in L.EMAIL_INTENTS]), ","),
        "company": F.nullif(F.regexp_extract(text, L.MAIL_COMPANY, 1), F.lit("")),
    }


def _context_pattern(p: str) -> str:
    return rf"\b({p})\b"


def detect_context(text: Column, key_decision: Column | None = None, faq: Column | None = None) -> dict[str, Column]:
    """c08: type by the most pattern groups, topics, sentiment by majority, importance; the two flags of a record's metadata
    add to its importance."""
    low = F.lower(text)
    counts = [(n, reduce(lambda a, b: a + b, [low.rlike(_context_pattern(p)).cast("int") for p in ps])) for n, ps in L.CONTEXTS]
    most = F.greatest(*[c for _, c in counts])
    kind = F.lit("general")
    for n, c in reversed(counts):
        kind = F.when((c == most) & (most > 0), n).otherwise(kind)
    up, down = X.hits(text, L.CONTEXT_POSITIVE), X.hits(text, L.CONTEXT_NEGATIVE)
    importance = 0.5 + F.when(low.rlike(r"\$[0-9]|[0-9] *(million|billion) *usd"), 0.2).otherwise(0.0) + F.when(kind == "deal", 0.15).otherwise(0.0) + F.when(low.rlike(_context_pattern("ceo|cto|founder|board|decided|approved")), 0.1).otherwise(0.0) + F.when(F.length(text) > 500, 0.05).otherwise(0.0)
    for flag, weight in ((key_decision, 0.2), (faq, 0.1)):
        if flag is not None:
            importance = importance + F.when(flag, weight).otherwise(0.0)
    return {"context": kind, "topics": F.array_join(X.keep([(X.hits(text, t) > 0, n) for n, t in L.TOPICS]), ","), "sentiment": F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral"), "importance": F.round(F.least(F.lit(1.0), importance), 4)}


def expiry(kind: Column, created: Column) -> Column:
    """x26."""
    out = F.lit(None).cast("date")
    for name, days in L.EXPIRY_DAYS:
        out = F.when(kind == name, F.date_add(created.cast("date"), days)).otherwise(out)
    return out


#: What a metric of over .7 confidence and any other one adds to the signal; levels of risk; tones.
SIGNALS = {"revenue": (2.5, 1.0), "growth_rate": (2.0, 0.5), "users": (2.0, 0.5), "market_size": (1.5, 0.5)}
TONES = {"strong_interest": "enthusiastic", "moderate_interest": "professional", "needs_clarification": "curious", "soft_decline": "cautious", "initial_outreach": "professional"}


def outreach_intent(metrics: dict[str, tuple[Column, Column]], claims: Column, high: Column, medium: Column, contradictions: Column, confidence: Column) -> Column:
    """c09: a struct of signal strength, level of risk, intent, tone, priority and reasoning of a first mail. metrics: value and confidence by the
    names of `SIGNALS`; claims, high, medium (risks) and contradictions are counts, confidence that of the whole extraction.
    Null or empty values are no metric, null confidences and counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    signal = F.when(zero(claims) >= 3, 1.0).when(zero(claims) >= 1, 0.5).otherwise(0.0)
    for name, (full, some) in SIGNALS.items():
        if name in metrics:
            value, sure = metrics[name]
            signal = signal + F.when(F.coalesce(value.cast("string"), F.lit("")) == "", 0.0).when(zero(sure) > 0.7, full).otherwise(some)
    sure = zero(confidence)
    risk = zero(high) * 3 + zero(medium) * 1.5 + zero(contradictions) * 2 + F.when(sure < 0.5, 2).when(sure < 0.7, 1).otherwise(0)

    def level(v: Column) -> Column:
        return F.struct(F.least(F.lit(1.0), F.round(v["signal"] / 10, 4)).alias("signal"), F.when(v["risk"] >= 5, "high").when(v["risk"] >= 2, "medium").otherwise("low").alias("risk"))

    def judge(v: Column) -> Column:
        intent = (
            F.when((v["signal"] >= 0.7) & (v["risk"] == "low") & (sure >= 0.7), "strong_interest").when((v["signal"] >= 0.5) & (v["risk"] != "high"), "moderate_interest")
            .when((sure < 0.5) | (v["risk"] == "high"), "needs_clarification").when(v["signal"] < 0.3, "soft_decline").otherwise("initial_outreach")
        )
        return F.struct(v["signal"].alias("signal"), v["risk"].alias("risk"), intent.alias("intent"))

    def word(v: Column) -> Column:
        intent = v["intent"]
        tone = F.create_map(*[F.lit(x) for kv in TONES.items() for x in kv])[intent]
        priority = F.when(intent == "strong_interest", "high").when((intent == "needs_clarification") | (intent == "moderate_interest") & (sure >= 0.6), "medium").otherwise("low")
        reasoning = F.format_string("Intent: %s, Tone: %s. Signal strength: %.2f, Risk level: %s", intent, tone, v["signal"], v["risk"])
        return F.struct(v["signal"].alias("signal"), v["risk"].alias("risk"), intent.alias("intent"), tone.alias("tone"), priority.alias("priority"), reasoning.alias("reasoning"))

    return X.let(X.let(X.let(F.struct(signal.alias("signal"), risk.alias("risk")), level), judge), word)


def contradictions(revenue: Column, arr: Column, growth: Column, market_growth: Column) -> Column:
    """x33: what contradicts: revenue and recurring revenue that differ by over half of the greater, growth below the market's. Numbers;
    null and 0 are not known."""
    known = lambda *c: F.coalesce(F.greatest(F.lit(0.0), *[F.when(x.isNull() | (x == 0), 1.0).otherwise(0.0) for x in c]) == 0, F.lit(False))
    return X.keep([(known(revenue, arr) & (F.abs(revenue - arr) / F.greatest(revenue, arr) > 0.5), "revenue and ARR differ"), (known(growth, market_growth) & (growth < market_growth), "growth below market")])


def pitch_fallback(text: Column) -> dict[str, Column]:
    """c11."""
    revenue = X.first_match(text, [r"(\$[0-9][0-9,.]*[MBK]?)"])
    growth = X.first_match(text, [r"(?i)([0-9]+%) +(?:growth|yoy|cagr)"])
    runway = X.first_match(text, [r"(?i)([0-9]+) +months? +runway"])
    flags = X.keep([(revenue.isNull(), "No revenue data found in pitch materials"), (F.lower(text).contains("competiti"), "Competitive landscape mentioned")])
    return {"revenue": revenue, "growth_rate": growth, "runway": F.concat(runway, F.lit(" months")), "flags": F.array_join(flags, "; ")}


def chart_shape(width: Column, height: Column) -> dict[str, Column]:
    """c12."""
    ratio, area = width / height, width * height
    return {"chart": F.when(ratio > 2, "timeline").when(ratio > 1.2, "bar").when(ratio > 0.8, "pie").otherwise("column"), "density": F.when(area > 1000, "high").when(area > 300, "medium").otherwise("low")}


def mined_metrics(text: Column) -> dict[str, Column]:
    """e01."""
    return {k: F.coalesce(X.first_match(text, p), F.lit("Not found")) for k, p in L.MINED_PATTERNS.items()}


def deck_metrics(text: Column) -> dict[str, Column]:
    """e02: first matching pattern of each metric, with its fixed confidence."""
    found = {k: X.first_match(text, p) for k, p in L.DECK_PATTERNS.items()}
    return found | {f"{k}_confidence": F.when(found[k].isNotNull(), c).otherwise(0.0) for k, c in L.DECK_CONFIDENCE.items()}


def with_deck_metrics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """df with e02's columns in a projection of their own, so that every pattern runs once a row however often a metric is named."""
    rows = df.select("*", *[X.first_match(F.col(text), p).alias(f"_m_{k}") for k, p in L.DECK_PATTERNS.items()])
    found = {k: F.col(f"_m_{k}") for k in L.DECK_PATTERNS}
    return rows, found | {f"{k}_confidence": F.when(found[k].isNotNull(), c).otherwise(0.0) for k, c in L.DECK_CONFIDENCE.items()}


def numeric_metrics(text: Column) -> dict[str, Column]:
    """e03: values in units, range checks, display forms, share of the five metrics found (team size is the fifth)."""
    m = {k: X.first_match(text, L.DECK_PATTERNS[k]) for k in ("revenue", "growth_rate", "users", "market_size")}
    revenue, tam, users = X.money_value(m["revenue"]), X.money_value(m["market_size"]), X.money_value(m["users"])
    growth = X.percent_value(m["growth_rate"])
    growth = F.when((growth > 0) & (growth < 1000), growth)
    size = team_size(text)
    found = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in (revenue, growth, tam, users, size)])
    return {"revenue": revenue, "revenue_display": X.money_display(revenue), "growth": growth, "tam": tam, "users_n": users, "completeness": F.round(found / 5, 4)}


def founders(text: Column) -> Column:
    """e05: names of all founder lines, pattern by pattern, at most five."""
    found = F.concat(*[F.regexp_extract_all(F.lower(text), F.lit(p), 1) for p in L.FOUNDER_PATTERNS])
    return F.slice(F.filter(F.transform(found, lambda x: F.initcap(F.trim(x))), lambda x: F.length(x) > 2), 1, 5)


def team_size(text: Column) -> Column:
    """e06."""
    sizes = [F.regexp_extract(F.lower(text), p, 1).try_cast("int") for p in L.TEAM_SIZE_PATTERNS]
    return F.coalesce(*[F.when(s.between(1, 10_000), s) for s in sizes])


def funding_stage(text: Column) -> Column:
    """e08."""
    low = F.lower(text)
    out = F.when(X.hits(text, L.EARLY) > X.hits(text, L.GROWTH), "early stage").when(X.hits(text, L.GROWTH) > X.hits(text, L.EARLY), "growth stage")
    for s in reversed(L.STAGES):
        out = F.when(low.contains(s), "Pre-seed" if s in ("pre-seed", "preseed") else s).otherwise(out)
    return out


def company_from_file(name: Column) -> Column:
    """e09: the words before the first suffix word, version or date."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.pdf$", ""), "[_-]", " "))
    cut = F.regexp_replace(bare, r"(?i)(^| )((pitch|deck|pitchdeck|presentation|final|draft)[0-9]*|v[0-9]+[^ ]*|[0-9]{8})( .*)?$", "")
    return F.when(F.length(F.trim(cut)).between(3, 49), F.trim(cut))


def company_from_text(text: Column) -> Column:
    """e10: the first pattern whose match in the opening could be a name (2 to 40 characters, no common word); else the first
    line near the top of one to four plain words that begins with a capital and isn't a heading."""
    opening = F.substring(text, 1, 2000)

    def name(pattern: str) -> Column:
        found = F.trim(F.regexp_replace(F.regexp_extract(opening, pattern, 1), r"\s+", " "))
        return F.when(F.length(found).between(2, 40) & ~F.lower(found).isin(L.NOT_NAMES), found)

    lines = F.transform(F.split(F.substring(text, 1, 500), "\n"), lambda x: F.trim(x))
    titles = F.filter(lines, lambda x: F.length(x).between(2, 35) & x.rlike(TITLE_LINE) & ~F.lower(x).rlike("|".join(L.NOT_TITLES)))
    return F.coalesce(*[name(p) for p in L.NAME_PATTERNS], F.get(titles, F.lit(0)))


_UNIT = r" *(?:k|m|b|thousand|million|billion|crore|lakh)\b"
_YEAR = r"(?:\b(?:20[0-9]{2}|2100)\b|\byear +[0-9]{1,2}\b|\b[0-9]{1,2}(?:st|nd|rd|th)? *year\b)"
_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
#: An amount that is told by its sign, its unit or its thousands; the same, or a plain number, right after a year.
_MONEY = rf"(?:[$₹] *{_NUMBER}(?:{_UNIT})?|\b{_NUMBER}{_UNIT}|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b)"
_AFTER = rf"(?:[$₹]? *{_NUMBER}(?:{_UNIT})?)"
_LINK = r" *[,(]? *(?:in|for|during|by|as of|at the end of|of|fy|[:=-])? *(?:fy|the)? *"
#: Read from the left, every year and amount goes to its next partner: a year with the amount that follows it, else an amount
#: with the year that follows it.
_PAIR = rf"(?i)({_YEAR} *[:=-]? *{_AFTER}(?!\w)|{_MONEY}{_LINK}{_YEAR})"


def year_revenues(df: DataFrame, key: str, text: str) -> DataFrame:
    """e11, e12: (year, amount) pairs with K/M/B, crore and lakh, the year before its amount or after it, both in one text
    too; years from 2000 to 2100 or numbered 1 to 20. The first of each year stays."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_PAIR), 1)).alias("pos", "found"))
    spelled = F.lower(F.regexp_extract("found", rf"(?i)^({_YEAR})|({_YEAR})$", 0))
    number = F.regexp_extract(spelled, "([0-9]+)", 1)
    year = F.when(spelled.contains("year"), F.concat(F.lit("year "), number)).otherwise(number)
    money = F.regexp_replace("found", rf"(?i)^{_YEAR}|{_YEAR}$", "")
    amount = F.regexp_replace(F.regexp_extract(money, rf"({_NUMBER})", 1), ",", "").try_cast("double")
    value = amount * X.scale_of(F.regexp_extract(money, rf"(?i){_NUMBER} *(k|m|b|thousand|million|billion|crore|lakh)\b", 1))
    from dealspark.operators.relational import first_by

    pairs = rows.select(key, "pos", spelled.contains("year").alias("numbered"), number.cast("int").alias("n"), year.alias("yr"), value.alias("revenue"))
    return first_by(pairs.where("revenue > 0 and (not numbered or n between 1 and 20)"), [key, "yr"], [F.asc("pos")]).select(key, "yr", "revenue")


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """e13: two-cell rows 'year | money' of a document; any value under 1000 makes the table unavailable."""
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = df.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").contains("|")).select(key, cells.alias("c")).where("size(c) = 2")
    rows = rows.select(key, F.expr("c[0]").alias("yr"), X.money_value(F.expr("c[1]")).alias("value")).where(F.col("yr").rlike("^[0-9]+$") & F.col("value").isNotNull())
    per = rows.groupBy(key).agg(F.min("value").alias("least"), F.count("*").alias("points"), F.max_by("value", F.col("yr").cast("int")).alias("latest"))
    return per.select(key, F.when(F.col("least") < 1000, "unavailable").otherwise("ok").alias("status"), F.when(F.col("least") >= 1000, F.col("points")).otherwise(0).alias("points"), F.when(F.col("least") >= 1000, X.money_display(F.col("latest"))).alias("display"))


def best_text_revenue(text: Column) -> Column:
    """e14: largest amount from 1e4 to under 1e9 where revenue or arr is mentioned."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(\$? *[0-9][0-9,]*(?:\.[0-9]+)? *[kmb]?)"), 1), lambda x: X.money_value(x))
    return F.when(F.lower(text).rlike("revenue|arr"), F.array_max(F.filter(found, lambda v: (v >= 1e4) & (v < 1e9))))


def document_insights(text: Column) -> dict[str, Column]:
    """e20: type, business models, the first figures, what is found on growth, technology, market and risk, and insights."""
    return _insights(X.first_class(text, L.DOC_TYPES), _insight_parts(text))


def insights_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """e20 for whole tables: what is found is a projection of its own, so that every pattern runs once a row."""
    parts = _insight_parts(F.col(text))
    found = df.select(key, X.first_class(F.col(text), L.DOC_TYPES).alias("_type"), *[c.alias(f"_{k}") for k, c in parts.items()])
    return found.select(key, *[c.alias(k) for k, c in _insights(F.col("_type"), {k: F.col(f"_{k}") for k in parts}).items()])


def _insight_parts(text: Column) -> dict[str, Column]:
    """Matches of the figures and of each insight's patterns, and whether a business model is named."""
    every = lambda patterns: F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in patterns])
    return {"amounts": every(L.FIGURES), **{n: every(p) for n, _, p in L.INSIGHTS}, **{f"is_{n}": F.lower(text).rlike(p) for n, p in L.BUSINESS_MODELS}}


def _insights(doc_type: Column, parts: dict[str, Column]) -> dict[str, Column]:
    amounts = parts["amounts"]
    growth, *others = [(F.size(parts[n]) > 0, t) for n, t, _ in L.INSIGHTS]
    models = [(parts[f"is_{n}"], n) for n, _ in L.BUSINESS_MODELS]
    said = [(F.size(amounts) > 0, F.concat(F.lit("Financial figures detected: "), F.array_join(F.slice(amounts, 1, 5), ", "))), growth, *[(c, f"Business model: {n}") for c, n in models], *others]
    return {"doc_type": F.coalesce(doc_type, F.lit("unknown")), "models": F.array_join(X.keep(models), ","), "figures": F.array_join(F.slice(amounts, 1, 5), ", "), **{n: F.array_join(parts[n], ";") for n, _, _ in L.INSIGHTS}, "insights": F.array_join(X.keep(said), " | ")}


def entities(text: Column, n: int = 10) -> Column:
    """e21: capitalised phrases over two characters and quoted phrases; distinct, in order of text, the first n."""
    caps = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z]*(?:[ \t\n]+[A-Z][a-zA-Z]*)*)"), 1), lambda e: F.length(e) > 2)
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    return F.slice(F.array_sort(F.array_distinct(F.concat(caps, quoted))), 1, n)
