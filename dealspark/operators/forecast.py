"""Forecasts, performance and composite reports (m01-m10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType

from dealspark.operators import aggregates as A
from dealspark.operators import relational as R


def revenue_forecast(points: DataFrame, key: str, order: str, value: str, horizon: int = 5) -> DataFrame:
    """m01: least squares on the position; the next values, growth, confidence and an insight. One row per key and step;
    keys with one point say so."""
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("double")
    fit = points.select(key, F.col(value).alias("y"), pos.alias("x")).groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.coalesce(F.regr_r2("y", "x"), F.lit(0.0)).alias("r2"), F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last"))
    growth = (F.col("last") - F.col("first")) / F.col("first") * 100
    insight = F.when(growth > 20, "strong growth").when(growth < -10, "declining").otherwise("steady")
    trust = F.when(F.col("r2") > 0.8, "reliable").when(F.col("r2") < 0.5, "uncertain").otherwise("fair")
    ok = fit.where("n >= 2").select(key, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), (F.col("intercept") + F.col("slope") * (F.col("n") - 1)).alias("at_end"), "slope", "r2", growth.alias("growth"), insight.alias("insight"), trust.alias("trust"))
    ok = ok.select(key, "step", F.round(F.col("at_end") + F.col("slope") * F.col("step") + 1e-7, 2).alias("predicted"), F.round(F.least("r2", F.lit(0.9)), 6).alias("confidence"), F.round("growth", 4).alias("growth"), "insight", "trust")
    few = fit.where("n < 2").select(key, F.lit(0).alias("step"), F.lit(None).cast("double").alias("predicted"), F.lit(0.0).alias("confidence"), F.lit(None).cast("double").alias("growth"), F.lit("insufficient data").alias("insight"), F.lit("none").alias("trust"))
    return ok.unionByName(few)


#: Features of w03 that the models of m02 and m04 use.
FEATURES = ["dow", "month", "quarter", "doy", "lag_1", "lag_7"]


def roll(predict: Callable[[np.ndarray], np.ndarray], last: np.ndarray, tail: np.ndarray, days: int) -> np.ndarray:
    """The next days of many series at once: last (datetime64 days), tail (the 7 latest values of each). A predicted day is the lag of those
    after it. predict maps features (series x 6) to values; they don't fall below 0."""
    tail, out = tail.astype("float64").copy(), np.zeros((len(last), days))
    for i in range(days):
        day = last + np.timedelta64(i + 1, "D")
        month = day.astype("datetime64[M]").astype("int64") % 12 + 1
        dow = (day.astype("int64") + 3) % 7  # Monday is 0
        doy = (day - day.astype("datetime64[Y]")).astype("int64") + 1
        out[:, i] = np.maximum(0.0, predict(np.column_stack([dow, month, (month - 1) // 3 + 1, doy, tail[:, -1], tail[:, 0]]).astype("float64")))
        tail = np.column_stack([tail[:, 1:], out[:, i]])
    return out


def ridge(cov: np.ndarray, with_label: np.ndarray, var: np.ndarray, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and training R2 of many models from their covariances (models x 6 x 6, models x 6, models). The penalty of a
    feature is reg times its variance; one that doesn't vary has coefficient 0, a label that doesn't has R2 0."""
    spread = np.einsum("bii->bi", cov)
    beta = np.linalg.solve(cov + np.where(spread > 0, reg * spread, 1.0)[:, :, None] * np.eye(cov.shape[1]), with_label[:, :, None])[:, :, 0]
    error = var - 2 * (beta * with_label).sum(1) + np.einsum("bi,bij,bj->b", beta, cov, beta)
    return beta, np.where(var > 0, 1 - error / np.where(var > 0, var, 1.0), 0.0)


def _linear(known: DataFrame, key: str, days: int, reg: float) -> DataFrame:
    """One model per key from normal equations that Spark adds up; solved and rolled on in batches of keys."""
    k, x = len(FEATURES), [F.col(c).cast("double") for c in FEATURES]
    y = F.col("n").cast("double")
    sums = [F.avg(c) for c in [*x, y]] + [F.covar_pop(x[i], x[j]) for i in range(k) for j in range(i, k)] + [F.covar_pop(c, y) for c in x] + [F.var_pop(y)]
    models = known.groupBy(key).agg(F.count("*").alias("_rows"), F.max("day").alias("_last"), F.max_by("tail", "day").alias("_tail"), *[c.alias(f"_{i}") for i, c in enumerate(sums)])
    models = models.where("_rows > 1").select(F.col(key).alias("k"), "_last", "_tail", F.array(*[f"_{i}" for i in range(len(sums))]).alias("_sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(k)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            last = batch.column(1).to_numpy(zero_copy_only=False).astype("datetime64[D]")
            tail = np.array(batch.column(2).to_pylist(), dtype="float64").reshape(n, 7)
            sums = np.array(batch.column(3).to_pylist(), dtype="float64").reshape(n, -1)
            mean, label, rest = sums[:, :k], sums[:, k], sums[:, k + 1 :]
            cov = np.zeros((n, k, k))
            cov[:, upper[0], upper[1]] = cov[:, upper[1], upper[0]] = rest[:, : len(upper[0])]
            beta, r2 = ridge(cov, rest[:, len(upper[0]) : -1], rest[:, -1], reg)
            out = roll(lambda f: label + ((f - mean) * beta).sum(1), last, tail, days)  # noqa: B023
            day = (last[:, None] + np.arange(1, days + 1).astype("timedelta64[D]")).ravel()
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(n), days))), pa.array(day, pa.date32()), pa.array(out.ravel()), pa.array(np.repeat(r2, days))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "day", "predicted", "r2"])

    return models.mapInArrow(run, StructType([models.schema["k"], *_FORECAST]))


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A regression tree on a third of the features at each split: (feature, threshold, left, right) or a mean."""
    best = None
    if depth and len(y) > 1 and y.min() < y.max():
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, total = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = total[at] ** 2 / (at + 1) + (total[-1] - total[at]) ** 2 / (len(y) - at - 1)
                if best is None or gain.max() > best[0]:
                    best = (gain.max(), f, (v[at[gain.argmax()]] + v[at[gain.argmax()] + 1]) / 2)
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, rng), grow(x[~left], y[~left], depth - 1, rng)


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, threshold, low, high = tree
    return np.where(x[:, feature] <= threshold, tree_values(low, x), tree_values(high, x))


def _forest(known: DataFrame, key: str, days: int, trees: int, depth: int, seed: int) -> DataFrame:
    """One forest per key, by grouped training. A group has one row a day, so that it's bounded by the length of history, not by the
    number of events."""
    rows = known.select(F.col(key).alias("k"), "day", F.col("n").cast("double").alias("n"), *FEATURES, "tail")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        y, x = table["n"].to_numpy(), np.column_stack([table[c].to_numpy() for c in FEATURES]).astype("float64")
        if len(y) < 2:
            return table.select(["k", "day"]).slice(0, 0).append_column("predicted", pa.array([], pa.float64())).append_column("r2", pa.array([], pa.float64()))
        rng = np.random.default_rng(seed)
        grown = []
        for _ in range(trees):
            drawn = rng.integers(0, len(y), len(y))
            grown.append(grow(x[drawn], y[drawn], depth, rng))
        predict = lambda f: np.mean([tree_values(t, f) for t in grown], axis=0)
        spread = ((y - y.mean()) ** 2).sum()
        r2 = 1 - ((y - predict(x)) ** 2).sum() / spread if spread > 0 else 0.0
        last = np.array([table["day"][-1].as_py()], dtype="datetime64[D]")
        out = roll(predict, last, np.array([table["tail"][-1].as_py()]), days)[0]
        return pa.table({"k": table["k"].take(pa.array([0] * days)), "day": pa.array(last + np.arange(1, days + 1).astype("timedelta64[D]"), pa.date32()), "predicted": out, "r2": np.full(days, r2)})

    return rows.groupBy("k").applyInArrow(run, StructType([rows.schema["k"], *_FORECAST]))


_FORECAST = [StructField("day", DateType()), StructField("predicted", DoubleType()), StructField("r2", DoubleType())]


def activity_forecast(df: DataFrame, ts: str, key: str, days: int = 7, model: str = "linear", reg: float = 1e-3, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """m02, m04: a model of each key on the calendar features and lags of w03, and the key's next days; what is predicted for a day is the lag
    of later ones, and counts don't fall below 0. The lags are those of w03: the first and seventh row before, 0 where there is none. `linear`
    is ridge regression, `rf` a forest. Returns key, day, predicted, r2 (of that key's training). Rows without a time are left out, keys
    with one day have no forecast, a null key is one of its own."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("day").rowsBetween(-6, 0)
    latest = F.collect_list(F.col("n").cast("double")).over(w)
    known = R.ts_features(df.where(F.col(ts).isNotNull()), ts, key).withColumn("tail", F.concat(F.array_repeat(F.lit(0.0), 7 - F.size(latest)), latest))
    if model not in ("linear", "rf"):
        raise ValueError("model is linear or rf")
    out = _linear(known, key, days, reg) if model == "linear" else _forest(known, key, days, trees, depth, seed)
    return out.select(F.col("k").alias(key), "day", F.round("predicted", 4).alias("predicted"), F.round("r2", 4).alias("r2"))


def combine_trends(a: DataFrame, b: DataFrame, day: str, value: str) -> DataFrame:
    """m03."""
    j = a.select(day, F.col(value).alias("_a")).join(b.select(day, F.col(value).alias("_b")), day, "full")
    return j.select(day, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias(value))


def company_performance(drafts: DataFrame, library: DataFrame) -> DataFrame:
    """m05: mean rank over 3, trend, frequency per day, band and advice."""
    rank = F.when(F.col("confidence") == "High", 3).when(F.col("confidence") == "Medium", 2).otherwise(1)
    per = drafts.groupBy("company").agg(F.count("*").alias("drafts"), F.round(F.avg(rank) / 3, 6).alias("mean_score"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    files = library.groupBy("company").agg(F.count("*").alias("files"))
    days = F.greatest(F.datediff("hi", "lo"), F.lit(1))
    j = per.join(R.confidence_trend(drafts).select("company", "trend"), "company").join(files, "company", "left")
    freq = F.round((F.col("drafts") + F.coalesce("files", F.lit(0))) / days, 6)
    return j.select("company", "drafts", F.coalesce("files", F.lit(0)).alias("files"), "mean_score", "trend", freq.alias("frequency"), F.when(freq > 0.5, "high").when(freq > 0.1, "medium").otherwise("low").alias("activity"), F.when(F.col("trend") == "improving", "Increase attention").when(F.col("trend") == "declining", "Review the company").otherwise("Keep monitoring").alias("advice"))


def portfolio_report(drafts: DataFrame) -> DataFrame:
    """m06: health, sizes of the risk buckets and the best company, in long form."""
    ratios = A.confidence_ratio(drafts)
    health = A.portfolio_health(ratios).select(F.lit("health").alias("metric"), F.col("status").alias("value"))
    buckets = ratios.groupBy(A.risk_bucket(F.col("ratio")).alias("b")).agg(F.count("*").alias("n")).select(F.concat(F.lit("risk_"), "b").alias("metric"), F.col("n").cast("string").alias("value"))
    best = ratios.orderBy(F.desc("ratio"), F.desc("drafts"), "company").limit(1).select(F.lit("top_company").alias("metric"), F.col("company").alias("value"))
    return health.unionByName(buckets).unionByName(best)


def market_snapshot(quotes: DataFrame, refs: DataFrame) -> DataFrame:
    """m09: the latest quote of every reference name, 0 where there is none. refs is a short fixed list."""
    latest = quotes.groupBy("name").agg(F.max_by("price", "at").alias("price"), F.count("*").alias("quotes"))
    return F.broadcast(refs).join(latest, "name", "left").select("name", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("quotes", F.lit(0)).alias("quotes"))


def news_digest(news: DataFrame, limit: int) -> DataFrame:
    """m10: of the newest items the count and mean sentiment of each symbol."""
    top = news.orderBy(F.desc("published"), "url").limit(limit)
    return top.select("sentiment", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("sentiment"), 4).alias("sentiment"))
