"""Forecasts per entity against a plain loop over the days of each."""

import datetime as dt
import random

import numpy as np
import pytest

from dealspark.operators import forecast as M


def features(day: dt.date, counts: list) -> list:
    return [day.weekday(), day.month, (day.month - 1) // 3 + 1, day.timetuple().tm_yday, counts[-1] if counts else 0, counts[-7] if len(counts) >= 7 else 0]


def plain(days: dict, ahead: int, reg: float = 1e-3):
    """Ridge by stacked least squares, day after day."""
    seen, x, y = [], [], []
    for day in sorted(days):
        x.append(features(day, seen))
        y.append(days[day])
        seen.append(days[day])
    x, y = np.array(x, float), np.array(y, float)
    centre, spread = x.mean(0), x.std(0)
    rows = np.vstack([x - centre, np.diag(np.where(spread > 0, np.sqrt(reg * len(y)) * spread, 1.0))])
    beta = np.linalg.lstsq(rows, np.concatenate([y - y.mean(), np.zeros(6)]), rcond=None)[0]
    fitted = y.mean() + (x - centre) @ beta
    r2 = 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum() if y.std() > 0 else 0.0
    out, day = [], max(days)
    for _ in range(ahead):
        day += dt.timedelta(1)
        out.append((day, max(0.0, y.mean() + (np.array(features(day, seen)) - centre) @ beta)))
        seen.append(out[-1][1])
    return out, r2


def events(spark):
    r = random.Random(5)
    start, rows, truth = dt.datetime(2023, 11, 20, 9), [], {}
    for key in ("steady", "weekly", "falling", "gaps", "once", None):
        for i in range(1 if key == "once" else 60):
            n = {"steady": 4, "weekly": 9 if i % 7 < 5 else 1, "falling": max(1, 40 - i), "gaps": r.randrange(1, 6) if i % 3 else 0, "once": 3, None: r.randrange(1, 9)}[key]
            at = start + dt.timedelta(days=i)
            rows += [(key, at + dt.timedelta(minutes=m), "extra") for m in range(n)]
            if n:
                truth.setdefault(key, {})[at.date()] = n
    rows += [("steady", None, "no time"), ("timeless", None, "no time")]
    return spark.createDataFrame(rows, "key string, ts timestamp, n string"), truth


def test_linear_forecast_rolls_over_predicted_days(spark):
    df, truth = events(spark)
    got = {}
    for r in M.activity_forecast(df, "ts", "key", days=12).collect():
        got.setdefault(r.key, []).append((r.day, r.predicted, r.r2))
    assert set(got) == set(truth) - {"once"}
    for key, rows in got.items():
        want, r2 = plain(truth[key], 12)
        assert [d for d, *_ in sorted(rows)] == [d for d, _ in want]
        assert [p for _, p, _ in sorted(rows)] == pytest.approx([p for _, p in want], abs=2e-3)
        assert rows[0][2] == pytest.approx(r2, abs=1e-3)
    assert len({rows[0][2] for rows in got.values()}) > 3  # a model of its own for each key
    assert M.activity_forecast(df.limit(0), "ts", "key").count() == 0


def test_forest_forecast(spark):
    df, truth = events(spark)
    rows = M.activity_forecast(df, "ts", "key", days=7, model="rf").collect()
    got = {k: sorted((r.day, r.predicted) for r in rows if r.key == k) for k in {r.key for r in rows}}
    assert set(got) == set(truth) - {"once"} and all(len(v) == 7 for v in got.values())
    assert all(p == 4.0 for _, p in got["steady"])
    assert all((p > 5) == ((d - dt.date(2023, 11, 20)).days % 7 < 5) for d, p in got["weekly"])
    assert {r.r2 > 0.8 for r in rows if r.key == "weekly"} == {True}
    again = {(r.key, r.day): r.predicted for r in M.activity_forecast(df.repartition(3), "ts", "key", days=7, model="rf").collect()}
    assert again == {(r.key, r.day): r.predicted for r in rows}
