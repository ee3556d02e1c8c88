"""Recurrent regressors against finite differences, and their frames; exponential means against pandas."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import market, models
from tidewire.operators.recurrent import Forecaster, Regressor, Settings

DAY = datetime.date(2020, 1, 1)


@pytest.mark.parametrize("kind", ["lstm", "gru"])
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients(kind, dropout):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4, 3)), rng.normal(size=7)
    net = Regressor(kind, 3, Settings(hidden=5, layers=2, dropout=dropout, seed=1))
    masks = lambda: np.random.default_rng(9)
    error = lambda: float(((net.forward(x, masks())[0] - y) ** 2).mean())
    grads, _ = net.gradients(x, y, masks())
    for name, values in net.p.items():
        flat, got = values.reshape(-1), grads[name].reshape(-1)
        for at in rng.choice(flat.size, min(flat.size, 12), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-6
            high = error()
            flat[at] = kept - 1e-6
            low = error()
            flat[at] = kept
            assert got[at] == pytest.approx((high - low) / 2e-6, rel=2e-4, abs=1e-8), name


def test_shape_is_as_published():
    net = Regressor("lstm", 22)
    shapes = {k: v.shape for k, v in net.p.items()}
    assert shapes == {"x0": (22, 256), "h0": (64, 256), "b0": (256,), "x1": (64, 256), "h1": (64, 256), "b1": (256,), "gain": (64,), "shift": (64,), "in": (64, 32), "in_bias": (32,), "out": (32,), "out_bias": (1,)}
    assert {k: v.shape for k, v in Regressor("gru", 15).p.items() if k[0] in "xhc"} == {"x0": (15, 192), "h0": (64, 192), "c0": (64,), "x1": (64, 192), "h1": (64, 192), "c1": (64,)}


@pytest.mark.parametrize("kind", ["lstm", "gru"])
def test_learns_and_keeps_the_best_epoch(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5, 2))
    y = x[:, -1, 0] - 0.5 * x[:, -2, 1]
    net = Regressor(kind, 2, Settings(hidden=12, layers=2, epochs=25, rate=5e-3, patience=6, dropout=0.1))
    history = net.fit(x[:300], y[:300], x[300:], y[300:])
    best = min(history, key=lambda r: r[2])
    assert net.best_epoch == best[0] and best[2] < 0.3 * y[300:].var()
    assert ((net.predict(x[300:]) - y[300:]) ** 2).mean() == pytest.approx(best[2])
    assert len(history) == 25 or len(history) == best[0] + 6


def _sequences(spark):
    rng = random.Random(1)
    rows = [(t, DAY + datetime.timedelta(i), [[rng.gauss(0, 1), 1.0] for _ in range(4)], rng.gauss(0, 1) if i % 50 else None, "train" if i < 70 else "val" if i < 85 else "test") for t in ("a", "b") for i in range(100)]
    rows += [("only test", DAY, [[0.0, 1.0]] * 4, 1.0, "test"), ("only train", DAY, [[0.0, 1.0]] * 4, 1.0, "train")]
    return spark.createDataFrame(rows, "ticker string, date date, steps array<array<double>>, target double, split string")


def test_models_are_saved_and_forecast_alike(spark, tmp_path):
    rows = _sequences(spark)
    fitted = models.trained(rows, kinds=("lstm", "gru", "linear"), settings=Settings(hidden=6, epochs=3))
    models.save(fitted, f"{tmp_path}/models")
    back = models.load(spark, f"{tmp_path}/models")
    got, direct = ({(r.ticker, r.kind, r.date): r.predicted for r in models.forecasts(rows, m).collect()} for m in (back, fitted))
    assert got == direct and len(got) == 2 * 3 * 15 and all(np.isfinite(v) for v in got.values())
    assert {(r.ticker, r.kind) for r in back.collect()} == {(t, k) for t in ("a", "b", "only train") for k in ("lstm", "gru", "linear")}
    told = models.history(back).where("ticker = 'a' and kind = 'gru'").orderBy("epoch").collect()
    assert [r.epoch for r in told] == [1, 2, 3] and all(r.train_loss > 0 and r.val_loss > 0 for r in told)
    models.save(back.withColumn("version", F.lit(99)), f"{tmp_path}/other")
    with pytest.raises(ValueError, match="version"):
        models.load(spark, f"{tmp_path}/other")


def test_model_bytes_hold_no_code():
    x, y, split = np.zeros((5, 2, 1)), np.arange(5.0), np.array(["train"] * 4 + ["val"])
    made, _ = Forecaster.fitted("gru", x, y, split, Settings(hidden=4, epochs=1))
    back = Forecaster.loads(made.dumps())
    assert (back.predict(x) == made.predict(x)).all() and back.network.s.hidden == 4
    with pytest.raises(ValueError):
        Forecaster.loads(b"not a model")


@pytest.mark.parametrize("alpha", [1.0, 0.5, 2 / 6, 2 / 27, 1 / 14, 0.004])
def test_smoothing_equals_the_recursion(spark, alpha):
    rng = random.Random(7)
    rows = [(t, DAY + datetime.timedelta(i), None if rng.random() < gaps else 50 + rng.gauss(0, 5)) for t, n, gaps in ((0, 3000, 0.0), (1, 900, 0.3), (2, 1, 0.0), (3, 40, 1.0)) for i in range(n)]
    frame = spark.createDataFrame(rows, "ticker int, date date, close double")
    got = market.smoothed(frame, {"e": ("close", alpha)}).orderBy("ticker", "date").toPandas()
    want = pd.DataFrame(rows, columns=["ticker", "date", "close"]).groupby("ticker")["close"].transform(lambda c: c.astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean())
    assert np.allclose(got["e"].astype(float), want, rtol=1e-10, equal_nan=True)


def test_targets(spark):
    frame = spark.createDataFrame([(0, DAY + datetime.timedelta(i), float(i)) for i in range(6)], "ticker int, date date, close double")
    got = [(r.target, r.target_date) for r in market.targets(frame, 3, "next_close").orderBy("date").collect()]
    assert got == [(float(i + 3), DAY + datetime.timedelta(i + 3)) for i in range(3)] + [(None, None)] * 3
    assert [r.target for r in market.targets(frame, 2).orderBy("date").collect()] == [None, 2.0, 1.0, pytest.approx(2 / 3), None, None]
    with pytest.raises(ValueError, match="mode"):
        market.targets(frame, 1, "other")
