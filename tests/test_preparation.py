"""Line inference, height and temperature fits, recomputing, calibration and merging, each against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import physics as E
from furrow.operators import corrections as K
from furrow.operators import ordered as W
from furrow.operators import prepare as R
from furrow.operators import spatial as S


def survey(spark, x, y, t):
    rows = [(k, *(None if v is None else float(v) for v in r)) for k, r in enumerate(zip(x, y, t, strict=True))]
    return spark.createDataFrame(rows, "rid long, x double, y double, t double")


def labels(out):
    return [r["inferred"] for r in out.orderBy("rid").collect()]


def test_lines_of_a_constant_coordinate(spark):
    x, y = np.repeat([0.0, 2.0, 4.0], 20), np.tile(np.arange(20.0), 3)
    out, how = W.inferred_lines(survey(spark, x, y, np.arange(60)))
    assert labels(out) == x.tolist() and "constant X and where Y restarts" not in how and "constant X" in how


def test_lines_where_the_other_coordinate_restarts(spark):
    x, y = np.r_[np.zeros(40), np.full(20, 3.0)], np.tile(np.arange(20.0), 3)
    x = [None, *x[1:]]
    out, how = W.inferred_lines(survey(spark, x, y, np.arange(60)))
    assert labels(out) == [0.0] * 20 + [1.0] * 20 + [2.0] * 20 and "Y restarts" in how


def test_lines_of_a_single_coordinate_of_pauses_and_of_nothing(spark):
    y = np.tile(np.arange(0, 20, 0.5), 2)
    both = survey(spark, y, y, np.arange(80))
    out, how = W.inferred_lines(both, x=None)
    assert labels(out) == [0.0] * 40 + [1.0] * 40 and "Y restarts" in how
    serpentine = survey(spark, np.zeros(80), np.r_[y[:40], y[:40][::-1]], np.arange(80)).drop("x")
    assert "pauses" in W.inferred_lines(serpentine, x=None)[1]
    gps = survey(spark, np.random.default_rng(0).uniform(0, 9, 30), np.random.default_rng(1).uniform(0, 9, 30), np.r_[np.arange(10), 20 + np.arange(20)])
    out, how = W.inferred_lines(gps)
    assert labels(out) == [0.0] * 10 + [1.0] * 20 and "pauses" in how
    assert labels(W.inferred_lines(gps.drop("t"))[0]) == [0.0] * 30


def test_exponential_height_response(spark):
    r = np.random.default_rng(0)
    h = r.uniform(0.5, 2.5, 400)
    v = {"bent": 3 + 40 * np.exp(-1.3 * h), "straight": 5 - 2 * h, "few": h}
    rows = [(k, c, float(x), float(y)) for c, w in v.items() for k, (x, y) in enumerate(zip(h, w, strict=True)) if c != "few" or k < 3] + [(999, "bent", None, 1.0)]
    df = spark.createDataFrame(rows, "rid long, label string, h double, value double")
    out = {c: [r for r in K.height_exponential(df, "h", "value", ["label"], 1.0).where(f"label = '{c}' and rid < 999").orderBy("rid").collect()] for c in v}
    assert np.allclose([r["corrected"] for r in out["bent"]], 3 + 40 * np.exp(-1.3), atol=1e-3)
    assert np.allclose([r["corrected"] for r in out["straight"]], 3, atol=1e-3)
    assert len(out["few"]) == 3


def test_temperature_with_a_trend_in_time(spark):
    t, c = np.arange(6.0), np.array([10.0, 14, 11, 15, 12, 13])
    occ = spark.createDataFrame([("a", float(x), float(y), float(1 + 0.5 * x + 2 * y)) for x, y in zip(t, c, strict=True)] + [("b", float(x), float(x), float(3 * x)) for x in t] + [("c", 0.0, 1.0, 2.0), ("c", 1.0, 2.0, 5.0)], "label string, t double, c double, v double")
    got = {r["label"]: r["_b"] for r in K.temperature_slopes(occ, ["label"]).collect()}
    assert got == pytest.approx({"a": 2.0, "b": 3.0, "c": 3.0})  # b: time and temperature are one; c: too few occupations


def rows_of(spark, channels, n, lines):
    data = [(k, str(lines[k]), float(k), float(k % 20), float(lines[k]), 0.0, None, label, float(v[k]), float(20 + np.sin(k))) for label, v in channels.items() for k in range(n)]
    return spark.createDataFrame(data, "rid long, line string, t double, x double, y double, status double, mark double, label string, value double, temp double")


def test_piecewise_drift_of_every_channel(spark):
    n, lines = 60, np.repeat(np.arange(6), 10)
    drift = np.interp(np.arange(n), [4.5, 34.5, 54.5], [0.0, 6.0, 2.0])
    channels = {"a": 10 + drift, "b": 5 - 2 * drift}
    out = R.prepared(rows_of(spark, channels, n, lines), R.Settings(base_lines=("0", "3", "5"), drift=True, drift_model="piecewise", distance="path")).collect()
    assert {r["line"] for r in out} == {"1", "2", "4"}
    base = {c: np.mean(channels[c][:10]) for c in channels}
    occ = {c: [np.mean(channels[c][a : a + 10]) for a in (0, 30, 50)] for c in channels}
    for r in out:
        want = channels[r["label"]][r["rid"]] - (np.interp(r["rid"], [4.5, 34.5, 54.5], occ[r["label"]]) - base[r["label"]])
        assert r["value"] == pytest.approx(want)


def test_recomputed_and_viscous_channels(spark):
    s = np.geomspace(0.01, 0.2, 30)
    z = E.forward_ppm([1525.0, 18325.0], s[:, None])
    channels = {"I1": z[:, 0].real, "Q1": z[:, 0].imag, "Q2": z[:, 1].imag, "EC1": np.zeros(30)}
    settings = R.Settings(distance="path", recompute=((1525.0, "I1", "Q1", "EC1", "MS1"),), viscosity=(1525.0, 18325.0, "I1", "Q1", "Q2"), soil_temperature=25.0, ec_labels=("EC1",))
    out = R.prepared(rows_of(spark, channels, 30, np.zeros(30, int)), settings)
    got = {(r["label"], r["rid"]): r["value"] for r in out.collect()}
    assert {x for x, _ in got} == {"I1", "Q1", "Q2", "EC1", "MS1", *R.VISCOSITY_LABELS}
    assert np.allclose([got["EC1", k] for k in range(30)], 1000 * s, rtol=1e-3) and np.allclose([got["MS1", k] for k in range(30)], 0, atol=1e-2)
    assert np.allclose([got[R.VISCOSITY_LABELS[0], k] for k in range(30)], 1000 * s, rtol=2e-2)
    assert "magnetic viscosity added" in settings.describe()


def test_calibration_by_reference_points(spark):
    n = 40
    v = np.arange(n) * 0.7 + 3
    ref = spark.createDataFrame([(k, "a", float(k % 20), float(k // 20), float(2 * v[k] + 1)) for k in range(0, n, 3)], "id long, label string, x double, y double, ref double")
    df = rows_of(spark, {"a": v, "b": v}, n, np.arange(n) // 20)
    out = R.prepared(df, R.Settings(distance="path", reference=ref, reference_radius=0.1)).collect()
    assert all(r["value"] == pytest.approx(2 * v[r["rid"]] + 1 if r["label"] == "a" else v[r["rid"]]) for r in out)


def test_surveys_are_moved_one_after_the_other(spark):
    def part(x0, shift):
        return spark.createDataFrame([(k, "7", float(x0 + k % 10), float(k // 10), float(x0 + k % 10 + shift)) for k in range(60)], "rid long, line string, x double, y double, v double")

    parts = [part(0, 0.0), part(8, 5.0), part(16, -3.0), part(500, 9.0)]
    out, offsets = S.merged([*parts[:3], parts[3].withColumn("more", F.lit(1))], 0.5)
    assert offsets == pytest.approx([0, -5, 3, 0])
    assert {r["line"] for r in out.collect()} == {"0:7", "1:7", "2:7", "3:7"} and out.where("more is null").count() == 180
    assert out.where("x < 100").where("abs(v - x) > 1e-9").count() == 0
    assert S.merged(parts, 0.5, match=False)[1] == [0, 0, 0, 0]
