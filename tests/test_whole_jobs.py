"""Queries do their job over all rows of a table, not over some of them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_stations_are_inverted(spark):
    out = QUERIES["V4_inversion"](spark, SF).toPandas()
    part = spark.read.parquet(f"{SF}/part.parquet").toPandas()
    assert sorted(out["dist"].unique()) == sorted(part["p_partkey"].astype(float))
    assert (out.groupby("dist").size() == 6).all()
    want = part.set_index("p_partkey")["p_size"] * 5.0
    assert out.groupby("dist")["ec"].median().to_numpy() == pytest.approx(want.sort_index().to_numpy(), rel=0.15)


def test_equal_stations_have_the_models_of_single_ones(spark):
    from furrow.functions import physics as E
    from furrow.operators import inversion as V

    f = [1525.0, 5325.0, 18325.0]
    q = E.forward_ppm(f, [[0.02], [0.1], [0.02]]).imag
    df = spark.createDataFrame([(float(k), [float(x) for x in r]) for k, r in enumerate(q)], "dist double, q array<double>").coalesce(1)
    out = V.invert_stations(df, f, thick=V.layer_grid(6.0, 6)).toPandas()
    for k in range(3):
        alone = 1000 * 10 ** V.invert(f, q[k : k + 1], V.data_errors(q[k : k + 1], None), V.layer_grid(6.0, 6))["log_sigma"][0]
        assert out[out["dist"] == k].sort_values("layer")["ec"].tolist() == pytest.approx(alone.tolist())


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    """A small field: 60 orders, 400 items of two years; and the same as numbers."""
    at = str(tmp_path_factory.mktemp("field"))
    r = np.random.default_rng(3)
    orders = pd.DataFrame({"o_orderkey": np.arange(1, 61) * 7, "o_custkey": r.integers(1, 1000, 60), "o_totalprice": r.uniform(1e3, 1e5, 60).round(2)})
    items = pd.DataFrame({"l_orderkey": np.arange(4000) // 4, "l_linenumber": np.arange(4000) % 4, "l_partkey": r.integers(0, 1000, 4000), "l_suppkey": r.integers(0, 500, 4000), "l_extendedprice": r.uniform(1, 1000, 4000).round(2)})
    items["l_shipdate"] = np.where(r.random(4000) < 0.5, "1995-03-01", "1996-03-01")
    spark.createDataFrame(orders).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(items).withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{at}/lineitem.parquet")
    sites = pd.DataFrame({"id": orders.o_orderkey, "x": orders.o_custkey % 1000 / 10, "y": orders.o_orderkey % 500 / 10, "ref": orders.o_totalprice, "cust": orders.o_custkey})
    area = pd.DataFrame({"rid": items.l_orderkey * 10 + items.l_linenumber, "x": items.l_partkey % 100.0, "y": items.l_suppkey % 50.0, "v": items.l_extendedprice, "year": items.l_shipdate.str[:4].astype(int)})
    return at, sites, area


def medians(sites, area):
    out = {}
    for s in sites.itertuples():
        near = area[(area.x - s.x) ** 2 + (area.y - s.y) ** 2 <= 2.25]
        if len(near):
            out[s.id] = (near.v.median(), len(near))
    return out


def test_medians_at_all_orders(spark, field):
    at, sites, area = field
    got = {r["id"]: (r["value"], r["n"]) for r in QUERIES["J1_radius_median"](spark, at).collect()}
    want = medians(sites, area)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


@pytest.mark.parametrize("most", [400_000, 40, 0])
def test_medians_of_crowded_squares(spark, field, most):
    from furrow.operators import spatial as S

    _, sites, area = field
    p = spark.createDataFrame([(int(s.id), float(s.x), float(s.y)) for s in sites.itertuples()] + [(-1, None, 1.0)], "id long, x double, y double")
    r = spark.createDataFrame([(float(a.x), float(a.y), float(a.v)) for a in area.itertuples()] + [(None, 1.0, 2.0)], "x double, y double, v double")
    got = {r["id"]: (r["value"], r["n"]) for r in S.radius_medians(p, r, 1.5, most=most).collect()}
    want = medians(sites, area)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fit_over_all_orders(spark, field):
    at, sites, area = field
    m = medians(sites, area)
    own = sites[sites.id.isin(m)]
    v = np.array([m[k][0] for k in own.id])
    gain, offset = np.polyfit(v, own.ref, 1)
    r = QUERIES["C5_reference_fit"](spark, at).first()
    assert r["pairs"] == len(own) and (r["gain"], r["offset"], r["r2"]) == pytest.approx((gain, offset, np.corrcoef(v, own.ref)[0, 1] ** 2), rel=1e-4)


def test_fit_takes_each_reference_value_once(spark):
    """Also where ids repeat: nothing is joined by them."""
    from furrow.operators import corrections as K

    ref = spark.createDataFrame([(k // 2, float(k), 0.0, 3.0 * k + 1) for k in range(8)] + [(9, 50.0, 0.0, 1.0)], "id long, x double, y double, ref double")
    r = spark.createDataFrame([(float(k), 0.0, float(k)) for k in range(8) for _ in range(3)], "x double, y double, v double")
    got = K.reference_fit(ref, r, 0.4).first()
    assert got["pairs"] == 8 and (got["gain"], got["offset"], got["r2"]) == pytest.approx((3, 1, 1))


def test_readings_are_packed_by_squares():
    from furrow.operators import spatial as S

    r = np.random.default_rng(1)
    rows = pd.DataFrame({"_sx": r.integers(-1, 2, 500), "_sy": r.integers(0, 3, 500), "x": r.normal(size=500), "y": r.normal(size=500), "v": np.where(r.random(500) < 0.1, np.nan, r.normal(size=500))})
    packed = pd.concat(S._pack_squares(iter([rows[:200], rows[200:200], rows[200:]])))
    assert len(packed) == 9
    for (sx, sy), own in packed.groupby(["_sx", "_sy"]):
        want = rows[(rows._sx == sx) & (rows._sy == sy)][["x", "y", "v"]].sort_values(["y", "x"], ignore_index=True)
        pd.testing.assert_frame_equal(S._unpacked(own["_body"].to_list()), want)


def test_bilinear_at_all_orders(spark, field):
    at, sites, area = field
    blocks = area.assign(iy=area.y // 5, ix=area.x // 5).groupby(["iy", "ix"]).v.median()
    got = {r["id"]: r["z"] for r in QUERIES["I8_bilinear"](spark, at).collect()}
    assert got.keys() == set(sites.id)
    for s in sites.itertuples():
        u, w = s.x / 5 - 0.5, s.y / 5 - 0.5
        i, j = min(math.floor(u), 18), min(math.floor(w), 8)
        if not (0 <= u <= 19 and 0 <= w <= 9):
            assert got[s.id] is None
            continue
        z = sum(blocks[j + b, i + a] * (u - i if a else 1 - u + i) * (w - j if b else 1 - w + j) for a in (0, 1) for b in (0, 1))
        assert got[s.id] == pytest.approx(z, abs=0.06)


def test_edge_over_all_items(spark, field):
    at, _, area = field
    a, b = area[area.year == 1995], area[area.year == 1996].assign(x=lambda t: t.x + 0.2)
    diff = []
    for s in b.itertuples():
        near = a.assign(d2=(a.x - s.x) ** 2 + (a.y - s.y) ** 2)
        near = near[near.d2 < 2.25].sort_values(["d2", "rid"])
        if len(near):
            diff.append(near.v.iloc[0] - s.v)
    r = QUERIES["J4_edge_match"](spark, at).first()
    assert r["pairs"] == len(diff) and r["offset"] == pytest.approx(np.median(diff), abs=1e-5)


def test_soil_fit_over_all_orders(spark, field):
    at, sites, _ = field
    slope, intercept = np.polyfit(np.log(1 + sites.cust), np.log(sites.ref), 1)
    r = QUERIES["Z6_ols_1ch"](spark, at).first()
    assert r["n"] == len(sites) and (r["slope"], r["intercept"]) == pytest.approx((slope, intercept), abs=1e-5)


def test_all_lags_are_tried(spark):
    from furrow.operators import prepare as R

    lags = [r["lag"] for r in QUERIES["C6_lag"](spark, SF).select("lag").collect()]
    assert sorted(lags) == pytest.approx(sorted(R.LAGS)) and len(lags) == 41


def test_lags_of_one_plan_are_those_of_single_ones(spark):
    from furrow.operators import corrections as K
    from furrow.operators import prepare as R

    rows = [(100 * n + k, str(n), k / 2, float(n), k * 0.5, math.sin(k * 0.3) + n) for n in range(3) for k in range(30)]
    df = spark.createDataFrame(rows, "rid long, line string, t double, x double, y double, value double")
    got = {r["lag"]: r["cost"] for r in R.lag_costs(df, 3.0, (-1.7, 0.4)).collect()}
    for lag in got:
        alone = R.cross_line_difference(K.shifted(df, lag).withColumn("lag", F.lit(lag)), 3.0).first()["cost"]
        assert got[lag] == pytest.approx(alone)
    assert sorted(got) == [-1.7, 0.4]


def test_soil_fit_brings_no_samples_to_the_driver(spark, monkeypatch):
    """The figures of a fit over all samples, from rows that don't grow with them."""
    from pyspark.sql import DataFrame

    from furrow.operators import soil as Z

    r = np.random.default_rng(4)
    ec = np.exp(r.normal(2, 0.5, (300, 3)))
    ec[:, 2] = ec[:, 1] ** 2  # in logs the same channel twice
    clay = np.exp(0.3 + 0.7 * np.log(ec[:, 0]) - 0.2 * np.log(ec[:, 1]) + r.normal(0, 0.1, 300))
    df = spark.createDataFrame(pd.DataFrame(np.c_[ec, clay], columns=["a", "b", "c", "clay"]))
    rows, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (rows.append(got := collect(self)), got)[1])
    for channels in (["a"], ["a", "b"], ["a", "b", "c"]):
        m = Z.property_fit(df, channels, "clay")
        a, y = np.c_[np.ones(300), np.log(ec[:, : len(channels)])], np.log(clay)
        coef, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ coef
        loo = e / (1 - np.einsum("ij,jk,ik->i", a, np.linalg.pinv(a.T @ a, rcond=1e-10), a))
        assert m["coef"] == pytest.approx(coef.tolist(), abs=1e-7) and m["n"] == 300
        assert (m["r2"], m["rmse"], m["loo"]) == pytest.approx((1 - e @ e / ((y - y.mean()) @ (y - y.mean())), np.sqrt(np.mean(e**2)), np.sqrt(np.mean(loo**2))), rel=1e-6)
    assert all(len(x) <= 2 for x in rows)


def counted(monkeypatch):
    """Counts the rows that come out of joins within a radius."""
    from furrow.operators import spatial as S

    rows, within = [], S.within
    monkeypatch.setattr(S, "within", lambda *a, **k: (out := within(*a, **k), rows.append(out.count()))[0])
    return rows


def test_edges_are_matched_by_places(spark, monkeypatch):
    from furrow.operators import spatial as S

    rows = counted(monkeypatch)
    r = np.random.default_rng(8)
    a, b = ([(int(k), float(r.integers(0, 4)), float(r.integers(0, 3)), float(r.normal())) for k in r.permutation(600)] for _ in range(2))
    b += [(5, 0.0, 0.0, 9.0), (700, None, 1.0, 1.0), (701, 1.0, 1.0, None)]
    one, two = (spark.createDataFrame(t, "rid long, x double, y double, v double") for t in (a, b))
    want = {}
    for rid, x, y, v in b:
        if x is None:
            continue
        near = min(((p - x) ** 2 + (q - y) ** 2, i, w) for i, p, q, w in a)
        if near[0] < 1.5**2:
            want.setdefault(rid, []).append((near[:2], None if v is None else near[2] - v))
    want = {k: min(d, key=lambda x: x[0])[1] for k, d in want.items()}
    got = S.edge_offset(one, two, 1.5).first()
    assert got["pairs"] == len(want) and got["offset"] == pytest.approx(np.median([d for d in want.values() if d is not None]))
    assert max(rows) <= 12 * 12


@pytest.mark.parametrize("backwards", [False, True])
def test_edges_of_readings_that_share_a_rid(spark, backwards):
    from furrow.operators import spatial as S

    # 1: twice at one place; 2: next to a reference twice there; 3: between two places of one reference; 4: like 1, one of them without a value; 5: like 2, one of them without a value
    b = [(1, 0.0, 0.0, 7.0), (1, 0.0, 0.0, 2.0), (1, 0.0, 0.0, 5.0), (2, 10.0, 0.0, 1.0), (3, 20.0, 0.0, 1.0), (4, 0.0, 0.0, None), (4, 0.0, 0.0, 3.0), (5, 30.0, 0.0, 1.0)]
    a = [(10, 0.0, 0.0, 100.0), (11, 10.0, 0.0, 300.0), (11, 10.0, 0.0, 200.0), (11, 10.0, 0.0, 400.0), (12, 19.0, 0.0, 60.0), (12, 21.0, 0.0, 50.0), (12, 20.0, 1.0, 70.0), (13, 30.0, 0.0, None), (13, 30.0, 0.0, 9.0), (None, 30.0, 0.0, 4.0)]
    one, two = (spark.createDataFrame(t[::-1] if backwards else t, "rid long, x double, y double, v double").coalesce(1) for t in (a, b))
    got = {r["rid"]: r["d"] for r in S.nearest_differences(one, two, 1.5).collect()}
    assert got == {1: 98.0, 2: 199.0, 3: 49.0, 4: 97.0, 5: 8.0}


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [2.0] * 999 + [5.0], None])
def test_median_of_many_values(spark, values):
    from furrow.operators import spatial as S

    values = np.random.default_rng(9).normal(size=30_001).tolist() + [None, 0.25] if values is None else values
    got = S.wide_median(spark.createDataFrame([(v,) for v in values], "d double"), "d").first()
    own = [v for v in values if v is not None]
    assert got["n"] == len(values) and got["median"] == (float(np.median(own)) if own else None)


def test_surveys_are_merged_by_places(spark, monkeypatch):
    from furrow.operators import spatial as S

    rows = counted(monkeypatch)
    r = np.random.default_rng(12)
    surveys = [[(k, str(k % 3), float(r.integers(0, 4)), float(r.integers(0, 3)), float(r.normal()) + 10 * n) for k in range(300)] for n in range(3)]
    out, offsets = S.merged([spark.createDataFrame(t, "rid long, line string, x double, y double, v double") for t in surveys], 1.5)
    before, want = [], [0.0]
    for n, t in enumerate(surveys):
        if n:
            near = [min(((p - x) ** 2 + (q - y) ** 2, name, i, w) for name, i, p, q, w in before)[3] - v for _, _, x, y, v in t]
            want.append(float(np.median(near)))
        before += [(f"{n}:{line}", k, x, y, v + want[n]) for k, line, x, y, v in t]
    assert offsets == pytest.approx(want) and out.count() == 900
    assert rows and max(rows) <= 12 * 12



@pytest.mark.parametrize("most", [2_000_000, 100, 0])
def test_points_of_one_place_share_their_median(spark, monkeypatch, most):
    from furrow.operators import spatial as S

    rows = counted(monkeypatch)
    r = np.random.default_rng(10)
    a = [(float(r.integers(0, 3)), float(r.integers(0, 3)), float(r.integers(0, 50)) if k % 40 else None) for k in range(900)]
    p = [(k, k % 5 / 2, 1.0) for k in range(300)]
    got = {x["id"]: (x["value"], x["n"]) for x in S.radius_medians(spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(a, "x double, y double, v double"), 1.5, most=most).collect()}
    for k, x, y in p:
        near = [v for q, w, v in a if (q - x) ** 2 + (w - y) ** 2 <= 2.25]
        assert got[k] == (np.median([v for v in near if v is not None]), len(near))
    assert sum(rows) <= 5 * 9 * 51


@pytest.mark.parametrize("spread", [0.02, 2.0, 40.0])
def test_nearest_readings_of_other_lines(spark, spread):
    """Crowded, even and thin fields, places that repeat, a line that stands still: as by comparing all pairs, and no pair leaves a task."""
    from furrow.operators import prepare as R

    r = np.random.default_rng(14)
    n = 500
    x, y = r.normal(0, spread, n).round(2) + 24, r.normal(0, spread, n).round(2)
    line = r.integers(0, 4, n)
    x[line == 3], y[line == 3] = 24.0, 0.5
    value = r.normal(size=n)
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    d[line[:, None] == line] = np.inf
    who = [min(range(n), key=lambda j: (d[i, j], j)) for i in range(n)]
    got_d, got = R._other_line(x, y, line, np.arange(n), np.arange(n), 3.0)
    for i in range(n):
        assert got[i] == (who[i] if d[i, who[i]] <= 3 else -1)
    own = np.array([d[i, w] for i, w in enumerate(who)])
    ok = own <= 3
    ok &= own <= 2 * np.median(own[ok])
    df = spark.createDataFrame([(0.0, i, str(line[i]), float(x[i]), float(y[i]), float(value[i])) for i in range(n)], "lag double, rid long, line string, x double, y double, value double")
    assert R.cross_line_difference(df, 3.0).first()["cost"] == pytest.approx(np.mean(np.abs(value - value[who])[ok]))
