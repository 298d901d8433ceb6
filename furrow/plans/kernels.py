"""Queries of numeric kernels, solvers and whole preparations; their results are held against recoveries and invariants in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.functions import physics as E
from furrow.operators import aggregates as A
from furrow.operators import corrections as K
from furrow.operators import gridders as G
from furrow.operators import inversion as V
from furrow.operators import ordered as W
from furrow.operators import positions as Q
from furrow.operators import prepare as R
from furrow.operators import profiles as P
from furrow.operators import soil as Z
from furrow.operators import spatial as S
from furrow.plans.registry import query, r6
from furrow.plans.space import NODES, SPEC, _blocks
from furrow.plans.views import BLOCKS, READINGS, area, points, readings, table
from furrow.sources import tables as T

F3 = [1525.0, 5325.0, 18325.0]
_CHANNELS = {"click": 1525.0, "error": 5325.0, "purchase": 9825.0, "signup": 18325.0, "view": 63025.0}


#: The response of half-spaces of a conductivity by brute force: Simpson's rule over cube roots of wave numbers up to 20, with J0 as a mean of cosines and the complex root by hand.
_FORWARD = """coil(r, s) AS (VALUES (1.66, -1.0), (1.035, 1.0)), hz(f) AS (VALUES (1525.0), (5325.0), (18325.0)), lam AS (SELECT k, pow(k * 0.00068::DOUBLE, 3) AS l, (CASE k WHEN 4000 THEN 1 ELSE 2 + 2 * (k % 2) END) * 0.00068 * pow(k * 0.00068::DOUBLE, 2) AS w FROM range(1, 4001) t(k)),
 ker AS (SELECT k, any_value(l) AS l, sum(s * r * r * r * w * j0) * 1e6 AS w FROM (SELECT k, l, w, r::DOUBLE AS r, s::DOUBLE AS s, avg(cos(l * r * cos((i + 0.5) * pi() / 64))) AS j0 FROM lam, coil, range(64) t(i) GROUP BY ALL) GROUP BY k),
 sig AS (SELECT DISTINCT p_size AS n, p_size / 200.0::DOUBLE AS sigma FROM part), u AS (SELECT n, f, l, w, 2 * pi() * f::DOUBLE * 4e-7 * pi() * sigma AS b, l * l AS a FROM sig, hz, ker),
 v AS (SELECT *, sqrt(a * a + b * b) AS m, sqrt((sqrt(a * a + b * b) + a) / 2) AS re FROM u), x AS (SELECT *, b / (2 * re) AS im FROM v),
 z AS (SELECT n, f, sum(w * a * exp(-2 * l) * -(b * b) / (a + m) / (pow(l + re, 2) + im * im)) AS i, sum(w * a * exp(-2 * l) * -2 * l * im / (pow(l + re, 2) + im * im)) AS q FROM x GROUP BY n, f)"""
_WIDE = "wide AS (SELECT n, max(i) FILTER (f = 1525) AS i1525, max(i) FILTER (f = 5325) AS i5325, max(i) FILTER (f = 18325) AS i18325, max(q) FILTER (f = 1525) AS q1525, max(q) FILTER (f = 5325) AS q5325, max(q) FILTER (f = 18325) AS q18325 FROM z GROUP BY n)"


def _halfspaces(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 200).alias("sigma"))


@query("E1_forward", f"WITH {_FORWARD}, {_WIDE} SELECT p_partkey AS id, round(i1525, 1) AS i1525, round(i5325, 1) AS i5325, round(i18325, 1) AS i18325, round(q1525, 1) AS q1525, round(q5325, 1) AS q5325, round(q18325, 1) AS q18325 FROM part JOIN wide ON n = p_size")
def _(spark, d):
    def run(batches):
        for b in batches:
            z = E.forward_ppm(F3, b["sigma"].to_numpy()[:, None])
            yield pd.DataFrame({"id": b["id"], **{f"q{int(f)}": z[:, k].imag for k, f in enumerate(F3)}, **{f"i{int(f)}": z[:, k].real for k, f in enumerate(F3)}})

    out = _halfspaces(spark, d).mapInPandas(run, "id long, " + ", ".join(f"{c}{int(f)} double" for c in "qi" for f in F3))
    return out.select("id", *[F.round(c, 1).alias(c) for c in out.columns[1:]])


@query("E2_gradient")
def _(spark, d):
    def run(batches):
        for b in batches:
            _, g = E.forward_gradient([5325.0], np.c_[b["sigma"], b["sigma"] * 2], thickness=np.full((len(b), 1), 0.8))
            yield pd.DataFrame({"id": b["id"], "top": g[:, 0, 0].imag, "below": g[:, 0, 1].imag})

    return _halfspaces(spark, d).mapInPandas(run, "id long, top double, below double")


@query("E3_halfspace", "SELECT p_partkey AS id, CAST(p_size * 5 AS DOUBLE) AS ec FROM part")
def _(spark, d):
    # A round trip: the responses of known half-spaces give their conductivities again.
    def run(batches):
        for b in batches:
            z = E.forward_ppm([5325.0], b["sigma"].to_numpy()[:, None])[:, 0]
            yield b.assign(i=z.real, q=z.imag)

    p = _halfspaces(spark, d).mapInPandas(run, "id long, sigma double, i double, q double")
    return V.recomputed(p, 5325.0, "i", "q").select("id", F.round("ec", 3).alias("ec"))


@query("E4_resolvability", "WITH p AS (SELECT -0.5e6 * sum(s * r * r * r * (8 - r * r) / pow(4 + r * r, 2.5)) AS x FROM (VALUES (1.66::DOUBLE, 1), (1.035::DOUBLE, -1)) c(r, s)) SELECT round(x, 4) AS ppm_per_si, abs(x) >= 5000 AS resolved FROM p")
def _(spark, d):
    s = E.Sensor()
    return spark.createDataFrame([(round(E.kappa_sensitivity(s), 4), bool(E.susceptibility_resolved(s)))], "ppm_per_si double, resolved boolean")


@query("E6_depth_of_investigation")
def _(spark, d):
    return spark.createDataFrame([(f, s, E.depth_of_investigation(f, s)) for f in F3 for s in (0.005, 0.05, 0.5)], "hz double, sigma double, depth double")


@query("E7_multiheight_bias")
def _(spark, d):
    h = [0.5, 1.0, 1.5]
    z = E.forward_ppm(F3, np.full((3, 1), 0.05), heights=h)
    r = E.multiheight_bias(F3, h, z.real + 12, z.imag - 5)
    return spark.createDataFrame([(f, float(a), float(b)) for f, a, b in zip(F3, r["inphase_bias"], r["quadrature_bias"], strict=True)], "hz double, inphase double, quadrature double")


@query("E8_viscosity", "SELECT p_partkey AS id, p_size / 200.0::DOUBLE AS sigma, 0.0::DOUBLE AS viscous, 0.0::DOUBLE AS kappa FROM part")
def _(spark, d):
    def run(batches):
        for b in batches:
            z = E.forward_ppm([1525.0, 18325.0], b["sigma"].to_numpy()[:, None])
            s, v, k = E.viscosity(1525.0, 18325.0, z[:, 0].real, z[:, 0].imag, z[:, 1].imag)
            yield pd.DataFrame({"id": b["id"], "sigma": s, "viscous": v, "kappa": k})

    out = _halfspaces(spark, d).mapInPandas(run, "id long, sigma double, viscous double, kappa double")
    return out.select("id", F.round("sigma", 4).alias("sigma"), (F.round("viscous", 4) + 0.0).alias("viscous"), (F.round("kappa", 4) + 0.0).alias("kappa"))


@query("E9_survey_plan")
def _(spark, d):
    z = E.forward_ppm(F3, [[0.02, 0.02, 0.02], [0.02, 0.2, 0.02]], thickness=[[0.5, 0.5]])
    return spark.createDataFrame([(f, float(x.real), float(x.imag), bool(max(abs(a.real), abs(a.imag)) > 3)) for f, x, a in zip(F3, z[1], z[1] - z[0], strict=True)], "hz double, inphase double, quadrature double, detectable boolean")


@query("E10_ec_to_quadrature", f"WITH {_FORWARD}, {_WIDE} SELECT p_partkey AS id, round(q1525, 1) AS q0, round(q5325, 1) AS q1, round(q18325, 1) AS q2 FROM part JOIN wide ON n = p_size")
def _(spark, d):
    df = _halfspaces(spark, d).select("id", F.array(*[F.col("sigma") * 1000] * 3).alias("ec"))
    return V.quadrature_from_ec(df, F3).select("id", *[F.round(F.col("q")[k], 1).alias(f"q{k}") for k in range(3)])


def _map(method, **options):
    def run(spark, d):
        return G.grid_map(S.grid_nodes(SPEC, spark), _blocks(spark, d), method, SPEC, **options).select("iy", "ix", F.round("z", 4).alias("z"))

    return run


for _name, _method, _options in (("G3_spline", "spline", {"smoothing": 1e-3}), ("G4_linear", "linear", {}), ("G5_kriging", "kriging", {}), ("G7_minimum_curvature", "min_curvature", {})):
    query(_name)(_map(_method, **_options))


@query("G2_variogram")
def _(spark, d):
    p, v = G.collected(_blocks(spark, d))
    fits = [G.fit_variogram(p[:, 0], p[:, 1], v, m) for m in ("spherical", "exponential", "gaussian")]
    return spark.createDataFrame([(f.model, f.psill, float(f.reach), f.nugget) for f in fits], "model string, psill double, reach double, nugget double")


@query("G10_blank_distance")
def _(spark, d):
    p, _ = G.collected(_blocks(spark, d))
    n = np.array([[(i + 0.5) * 5, (j + 0.5) * 5] for j in range(10) for i in range(20)])
    return spark.createDataFrame([(G.blank_distance(p, n),)], "distance double")


@query("G11_area_map")
def _(spark, d):
    _, _, grid = R.area_map(area(spark, d), "idw", cell=5.0, level=True)
    return grid.select("iy", "ix", "x", "y", "z")


@query("G12_cell_growth")
def _(spark, d):
    p = area(spark, d)
    return spark.createDataFrame([(G.round_up_cells(lambda c: A.in_cells(p, c).select("iy", "ix").distinct().count(), 1.0, 300),)], "cell double")


@query("G14_cross_validation")
def _(spark, d):
    p, v = G.collected(_blocks(spark, d))
    rows = [(m, *(G.cross_validated(p, v, m, spec=SPEC)[k] for k in ("rmse", "mae", "n"))) for m in ("idw", "linear", "kriging")]
    return spark.createDataFrame(rows, "method string, rmse double, mae double, n long")


@query("G16_grid_despike")
def _(spark, d):
    from furrow.sources.rasters import dense

    b = A.block_medians(area(spark, d), 5.0).select("iy", "ix", F.col("v").alias("z"))
    a, n = G.despiked_grid(dense(b, 20, 10))
    return spark.createDataFrame([(j, i, float(a[j, i]), n) for j in range(10) for i in range(20) if np.isfinite(a[j, i])], "iy long, ix long, z double, spikes long")


@query("I4_profile_kriging")
def _(spark, d):
    p = points(spark, d)
    return G.profiles_by_kriging(p, P.grid(p, 4.0, ["label"]), ["label"])


@query("V1_layer_grid")
def _(spark, d):
    t = V.layer_grid()
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(t)], "layer int, thickness double")


@query("V2_stations")
def _(spark, d):
    m = points(spark, d).groupBy("label", F.floor("dist").cast("double").alias("dist")).agg(F.avg("value").alias("value"))
    return V.stations(m, {"click": 1525.0, "view": 5325.0, "error": 18325.0}, 24.0)


@query("V3_data_errors", "SELECT event_id AS rid, round(CASE WHEN event_id % 7 = 0 THEN 0.03 * abs(value) + 1 ELSE greatest(0.03 * abs(value) + 1, (event_id % 7) / 2) END, 6) AS error FROM events")
def _(spark, d):
    def run(batches):
        for b in batches:
            noise = np.where(b["rid"] % 7 == 0, np.nan, b["rid"] % 7 / 2)  # not measured everywhere
            yield pd.DataFrame({"rid": b["rid"], "error": V.data_errors(b["value"].to_numpy(float), noise)})

    return table(spark, d, "events").select(F.col("event_id").alias("rid"), "value").mapInPandas(run, "rid long, error double").select("rid", r6("error", "error"))


@query("V4_inversion")
def _(spark, d):
    s = _halfspaces(spark, d).select(F.col("id").cast("double").alias("dist"), F.array(*[F.col("sigma") * 1000] * 3).alias("ec"))
    q = V.quadrature_from_ec(s, F3).select("dist", "q").repartition(4 * spark.sparkContext.defaultParallelism, "q")  # equal responses meet
    return V.invert_stations(q, F3, thick=V.layer_grid(6.0, 6))


@query("C6_lag")
def _(spark, d):
    return R.lag_costs(readings(spark, d).withColumn("t", F.col("t") - 1704067200), 3.0)


@query("C7_prepare")
def _(spark, d):
    s = R.Settings(distance="projection", excluded=("3",), despike=5, clip=(1.0, 99.0), base_lines=("0",), drift=True, offsets={"click": 1.0}, soil_temperature=12.0)
    return R.prepared(readings(spark, d), s).select("rid", "line", "label", r6("dist", "dist"), r6("value", "value"))


@query("A14_line_axis")
def _(spark, d):
    ax, ay = R.line_axis(readings(spark, d))
    return spark.createDataFrame([(ax, ay)], "ax double, ay double")


@query("Z1_selection")
def _(spark, d):
    p = points(spark, d)
    ranked = [(r["label"], r["score"]) for r in P.scored(p, 4.0, ["label"]).orderBy(F.desc_nulls_last("score"), "label").collect()]  # one row a channel
    means = P.envelope(P.resampled(p, 4.0, ["label"]), ["label"]).select("label", "dist", "mean")
    pairs = means.join(means.withColumnsRenamed({"label": "other", "mean": "mean2"}), "dist").where("label < other").groupBy("label", "other").agg(F.corr("mean", "mean2").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    corr = {(r["label"], r["other"]): r["r"] or 0.0 for r in pairs.collect()}  # one row a pair of channels
    return spark.createDataFrame(Z.select_channels(ranked, corr), "label string, reason string")


@query("Z4_design_targets")
def _(spark, d):
    return spark.createDataFrame([(k, *map(float, t)) for k, t in enumerate(Z.design_targets(12, 2))], "site int, a double, b double")


@query("K1_mean_profiles")
def _(spark, d):
    return P.envelope(P.resampled(points(spark, d), 4.0, ["label"]), ["label"]).select("label", r6("dist", "distance"), r6("mean", "mean"))


@query("K2_scores")
def _(spark, d):
    return P.scored(points(spark, d), 4.0, ["label"]).withColumnRenamed("label", "sheet")


@query("K10_emagpy", f"WITH {READINGS} SELECT x, y, 0.0::DOUBLE AS elevation, " + ", ".join(f"max(value) FILTER (label = '{c}') AS \"HCP1.66f{f:g}h1\"" for c, f in _CHANNELS.items()) + " FROM readings GROUP BY rid, x, y")
def _(spark, d):
    wide = readings(spark, d).groupBy("rid", "x", "y").pivot("label", list(_CHANNELS)).agg(F.first("value"))
    return T.emagpy(wide, _CHANNELS)


@query("S4_whole_numbers")
def _(spark, d):
    items = table(spark, d, "lineitem")
    return spark.createDataFrame([(c,) for c in T.whole_number_columns(items, ["l_quantity", "l_extendedprice"])], "column string")


@query("T6_degrees", "SELECT c_nationkey % 3 AS k, coalesce(max(lon) - min(lon) < 0.05 AND max(lat) - min(lat) < 0.05 AND max(abs(lon)) <= 180 AND max(abs(lat)) <= 90, false) AS degrees FROM (SELECT c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 23 + (c_custkey % 40) / 1000 WHEN 1 THEN 23 + c_custkey % 40 ELSE 500.01 END AS lon, 37 + (c_custkey % 30) / 1000 AS lat FROM customer) GROUP BY 1")
def _(spark, d):
    k = F.col("c_nationkey") % 3
    p = table(spark, d, "customer").select(k.alias("k"), F.when(k == 0, 23 + (F.col("c_custkey") % 40) / 1000).when(k == 1, 23.0 + F.col("c_custkey") % 40).otherwise(500.01).alias("lon"), (37 + (F.col("c_custkey") % 30) / 1000).alias("lat"))
    return p.groupBy("k").agg(Q.degree_like("lon", "lat").alias("degrees"))


@query("T10_local_metres", "WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 > 0 THEN 23 + (c_custkey % 1000) / 1e5 END AS lon, CASE WHEN c_custkey % 50 > 0 THEN 37 + (c_custkey % 777) / 1e5 END AS lat FROM customer), o AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM p) SELECT id, round(radians(lon - lon0) * 6371008.8 * cos(radians(lat0)), 5) AS x, round(radians(lat - lat0) * 6371008.8, 5) AS y FROM p, o")
def _(spark, d):
    p = table(spark, d, "customer")
    fix = F.col("c_custkey") % 50 > 0
    p = p.select(F.col("c_custkey").alias("id"), F.when(fix, 23 + (F.col("c_custkey") % 1000) / 1e5).otherwise(0.0).alias("Lon"), F.when(fix, 37 + (F.col("c_custkey") % 777) / 1e5).otherwise(0.0).alias("Lat"))
    return Q.with_metres(p)[0].select("id", F.round("x_m", 5).alias("x"), F.round("y_m", 5).alias("y"))


@query("A29_depth_by_channel")
def _(spark, d):
    m = points(spark, d).groupBy("label").agg(A.median("value").alias("ec")).where("ec > 0")
    rows = [(r["label"], _CHANNELS[r["label"]], r["ec"], E.depth_of_investigation(_CHANNELS[r["label"]], r["ec"] / 1000)) for r in m.collect()]  # one row a channel
    return spark.createDataFrame(rows, "label string, hz double, ec double, depth double")


@query("G17_high_pass", f"WITH {BLOCKS}, {NODES}, k AS (SELECT nodes.iy, nodes.ix, least(greatest(nodes.iy + dy, 0), 9) AS jy, least(greatest(nodes.ix + dx, 0), 19) AS jx FROM nodes, (SELECT unnest(range(5)) - 2 AS dy) a, (SELECT unnest(range(5)) - 2 AS dx) b), m AS (SELECT k.iy, k.ix, avg(v) AS s FROM k LEFT JOIN blocks ON blocks.iy = jy AND blocks.ix = jx GROUP BY 1, 2) SELECT m.iy, m.ix, round(v - s, 4) AS z FROM m LEFT JOIN blocks ON blocks.iy = m.iy AND blocks.ix = m.ix")
def _(spark, d):
    b = A.block_medians(area(spark, d), 5.0).select("iy", "ix", F.col("v").alias("z"))
    g = S.grid_nodes(SPEC, spark).select("iy", "ix").join(b, ["iy", "ix"], "left")
    return S.filtered(g, "high-pass", 5, 20, 10).select("iy", "ix", F.round("z", 4).alias("z"))


@query("I6_mixed_methods", "SELECT 'EC' AS mode, 3::BIGINT AS between, 2::BIGINT AS \"within\"")
def _(spark, d):
    # Channels whose lines are passes of one track, and channels whose lines are tracks of their own.
    p = points(spark, d)
    a = P.scored(p.where("label in ('click', 'error', 'view')"), 4.0, ["label"])
    b = P.scored(p.where("label not in ('click', 'error', 'view')").withColumn("track", F.col("line")), 4.0, ["label"], track="track")
    return P.mixed_methods(a.unionByName(b).withColumn("mode", F.lit("EC")))


@query("E5_recompute_heights", "SELECT p_partkey AS id, round(0.8 + (p_partkey % 20) / 50, 2) AS height, CAST(p_size * 5 AS DOUBLE) AS ec, 0.0::DOUBLE AS ms FROM part")
def _(spark, d):
    def run(batches):
        for b in batches:
            z = E.forward_ppm([5325.0], b["sigma"].to_numpy()[:, None], heights=b["height"].to_numpy())[:, 0]
            yield b.assign(i=z.real, q=z.imag)

    p = _halfspaces(spark, d).withColumn("height", F.bround(0.8 + (F.col("id") % 20) / 50, 2))
    p = p.mapInPandas(run, "id long, sigma double, height double, i double, q double")
    return V.recomputed(p, 5325.0, "i", "q", "height").select("id", "height", F.round("ec", 3).alias("ec"), (F.round("ms", 3) + 0.0).alias("ms"))


@query("W9_infer_lines", f"WITH {READINGS}, s AS (SELECT rid, t - lag(t) OVER (ORDER BY rid) AS gap FROM readings) SELECT rid, CAST(sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (ORDER BY rid) AS DOUBLE) AS inferred FROM s")
def _(spark, d):
    # Positions as from GPS: no coordinate is constant, so pauses decide.
    return W.inferred_lines(readings(spark, d).select("rid", "x", "y", "t"))[0].select("rid", "inferred")


@query("W9_infer_grid_lines", "SELECT event_id AS rid, CAST(event_id // 100 AS DOUBLE) AS inferred FROM events")
def _(spark, d):
    # Lines of a hundred readings, each at a place of its own.
    r = readings(spark, d).select("rid", F.floor(F.col("rid") / 100).cast("double").alias("x"), "y", "t")
    return W.inferred_lines(r)[0].select("rid", "inferred")


@query("C1_height_exponential", "SELECT event_id AS rid, 5.0::DOUBLE AS corrected FROM events")
def _(spark, d):
    # A response of known shape, moved to the height where it is 5.
    h = 0.5 + F.col("y") / 50
    r = readings(spark, d).select("rid", "label", h.alias("h"), (2 + 3 * F.exp(-1.2 * (h - 1.5))).alias("value"))
    return K.height_exponential(r, "h", "value", ["label"], 1.5).select("rid", F.round("corrected", 2).alias("corrected"))


@query("T16_value_labels", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'EC (mS/m)' WHEN 1 THEN 'Quadrature (ppm)' WHEN 2 THEN 'Power-line noise (mG)' ELSE p_brand END AS label FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    mode, channel = F.when(k == 0, "EC").when(k == 1, "Q").otherwise("AUX"), F.when(k == 2, "PowerLn").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.value_label(mode, channel).alias("label"))


@query("T17_durations", "SELECT o_orderkey AS id, CASE WHEN s < 90 THEN s || ' s' WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || lpad((m % 60)::VARCHAR, 2, '0') || ' min' END AS text FROM (SELECT o_orderkey, o_custkey % 20000 AS s, CAST(round_even((o_custkey % 20000) / 60, 0) AS BIGINT) AS m FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.duration_text((F.col("o_custkey") % 20000).cast("double")).alias("text"))


@query("T17_summary", f"WITH {READINGS} SELECT '**' || count(DISTINCT line) || ' lines** · **' || format('{{:,}}', count(*)) || ' readings** · **47 min** of recording' AS text FROM readings")
def _(spark, d):
    none = F.lit(None).cast("double")
    a = readings(spark, d).agg(F.count_distinct("line").alias("l"), F.count(F.lit(1)).alias("n"))
    return a.select(C.summary_text(F.col("l"), F.col("n"), none, none, F.lit(2820.0)).alias("text"))


@query("A26_levels_fixed", f"WITH {READINGS} SELECT CAST(k AS INTEGER) AS k, round(10 + (m - 10) * k / 5, 6) AS level FROM (SELECT max(value) AS m FROM readings), range(6) t(k)")
def _(spark, d):
    return A.levels(readings(spark, d), "value", 5, span="fixed", least=10.0).select("k", r6("level", "level"))


@query("K4_grid_rows", f"WITH {BLOCKS} SELECT round(ix * 5 + 2.5, 6) AS x, round(iy * 5 + 2.5, 6) AS y, round(v, 4) AS value, round(23 + degrees((ix * 5 + 2.5) / (6371008.8 * cos(radians(37)))), 8) AS lon, round(37 + degrees((iy * 5 + 2.5) / 6371008.8), 8) AS lat FROM blocks")
def _(spark, d):
    b = A.block_medians(area(spark, d), 5.0).select("iy", "ix", F.col("v").alias("z"))
    g = S.grid_nodes(SPEC, spark).join(b, ["iy", "ix"], "left")
    return T.grid_rows(g, (23.0, 37.0)).select("x", "y", F.round("value", 4).alias("value"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))
