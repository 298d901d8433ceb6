"""Queries over columns, filters, ordered operators, aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import aggregates as A
from furrow.operators import corrections as K
from furrow.operators import ordered as W
from furrow.operators import profiles as P
from furrow.plans.registry import query, r6, rounded
from furrow.plans.views import AREA, BLOCKS, POINTS, READINGS, area, points, readings, table

# Columns and scalar functions


@query("T3_frequency", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS hz FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_size").cast("string")
    label = F.when(F.col("p_size") % 4 == 0, F.concat(n, F.lit(" kHz"))).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit("HZ"))).when(F.col("p_size") % 4 == 2, n).otherwise(F.concat(n, F.lit(" mS/m")))
    return p.select(F.col("p_partkey").alias("id"), C.frequency_hz(label).alias("hz"))


@query("T4_line_labels", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey // 2 AS VARCHAR) ELSE CAST(s_suppkey // 2 AS VARCHAR) || '.5' END AS label FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.line_text(F.col("s_suppkey") / 2).alias("label"))


@query("T5_midnight", f"WITH {READINGS}, c AS (SELECT rid, line, t - 86400 * floor(t / 86400) AS c FROM readings), s AS (SELECT rid, line, c, CASE WHEN c < lag(c) OVER (PARTITION BY line ORDER BY rid) - 43200 THEN 1 ELSE 0 END AS d FROM c) SELECT rid, line, round(c + 86400 * sum(d) OVER (PARTITION BY line ORDER BY rid), 3) AS t FROM s")
def _(spark, d):
    r = readings(spark, d).withColumn("t", F.pmod(F.col("t"), F.lit(86400.0)))
    return W.unwrapped(r, by=["line"]).select("rid", "line", F.round("t", 3).alias("t"))


@query("T8_project", "SELECT c_custkey AS id, round(radians(lon - lon0) * 6371008.8 * cos(radians(lat0)), 6) AS x, round(radians(lat - lat0) * 6371008.8, 6) AS y FROM (SELECT c_custkey, 23 + (c_custkey % 1000) / 1e5 AS lon, 37 + (c_custkey % 777) / 1e5 AS lat, avg(23 + (c_custkey % 1000) / 1e5) OVER () AS lon0, avg(37 + (c_custkey % 777) / 1e5) OVER () AS lat0 FROM customer)")
def _(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (23 + (F.col("c_custkey") % 1000) / 1e5).alias("lon"), (37 + (F.col("c_custkey") % 777) / 1e5).alias("lat"))
    o = p.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    x, y = C.metres(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return p.crossJoin(F.broadcast(o)).select("id", r6(x, "x"), r6(y, "y"))


@query("T9_utm_zone", "SELECT c_custkey AS id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS epsg FROM (SELECT c_custkey, (c_custkey % 360) - 180.0 AS lon, (c_custkey % 160) - 80.0 AS lat FROM customer)")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.utm_epsg((F.col("c_custkey") % 360) - 180.0, (F.col("c_custkey") % 160) - 80.0).alias("epsg"))


@query("T9_utm_xy")
def _(spark, d):
    lon, lat = 20 + (F.col("c_custkey") % 600) / 100, (F.col("c_custkey") % 1200) / 10 - 60
    x, y = C.utm_xy(lon, lat, F.floor((lon + 180) / 6) + 1)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"), x.alias("x"), y.alias("y"))


@query("T11_ec25", "SELECT event_id AS rid, round(value * (0.4470 + 1.4034 * exp(-(event_id % 30) / 26.815)), 6) AS ec25 FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("rid"), r6(C.ec_at_25(F.col("value"), (F.col("event_id") % 30).cast("double")), "ec25"))


@query("T12_skin_depth", "SELECT event_id AS rid, round(sqrt(2 / (2 * pi() * 5325.0 * 4e-7 * pi() * value / 1000)), 6) AS depth, round(1.66 / sqrt(2 / (2 * pi() * 5325.0 * 4e-7 * pi() * value / 1000)), 6) AS induction FROM events WHERE value > 0")
def _(spark, d):
    s = F.col("value") / 1000
    return table(spark, d, "events").where("value > 0").select(F.col("event_id").alias("rid"), r6(C.skin_depth(s, F.lit(5325.0)), "depth"), r6(C.induction_number(s, F.lit(5325.0)), "induction"))


@query("T13_lin_ppm", "SELECT p_partkey AS id, round(1e6 * (2 * pi() * (p_size * 100.0)) * 4e-7 * pi() / 4 * (1.66 * 1.66 / sqrt(4 / (1.66 * 1.66) + 1) - 1.035 * 1.035 / sqrt(4 / (1.035 * 1.035) + 1)), 6) AS ppm FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(C.lin_ppm_per_sigma(F.col("p_size") * 100.0), "ppm"))


@query("T14_viscosity_decade", "SELECT event_id AS rid, round(2 * ln(10) / pi() * value, 6) AS drop FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("rid"), r6(C.viscosity_per_decade(F.col("value")), "drop"))


@query("T15_round_significant", "SELECT event_id AS rid, CASE WHEN value > 0 THEN round(round_even(value * pow(10, 1 - floor(log10(value))), 0) / pow(10, 1 - floor(log10(value))), 6) ELSE value END AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("rid"), F.when(F.col("value") > 0, F.round(C.significant(F.col("value")), 6)).otherwise(F.col("value")).alias("v"))


@query("T20_axis_time", f"WITH {READINGS} SELECT rid, line, round(t - min(t) OVER (PARTITION BY line), 6) AS since FROM readings")
def _(spark, d):
    from pyspark.sql import Window

    return readings(spark, d).select("rid", "line", r6(F.col("t") - F.min("t").over(Window.partitionBy("line")), "since"))


# Filters


@query("F1_drop_flagged", f"WITH {READINGS} SELECT rid, label, value FROM readings WHERE coalesce(status, 0) = 0")
def _(spark, d):
    return K.drop_flagged(readings(spark, d)).select("rid", "label", "value")


@query("F2_exclude_lines", f"WITH {READINGS} SELECT rid, line, value FROM readings WHERE line NOT IN ('3', '7')")
def _(spark, d):
    return K.exclude_lines(readings(spark, d), ["0", "3", "7"], base=("0",)).select("rid", "line", "value")


@query("F3_markers", f"WITH {READINGS}, m AS (SELECT rid, line, mark, lag(mark) OVER (PARTITION BY line ORDER BY rid) AS b FROM readings) SELECT rid, line, mark FROM m WHERE b IS NOT NULL AND mark <> b AND mark <> 0")
def _(spark, d):
    return W.markers(readings(spark, d)).where("is_marker").select("rid", "line", "mark")


@query("F4_clip", f"WITH {READINGS}, p AS (SELECT label, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM readings GROUP BY 1) SELECT rid, label, CASE WHEN value BETWEEN a AND b THEN value END AS value FROM readings JOIN p USING (label)")
def _(spark, d):
    return K.clipped(readings(spark, d), "value", 5, 95, ["label"]).select("rid", "label", "value")


@query("F5_no_fix", f"WITH {READINGS} SELECT rid, x, y FROM readings WHERE NOT (x = 0 AND y = 0)")
def _(spark, d):
    x, y = C.number("x"), C.number("y")
    return readings(spark, d).where(x.isNotNull() & y.isNotNull() & ~((x == 0) & (y == 0))).select("rid", "x", "y")


# Ordered operators


@query("W1_sample_distance", f"WITH {READINGS} SELECT rid, line, (row_number() OVER (PARTITION BY line ORDER BY rid) - 1) * 0.5::DOUBLE AS dist FROM readings")
def _(spark, d):
    return W.sample_distance(readings(spark, d), 0.5).select("rid", "line", "dist")


@query("W2_first_reading", f"WITH {POINTS} SELECT DISTINCT ON (label, line, dist) label, line, dist, rid, value FROM points ORDER BY label, line, dist, rid")
def _(spark, d):
    return W.first_readings(points(spark, d).select("label", "line", "dist", "rid", "value"), ["label", "line", "dist"])


@query("W3_path_distance", f"WITH {READINGS}, s AS (SELECT rid, line, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM readings WINDOW w AS (PARTITION BY line ORDER BY rid)) SELECT rid, line, round(sum(step) OVER (PARTITION BY line ORDER BY rid), 6) AS dist FROM s")
def _(spark, d):
    return W.path_distance(readings(spark, d)).select("rid", "line", r6("dist", "dist"))


@query("W4_projection_distance", f"WITH {READINGS} SELECT rid, round(0.6 * x + 0.8 * y - min(0.6 * x + 0.8 * y) OVER (), 6) AS dist FROM readings")
def _(spark, d):
    return W.projection_distance(readings(spark, d), (-0.6, -0.8)).select("rid", r6("dist", "dist"))


@query("W5_marker_distance", f"""WITH {READINGS}, m AS (SELECT rid, line, row_number() OVER w AS n, coalesce(mark <> lag(mark) OVER w AND mark <> 0, false) AS k FROM readings WINDOW w AS (PARTITION BY line ORDER BY rid)),
 s AS (SELECT line, n AS n0, row_number() OVER (PARTITION BY line ORDER BY n) - 1 AS k0, lead(n) OVER (PARTITION BY line ORDER BY n) AS n1 FROM m WHERE k)
 SELECT m.rid, m.line, round(min(10 * (k0 + CASE WHEN n1 IS NULL OR m.n = n0 THEN 0 ELSE (m.n - n0) / (n1 - n0) END)), 6) AS dist FROM m LEFT JOIN s ON s.line = m.line AND m.n >= n0 AND (m.n < n1 OR (n1 IS NULL AND m.n = n0)) GROUP BY 1, 2""")
def _(spark, d):
    return W.marker_distance(W.markers(readings(spark, d)), 10.0).select("rid", "line", r6("dist", "dist"))


_SIGMA = """d AS (SELECT label, line, rid, value, abs(value - lag(value) OVER w) AS d1, lead(value) OVER w - 2 * value + lag(value) OVER w AS d2 FROM readings WINDOW w AS (PARTITION BY label, line ORDER BY rid)),
 q AS (SELECT label, line, median(d2) AS m, count(d2) AS n, stddev_samp(d2) AS sd, min(d1) FILTER (d1 > 0) AS st FROM d GROUP BY ALL),
 z AS (SELECT q.label, q.line, CASE WHEN any_value(n) >= 3 THEN 1.4826 * median(abs(d2 - m)) / sqrt(6) END AS sigma, any_value(sd) AS sd, any_value(st) AS st FROM d JOIN q ON d.label = q.label AND d.line = q.line GROUP BY ALL)"""


@query("W7_despike", f"""WITH {READINGS}, {_SIGMA}, f AS (SELECT rid, label, line, value, quantile_cont(value, 0.5) OVER w AS mid, count(*) OVER w AS c FROM readings WINDOW w AS (PARTITION BY label, line ORDER BY rid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
 SELECT rid, f.label, f.line, CASE WHEN c = 5 AND abs(value - mid) > 4 * coalesce(nullif(sigma, 0), st / sqrt(12)) THEN NULL ELSE value END AS value FROM f JOIN z ON f.label = z.label AND f.line = z.line""")
def _(spark, d):
    return W.despiked(readings(spark, d), "value", ["label", "line"]).select("rid", "label", "line", "value")


@query("W8_intra_noise", f"WITH {READINGS}, {_SIGMA} SELECT label, line, round(CASE WHEN sigma = 0 THEN sd / sqrt(6) ELSE sigma END, 6) AS sigma FROM z")
def _(spark, d):
    return W.robust_noise(readings(spark, d), "value", ["label", "line"], "rid", fallback=True).select("label", "line", r6("sigma", "sigma"))


@query("W9_infer_lines_timegap", f"WITH {READINGS}, g AS (SELECT rid, CASE WHEN t - lag(t) OVER (ORDER BY rid) > 900 THEN 1 ELSE 0 END AS s FROM readings) SELECT rid, CAST(sum(s) OVER (ORDER BY rid) AS BIGINT) AS inferred FROM g")
def _(spark, d):
    return W.time_gap_lines(readings(spark, d), 900.0).select("rid", "inferred")


@query("W9_constant_runs", f"WITH {READINGS}, g AS (SELECT rid, line, CASE WHEN mark <> lag(mark) OVER (PARTITION BY line ORDER BY rid) THEN 1 ELSE 0 END AS s FROM readings) SELECT rid, line, CAST(sum(s) OVER (PARTITION BY line ORDER BY rid) AS BIGINT) AS run FROM g")
def _(spark, d):
    return W.constant_runs(readings(spark, d), "mark", by=["line"]).select("rid", "line", "run")


_OCC = "occ AS (SELECT line, avg(t) AS t, avg(value) AS value FROM readings WHERE line IN ('0', '5', '11') GROUP BY 1)"


@query("A5_occupations", f"WITH {READINGS}, {_OCC} SELECT line, round(t, 3) AS t, round(value, 6) AS value FROM occ")
def _(spark, d):
    return K.occupations(readings(spark, d), ["0", "5", "11"], values=("t", "value")).select("line", F.round("t", 3).alias("t"), r6("value", "value"))


_HOUR = "hours AS (SELECT rid, line, (t - 1704067200) / 3600 AS t, value FROM readings), occ AS (SELECT CAST(floor(t / 24) AS VARCHAR) AS occ, avg(t) AS t, avg(value) AS value FROM hours WHERE line = '0' GROUP BY 1)"


def _hours(spark, d):
    return readings(spark, d).withColumn("t", (F.col("t") - 1704067200) / 3600)


@query("W12_drift_linear", f"WITH {READINGS}, {_HOUR} SELECT round(regr_slope(value, t), 6) AS slope, round(regr_intercept(value, t), 6) AS intercept FROM occ")
def _(spark, d):
    occ = _hours(spark, d).where("line = '0'").groupBy(F.floor(F.col("t") / 24)).agg(F.avg("t").alias("t"), F.avg("value").alias("v"))
    return W.linear_drift(occ).select(r6("slope", "slope"), r6("intercept", "intercept"))


@query("W12_drift_piecewise", f"""WITH {READINGS}, {_HOUR}, r AS (SELECT rid, t FROM hours WHERE line <> '0')
 SELECT r.rid, round(CASE WHEN a.t IS NULL THEN b.value WHEN b.t IS NULL THEN a.value ELSE a.value + (b.value - a.value) * (r.t - a.t) / (b.t - a.t) END, 6) AS drift
 FROM r ASOF LEFT JOIN occ a ON r.t >= a.t ASOF LEFT JOIN occ b ON r.t < b.t""")
def _(spark, d):
    h = _hours(spark, d)
    occ = h.where("line = '0'").groupBy(F.floor(F.col("t") / 24)).agg(F.avg("t").alias("t"), F.avg("value").alias("v"))
    return W.piecewise_drift(h.where("line <> '0'"), occ).select("rid", r6("drift", "drift"))


@query("C3_drift", f"WITH {READINGS}, h AS (SELECT rid, line, (t - 1704067200) / 3600 AS t, value FROM readings), o AS (SELECT line, avg(t) AS t, avg(value) AS value FROM h WHERE line IN ('0', '5', '11') GROUP BY 1), f AS (SELECT regr_slope(value, t) AS s, min(t) AS t0 FROM o) SELECT rid, line, round(value - s * (t - t0), 5) AS corrected FROM h, f WHERE line NOT IN ('0', '5', '11')")
def _(spark, d):
    return K.without_drift(_hours(spark, d), ["0", "5", "11"]).select("rid", "line", F.round("corrected", 5).alias("corrected"))


@query("C1_height_linear", f"WITH {READINGS}, f AS (SELECT label, regr_slope(value, y) AS b, median(y) AS h FROM readings GROUP BY 1) SELECT rid, label, round(value - b * (y - h), 6) AS corrected FROM readings JOIN f USING (label)")
def _(spark, d):
    return K.height_line(readings(spark, d), "y", "value", ["label"]).select("rid", "label", r6("corrected", "corrected"))


@query("C2_temperature_linear", f"WITH {READINGS}, o AS (SELECT line, avg(y) AS c, avg(value) AS v FROM readings GROUP BY 1), f AS (SELECT regr_slope(v, c) AS s, avg(c) AS m FROM o) SELECT rid, round(value - s * (y - m), 6) AS corrected FROM readings, f")
def _(spark, d):
    r = readings(spark, d)
    occ = r.groupBy("line").agg(F.avg("y").alias("y"), F.avg("value").alias("value"))
    return K.without_temperature(r, occ, "y", "value").select("rid", r6("corrected", "corrected"))


@query("C4_offsets", f"WITH {READINGS} SELECT rid, round(value - CASE label WHEN 'click' THEN 2.5 WHEN 'view' THEN -1.25 ELSE 0 END, 6) AS value FROM readings")
def _(spark, d):
    return K.with_offsets(readings(spark, d), {"click": 2.5, "view": -1.25}).select("rid", r6("value", "value"))


# Aggregates


@query("A1_block_median", f"WITH {BLOCKS} SELECT iy, ix, round(x, 6) AS x, round(y, 6) AS y, round(v, 6) AS v, n FROM blocks")
def _(spark, d):
    return rounded(A.block_medians(area(spark, d), 5.0), "x", "y", "v")


@query("A2_block_line", f"WITH {AREA} SELECT CAST(floor(y / 5) AS BIGINT) AS iy, CAST(floor(x / 5) AS BIGINT) AS ix, arg_min(line, rid) AS line FROM area GROUP BY 1, 2")
def _(spark, d):
    return A.block_lines(area(spark, d), 5.0)


@query("A3_level_lines", f"WITH {AREA} SELECT rid, round(v + (median(v) OVER () - median(v) OVER (PARTITION BY line)), 6) AS levelled FROM area")
def _(spark, d):
    return A.levelled(area(spark, d)).select("rid", r6("levelled", "levelled"))


@query("A4_envelope", f"WITH {POINTS} SELECT label, dist, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS passes FROM points GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).withColumn("gi", (F.col("dist") * 2).cast("long"))
    return P.envelope(p, ["label"]).select("label", "dist", r6("mean", "mean"), r6("std", "std"), "passes")


@query("A6_summary_stats", f"WITH {READINGS} SELECT label, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.02), 6) AS p2, round(median(value), 6) AS median, round(quantile_cont(value, 0.98), 6) AS p98, max(value) AS max FROM readings GROUP BY 1")
def _(spark, d):
    return rounded(A.summary(readings(spark, d), "value", ["label"]), "mean", "std", "p2", "median", "p98")


@query("A7_data_summary", f"WITH {READINGS}, l AS (SELECT line, count(*) AS n, max(y) - min(y) AS span, min(t) AS a, max(t) AS b FROM readings GROUP BY 1) SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS readings, sum(span) AS length, round(max(b) - min(a), 3) AS duration, (SELECT count(DISTINCT label) FROM readings) AS channels FROM l")
def _(spark, d):
    r = readings(spark, d)
    per = r.groupBy("line").agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("span"), F.min("t").alias("a"), F.max("t").alias("b"), F.collect_set("label").alias("labels"))
    return per.agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("readings"), F.sum("span").alias("length"), F.round(F.max("b") - F.min("a"), 3).alias("duration"), F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).cast("long").alias("channels"))


@query("A8_median_spacing", f"WITH {POINTS}, g AS (SELECT lead(dist) OVER (PARTITION BY line ORDER BY dist) - dist AS gap FROM points) SELECT median(gap) AS spacing FROM g WHERE gap > 0")
def _(spark, d):
    return A.median_spacing(points(spark, d))


@query("A9_suggested_step", "SELECT event_id AS rid, round(arg_min(step, abs(ln(step / value))), 6) AS step, arg_min(step, abs(ln(step / value))) < 0.5 * value OR arg_min(step, abs(ln(step / value))) > 5 * value AS mismatch FROM (SELECT event_id, value, m * pow(10, floor(log10(value))) AS step FROM events, (VALUES (1), (2), (5), (10)) t(m) WHERE value > 0) GROUP BY event_id, value")
def _(spark, d):
    step = A.nice_step(F.col("value"))
    return table(spark, d, "events").where("value > 0").select(F.col("event_id").alias("rid"), r6(step, "step"), A.step_mismatch(step, F.col("value")).alias("mismatch"))


@query("A11_cell_size", f"WITH {AREA}, a AS (SELECT sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)) AS c FROM area) SELECT round(round_even(c * pow(10, 1 - floor(log10(c))), 0) / pow(10, 1 - floor(log10(c))), 9) AS cell FROM a")
def _(spark, d):
    return A.cell_size(area(spark, d)).select(F.round("cell", 9).alias("cell"))


@query("A12_principal_axis", f"WITH {AREA}, m AS (SELECT line, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM area GROUP BY 1), e AS (SELECT line, a, b, c, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS hi, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS lo FROM m) SELECT line, round(sqrt(lo / hi), 6) AS spread, round(abs(b) / sqrt(b * b + (hi - a) * (hi - a)), 6) AS abs_ax FROM e")
def _(spark, d):
    return A.principal_axis(area(spark, d), ["line"]).select("line", r6("spread", "spread"), r6(F.abs("ax"), "abs_ax"))


@query("A13_track_count", f"WITH {AREA}, p AS (SELECT line, median(y) AS pos FROM area GROUP BY 1), s AS (SELECT pos - lag(pos) OVER (ORDER BY pos) > 0.05 AS new FROM p) SELECT count(*) FILTER (new) + 1 AS tracks FROM s")
def _(spark, d):
    return A.track_count(area(spark, d), (1.0, 0.0), gap=0.05)


@query("A15_tracks", f"""WITH RECURSIVE {READINGS}, p AS (SELECT line, median(value) * 10 AS pos FROM readings GROUP BY 1), o AS (SELECT line, pos, row_number() OVER (ORDER BY pos, line) AS n FROM p),
 f AS (SELECT n, line, pos AS s, CAST(0 AS BIGINT) AS track FROM o WHERE n = 1 UNION ALL SELECT o.n, o.line, CASE WHEN o.pos - f.s > 1 THEN o.pos ELSE f.s END, f.track + CASE WHEN o.pos - f.s > 1 THEN 1 ELSE 0 END FROM f JOIN o ON o.n = f.n + 1) SELECT line, track FROM f""")
def _(spark, d):
    return A.tracks(readings(spark, d).groupBy("line").agg((A.median("value") * 10).alias("pos")))


@query("A20_height_levels", f"WITH {READINGS} SELECT round(round_even((y / 40) / 0.05, 0) * 0.05, 6) AS level, round(avg(value), 6) AS value FROM readings GROUP BY 1 HAVING avg(value) IS NOT NULL")
def _(spark, d):
    return rounded(A.height_levels(readings(spark, d).withColumn("h", F.col("y") / 40), "h", ["value"]), "level", "value")


@query("A21_anomaly", f"WITH {READINGS}, d AS (SELECT label, value, pow(x - 75, 2) + pow(y - 50, 2) AS r2 FROM readings) SELECT label, round(avg(value) FILTER (r2 <= 400) - median(value) FILTER (r2 > 400 AND r2 <= 1600), 6) AS anomaly, count(value) FILTER (r2 <= 400) AS n FROM d GROUP BY 1")
def _(spark, d):
    return rounded(A.anomaly(readings(spark, d), 75.0, 50.0, 20.0, ["label"], v="value"), "anomaly")


@query("A22_ratio_diagnostics", f"WITH {READINGS} SELECT label, round(median(y / value) FILTER (value > 0), 6) AS ratio, corr(y, value) < 0 AS opposed FROM readings GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return readings(spark, d).groupBy("label").agg(r6(A.median(F.when(F.col("value") > 0, F.col("y") / F.col("value"))), "ratio"), (F.corr("y", "value") < 0).alias("opposed"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


_EDGES = A.lag_edges(2.0, 50.0)


@query("A23_semivariogram", f"WITH {BLOCKS}, e AS (SELECT iy * 1000 + ix AS id, x, y, v FROM blocks), p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, 0.5 * pow(a.v - b.v, 2) AS g FROM e a JOIN e b ON a.id < b.id) SELECT CAST({' + '.join(f'(d >= {e!r})::INTEGER' for e in _EDGES[1:-1])} AS BIGINT) AS lag, round(avg(d), 6) AS distance, round(avg(g) / 1e6, 6) AS gamma, count(*) AS pairs FROM p WHERE d <= 50 GROUP BY 1 HAVING count(*) >= 30")
def _(spark, d):
    b = A.block_medians(area(spark, d), 5.0).select((F.col("iy") * 1000 + F.col("ix")).alias("id"), "x", "y", "v")
    return A.semivariogram(b, _EDGES).select("lag", r6("distance", "distance"), r6(F.col("gamma") / 1e6, "gamma"), "pairs")


@query("A24_line_extent", f"WITH {POINTS} SELECT label, line, min(dist) AS a, max(dist) AS b, max(dist) - min(dist) AS length FROM points WHERE value IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return points(spark, d).where("value is not null").groupBy("label", "line").agg(F.min("dist").alias("a"), F.max("dist").alias("b"), (F.max("dist") - F.min("dist")).alias("length"))


@query("A25_duplicates", f"WITH {POINTS}, g AS (SELECT label, line, dist, count(*) AS n FROM points GROUP BY ALL) SELECT label, CAST(sum(n - 1) AS BIGINT) AS repeated, count(DISTINCT line) FILTER (n > 1) AS lines FROM g GROUP BY 1")
def _(spark, d):
    g = points(spark, d).groupBy("label", "line", "dist").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("label").agg(F.sum(F.col("n") - 1).alias("repeated"), F.countDistinct(F.when(F.col("n") > 1, F.col("line"))).alias("lines"))


@query("A26_levels", f"WITH {AREA}, p AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM area) SELECT CAST(k AS INTEGER) AS k, round(a + (b - a) * k / 12, 4) AS level FROM p, range(13) t(k)")
def _(spark, d):
    return A.levels(area(spark, d), "v", 12).select("k", F.round("level", 4).alias("level"))


@query("A26_levels_log", f"WITH {AREA}, p AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM area) SELECT CAST(k AS INTEGER) AS k, round(a * pow(b / a, k / 8), 4) AS level FROM p, range(9) t(k)")
def _(spark, d):
    return A.levels(area(spark, d), "v", 8, scale="log").select("k", F.round("level", 4).alias("level"))


@query("A26_levels_equalised", f"WITH {AREA} SELECT CAST(k AS INTEGER) AS k, round((SELECT quantile_cont(v, [0.02, 0.26, 0.5, 0.74, 0.98]) FROM area)[k + 1], 4) AS level FROM range(5) t(k)")
def _(spark, d):
    return A.levels(area(spark, d), "v", 4, scale="equalised").select("k", F.round("level", 4).alias("level"))


@query("A27_marker_distances", f"WITH {READINGS}, m AS (SELECT (row_number() OVER w - 1) * 0.35::DOUBLE AS d, coalesce(mark <> lag(mark) OVER w AND mark <> 0, false) AS k FROM readings WINDOW w AS (PARTITION BY line ORDER BY rid)) SELECT DISTINCT round_even(d, 3) AS dist FROM m WHERE k")
def _(spark, d):
    m = W.markers(W.sample_distance(readings(spark, d), 0.35))
    return m.where("is_marker").select(F.bround("dist", 3).alias("dist")).distinct()


@query("A28_histogram", f"WITH {AREA}, m AS (SELECT min(v) AS a, max(v) AS b FROM area) SELECT CAST(least(floor((v - a) / ((b - a) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM area, m GROUP BY 1")
def _(spark, d):
    return A.histogram(area(spark, d), "v")


# Profiles

_H = 4.0
_GRID = f"""first AS (SELECT DISTINCT ON (label, line, dist) label, line, dist, rid, value FROM points ORDER BY label, line, dist, rid),
 g AS (SELECT label, min(dist) AS a, max(dist) AS b, CAST(round_even((max(dist) - min(dist)) / {_H}, 0) AS BIGINT) + 1 AS n FROM points GROUP BY 1),
 nodes AS (SELECT label, k AS gi, CASE WHEN k = n - 1 THEN b ELSE a + k * ((b - a) / (n - 1)) END AS d FROM g, LATERAL (SELECT unnest(range(n)) AS k)),
 traces AS (SELECT label, line, min(dist) AS a, max(dist) AS b FROM first GROUP BY 1, 2 HAVING count(*) > 1),
 want AS (SELECT nodes.label, line, gi, d FROM nodes JOIN traces ON nodes.label = traces.label AND d BETWEEN traces.a AND traces.b),
 two AS (SELECT want.label, want.line, gi, d, p.dist AS d0, p.value AS v0, q.dist AS d1, q.value AS v1 FROM want ASOF JOIN first p ON want.label = p.label AND want.line = p.line AND d >= p.dist ASOF JOIN first q ON want.label = q.label AND want.line = q.line AND d <= q.dist)"""
_LINEAR = _GRID + ", prof AS (SELECT label, line, gi, d, CASE WHEN d1 = d0 THEN v0 ELSE v0 + (v1 - v0) * (d - d0) / (d1 - d0) END AS value FROM two)"


@query("I0_grid", f"WITH {POINTS}, {_GRID} SELECT label, gi, round(d, 6) AS dist FROM nodes")
def _(spark, d):
    g = P.grid(points(spark, d), _H, ["label"])
    g = g.withColumn("gi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return g.select("label", "gi", r6(F.when(F.col("gi") == F.col("n") - 1, F.col("dmax")).otherwise(F.col("dmin") + F.col("gi") * F.col("h")), "dist"))


@query("I1_linear", f"WITH {POINTS}, {_LINEAR} SELECT label, line, gi, round(d, 6) AS dist, round(value, 6) AS value FROM prof")
def _(spark, d):
    return rounded(P.resampled(points(spark, d), _H, ["label"]), "dist", "value")


@query("I3_nearest", f"WITH {POINTS}, {_GRID} SELECT label, line, gi, round(d, 6) AS dist, round(CASE WHEN d - d0 <= d1 - d THEN v0 ELSE v1 END, 6) AS value FROM two WHERE abs((d - d0) - (d1 - d)) > 1e-9 OR d0 = d1")
def _(spark, d):
    # Exact midpoints, which rounding may decide either way in another engine, are left out of the comparison alone.
    p = points(spark, d)
    lin = P.resampled(p, _H, ["label"], kind="nearest")
    s = P.segments(p, ["label"], "line").select("label", "line", "d0", "d1")
    mid = lin.join(s, ["label", "line"]).where("dist > d0 and dist < d1 and abs((dist - d0) - (d1 - dist)) <= 1e-9").select("label", "line", "gi")
    return rounded(lin.join(mid, ["label", "line", "gi"], "left_anti"), "dist", "value")


@query("I2_pchip")
def _(spark, d):
    return rounded(P.resampled(points(spark, d), _H, ["label"], kind="pchip"), "dist", "value")


_SCORE = """node AS (SELECT label, gi, var_samp(value) AS s2, avg(value) AS m, count(*) AS k FROM prof GROUP BY 1, 2),
 noise AS (SELECT label, sqrt(avg(s2)) AS sigma FROM node WHERE k > 1 GROUP BY 1),
 power AS (SELECT node.label, any_value(sigma) AS sigma, var_samp(m) - any_value(sigma) * any_value(sigma) * avg(1 / k) AS ps FROM node JOIN noise ON node.label = noise.label WHERE k > 1 GROUP BY 1),
 num AS (SELECT label, count(DISTINCT line) AS traces FROM prof GROUP BY 1),
 scores AS (SELECT power.label, sigma AS mean_std, CASE WHEN ps > 0 THEN sqrt(ps) ELSE 0 END AS signal_std, CASE WHEN sigma >= 1e-8 THEN CASE WHEN ps > 0 THEN ps / (sigma * sigma) ELSE 0 END END AS snr, CASE WHEN sigma >= 1e-8 AND ps > 0 THEN 10 * log10(ps / (sigma * sigma)) END AS score, traces FROM power JOIN num ON power.label = num.label)"""


@query("I5_profile_score", f"WITH {POINTS}, {_LINEAR}, {_SCORE} SELECT label, round(mean_std, 6) AS mean_std, round(signal_std, 6) AS signal_std, round(snr, 6) AS snr, round(score, 6) AS score, 'between passes' AS noise_method, traces AS n_traces, traces AS passes FROM scores")
def _(spark, d):
    return rounded(P.scored(points(spark, d), _H, ["label"]), "mean_std", "signal_std", "snr", "score")


@query("I5_single_pass_score")
def _(spark, d):
    # Every line is its own track, so noise is measured within passes.
    return P.scored(points(spark, d).withColumn("track", F.col("line")), _H, ["label"], track="track")


@query("I5_track_score")
def _(spark, d):
    return P.scored(points(spark, d).withColumn("track", F.col("line").cast("int") % 4), _H, ["label"], track="track")


@query("A16_pass_noise", f"WITH {POINTS}, {_LINEAR}, v AS (SELECT label, line::INTEGER % 4 AS track, gi, var_samp(value) AS s2 FROM prof GROUP BY ALL HAVING count(*) > 1) SELECT label, round(sqrt(avg(s2)), 6) AS sigma FROM v GROUP BY 1")
def _(spark, d):
    p = P.resampled(points(spark, d), _H, ["label"]).withColumn("track", F.col("line").cast("int") % 4)
    return P.pass_noise(p, ["label"], ["track"]).select("label", r6("sigma", "sigma"))


@query("W10_rank_scores", f"WITH {POINTS}, {_LINEAR}, {_SCORE} SELECT label, row_number() OVER (ORDER BY score DESC NULLS LAST, label) AS rank FROM scores")
def _(spark, d):
    return W.ranked(P.scored(points(spark, d), _H, ["label"])).select("label", "rank")


@query("I7_pseudosection", f"""WITH {POINTS}, mean AS (SELECT label, floor(dist) AS dist, avg(value) AS value FROM points GROUP BY 1, 2), st AS (SELECT label, lead(dist) OVER (PARTITION BY label ORDER BY dist) - dist AS gap FROM mean),
 c AS (SELECT (SELECT max(a) FROM (SELECT min(dist) AS a FROM mean GROUP BY label)) AS lo, (SELECT min(b) FROM (SELECT max(dist) AS b FROM mean GROUP BY label)) AS hi, (SELECT min(s) FROM (SELECT median(gap) AS s FROM st WHERE gap > 0 GROUP BY label)) AS step),
 nodes AS (SELECT k AS gi, CASE WHEN k = n - 1 THEN hi ELSE lo + k * ((hi - lo) / (n - 1)) END AS d FROM (SELECT lo, hi, CAST(round_even((hi - lo) / step, 0) AS BIGINT) + 1 AS n FROM c), LATERAL (SELECT unnest(range(n)) AS k)),
 want AS (SELECT label, gi, d FROM nodes, (SELECT DISTINCT label FROM mean))
 SELECT want.label, gi, round(d, 6) AS dist, round(CASE WHEN q.dist = p.dist THEN p.value ELSE p.value + (q.value - p.value) * (d - p.dist) / (q.dist - p.dist) END, 6) AS value FROM want ASOF JOIN mean p ON want.label = p.label AND d >= p.dist ASOF JOIN mean q ON want.label = q.label AND d <= q.dist""")
def _(spark, d):
    m = points(spark, d).groupBy("label", F.floor("dist").cast("double").alias("dist")).agg(F.avg("value").alias("value"))
    return rounded(P.pseudosection(m), "dist", "value")
