"""Queries over spatial joins, grids, correlations and soil tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import aggregates as A
from furrow.operators import corrections as K
from furrow.operators import profiles as P
from furrow.operators import soil as Z
from furrow.operators import spatial as S
from furrow.plans.core import _LINEAR
from furrow.plans.registry import query, r6, rounded
from furrow.plans.views import AREA, BLOCKS, POINTS, area, points, table

SAMPLES = "samples AS (SELECT o_orderkey AS id, (o_custkey % 1000) / 10 AS x, (o_orderkey % 500) / 10 AS y, o_totalprice AS ref FROM orders)"
#: Items within 1.5 of each order. Items stand at whole numbers, so only those of the sixteen places around an order are looked at.
NEAR = "near AS (SELECT samples.id, ref, v FROM samples, (SELECT unnest(range(-1, 3)) AS dx) a, (SELECT unnest(range(-1, 3)) AS dy) b JOIN area ON area.x = floor(samples.x) + dx AND area.y = floor(samples.y) + dy WHERE pow(samples.x - area.x, 2) + pow(samples.y - area.y, 2) <= 2.25)"


def _samples(spark, d):
    """All orders as reference values on the field."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % 1000) / 10).alias("x"), ((F.col("o_orderkey") % 500) / 10).alias("y"), F.col("o_totalprice").alias("ref"))


def _blocks(spark, d):
    return A.block_medians(area(spark, d), 5.0).select((F.col("iy") * 1000 + F.col("ix")).alias("id"), "x", "y", "v")


SPEC = (0.0, 0.0, 5.0, 20, 10)
NODES = "nodes AS (SELECT i AS iy, j AS ix, CAST((j + 0.5) * 5 AS DOUBLE) AS x, CAST((i + 0.5) * 5 AS DOUBLE) AS y FROM range(10) a(i), range(20) b(j))"
IDW = f"{NODES}, near AS (SELECT iy, ix, nodes.x, nodes.y, v, pow(b.x - nodes.x, 2) + pow(b.y - nodes.y, 2) AS d2, row_number() OVER (PARTITION BY nodes.iy, nodes.ix ORDER BY pow(b.x - nodes.x, 2) + pow(b.y - nodes.y, 2), id) AS k FROM nodes, (SELECT iy * 1000 + ix AS id, x, y, v FROM blocks) b), grid AS (SELECT iy, ix, x, y, CASE WHEN min(d2) <= 1e-24 THEN arg_min(v, d2) ELSE sum(v / CASE WHEN d2 > 1e-24 THEN d2 ELSE 1 END) / sum(1 / CASE WHEN d2 > 1e-24 THEN d2 ELSE 1 END) END AS z, sqrt(min(d2)) AS d FROM near WHERE k <= 64 GROUP BY iy, ix, x, y)"


@query("J1_radius_median", f"WITH {AREA}, {SAMPLES}, {NEAR} SELECT id, round(median(v), 6) AS value, count(*) AS n FROM near GROUP BY 1")
def _(spark, d):
    return rounded(S.radius_medians(_samples(spark, d), area(spark, d), 1.5), "value")


@query("J2_node_distance", f"WITH {BLOCKS}, {IDW} SELECT iy, ix, round(d, 6) AS d FROM grid")
def _(spark, d):
    return S.node_distance(S.grid_nodes(SPEC, spark), _blocks(spark, d), ["iy", "ix"]).select("iy", "ix", r6("d", "d"))


@query("J3_k_nearest", f"WITH {BLOCKS}, {IDW} SELECT iy, ix, round(sum(sqrt(d2)), 6) AS total, count(*) AS n FROM near WHERE k <= 8 GROUP BY 1, 2")
def _(spark, d):
    near = S.k_nearest(S.grid_nodes(SPEC, spark), _blocks(spark, d), 8, ["iy", "ix"])
    return near.select("iy", "ix", r6(F.aggregate("near", F.lit(0.0), lambda a, p: a + F.sqrt(p["d2"])), "total"), F.size("near").cast("long").alias("n"))


@query("J4_edge_match", f"WITH {AREA}, b AS (SELECT rid, x AS x0, x + 0.2 AS x, y, v FROM area WHERE year = 1996), a AS (SELECT rid, x, y, v FROM area WHERE year = 1995), n AS (SELECT DISTINCT ON (b.rid) b.rid, a.v - b.v AS diff FROM b, (SELECT unnest(range(-2, 3)) AS dx) c, (SELECT unnest(range(-2, 3)) AS dy) e JOIN a ON a.x = b.x0 + dx AND a.y = b.y + dy AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 2.25 ORDER BY b.rid, pow(a.x - b.x, 2) + pow(a.y - b.y, 2), a.rid) SELECT CASE WHEN count(*) >= 5 THEN round(median(diff), 6) ELSE 0 END AS \"offset\", count(*) AS pairs FROM n")
def _(spark, d):
    p = area(spark, d).select("rid", "x", "y", "v", "year")
    a, b = p.where("year = 1995").drop("year"), p.where("year = 1996").drop("year").withColumn("x", F.col("x") + 0.2)
    return rounded(S.edge_offset(a, b, 1.5), "offset")


@query("J6_mean_profiles", f"WITH {POINTS}, m AS (SELECT label, round_even(dist, 9) AS dist, avg(value) AS v FROM points GROUP BY 1, 2) SELECT dist, round(max(v) FILTER (label = 'click'), 6) AS click, round(max(v) FILTER (label = 'error'), 6) AS error, round(max(v) FILTER (label = 'view'), 6) AS \"view\" FROM m GROUP BY 1")
def _(spark, d):
    m = points(spark, d).groupBy(F.bround("dist", 9).alias("dist")).pivot("label", ["click", "error", "view"]).agg(F.avg("value"))
    return rounded(m, "click", "error", "view").where("true")


@query("J7_pairs", f"WITH {POINTS}, {_LINEAR} SELECT a.label AS a, b.label AS b, round(corr(a.value, b.value), 6) AS r, count(*) AS n FROM prof a JOIN prof b ON a.gi = b.gi AND a.line = b.line AND a.label < b.label GROUP BY 1, 2 HAVING count(*) >= 10")
def _(spark, d):
    p = P.resampled(points(spark, d), 4.0, ["label"]).select("label", "line", "gi", "value")
    q = p.withColumnsRenamed({"label": "b", "value": "v2"})
    both = p.join(q, ["line", "gi"]).where(F.col("label") < F.col("b"))
    return both.groupBy(F.col("label").alias("a"), "b").agg(r6(F.corr("value", "v2"), "r"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("J9_nearest_station", f"WITH {POINTS}, s AS (SELECT DISTINCT dist FROM points WHERE label = 'view'), t AS (SELECT k * 24 AS target FROM range(30) r(k)) SELECT DISTINCT arg_min(dist, abs(dist - target) * 1e6 + dist) AS dist FROM s, t GROUP BY target")
def _(spark, d):
    s = points(spark, d).where("label = 'view'").select("dist").distinct().agg(F.array_sort(F.collect_set("dist")).alias("all"))  # the stations of one transect
    t = s.select("all", F.explode(F.array(*[F.lit(24.0 * k) for k in range(30)])).alias("target"))
    return t.select(F.array_min(F.transform("all", lambda x: F.struct(F.abs(x - F.col("target")).alias("far"), x.alias("dist"))))["dist"].alias("dist")).distinct()


@query("J10_membership", f"WITH {AREA} SELECT DISTINCT line FROM area WHERE year = 1995 INTERSECT SELECT DISTINCT line FROM area WHERE year = 1996")
def _(spark, d):
    p = area(spark, d)
    return p.where("year = 1995").select("line").intersect(p.where("year = 1996").select("line"))


@query("C5_reference_fit", f"WITH {AREA}, {SAMPLES}, {NEAR}, m AS (SELECT id, any_value(ref) AS ref, median(v) AS v FROM near GROUP BY 1) SELECT round(regr_slope(ref, v), 6) AS gain, round(regr_intercept(ref, v), 3) AS \"offset\", round(pow(corr(ref, v), 2), 6) AS r2, count(*) AS pairs FROM m")
def _(spark, d):
    return K.reference_fit(_samples(spark, d), area(spark, d), 1.5).select(r6("gain", "gain"), F.round("offset", 3).alias("offset"), r6("r2", "r2"), "pairs")


@query("W11_shift")
def _(spark, d):
    from furrow.plans.views import readings

    r = readings(spark, d).withColumn("t", F.col("t") - 1704067200)
    return K.shifted(r, 30.0).select("rid", "line", "x", "y")


@query("G1_nodes", f"WITH {NODES} SELECT iy, ix, x, y FROM nodes")
def _(spark, d):
    return S.grid_nodes(SPEC, spark)


@query("G6_idw", f"WITH {BLOCKS}, {IDW} SELECT iy, ix, round(z, 4) AS z FROM grid")
def _(spark, d):
    return S.idw(S.grid_nodes(SPEC, spark), _blocks(spark, d), ["iy", "ix"]).select("iy", "ix", F.round("z", 4).alias("z"))


@query("F6_blank_far", f"WITH {BLOCKS}, {IDW} SELECT iy, ix, CASE WHEN d <= 0.6 THEN round(z, 4) END AS z FROM grid")
def _(spark, d):
    b = _blocks(spark, d)
    return S.blanked(S.idw(S.grid_nodes(SPEC, spark), b, ["iy", "ix"]), b, 0.6).select("iy", "ix", F.round("z", 4).alias("z"))


@query("G8_natural_neighbour", f"""WITH {BLOCKS}, {NODES}, r AS (SELECT i AS jy, j AS jx, (j + 0.5) * 1.25 AS x, (i + 0.5) * 1.25 AS y FROM range(40) a(i), range(80) b(j)),
 n AS (SELECT DISTINCT ON (jy, jx) jy, jx, r.x, r.y, pow(b.x - r.x, 2) + pow(b.y - r.y, 2) AS d2, v FROM r, (SELECT iy * 1000 + ix AS id, x, y, v FROM blocks) b ORDER BY jy, jx, pow(b.x - r.x, 2) + pow(b.y - r.y, 2), id)
 SELECT nodes.iy, nodes.ix, round(avg(v), 4) AS z FROM nodes JOIN n ON pow(nodes.x - n.x, 2) + pow(nodes.y - n.y, 2) <= n.d2 GROUP BY 1, 2""")
def _(spark, d):
    return S.natural_neighbours(SPEC, _blocks(spark, d), spark).select(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.round("z", 4).alias("z"))


_DIFF = "g AS (SELECT year, CAST(floor(y / 5) AS BIGINT) AS iy, CAST(floor(x / 5) AS BIGINT) AS ix, median(v) AS z FROM area WHERE year IN (1995, 1996) GROUP BY ALL)"


@query("G13_difference", f"WITH {AREA}, {_DIFF} SELECT iy, ix, round(b.z - a.z, 4) AS z FROM g a JOIN g b USING (iy, ix) WHERE a.year = 1995 AND b.year = 1996")
def _(spark, d):
    g = A.block_medians(area(spark, d).where("year in (1995, 1996)"), 5.0, by=["year"])
    a, b = g.where("year = 1995").select("iy", "ix", F.col("v").alias("a")), g.where("year = 1996").select("iy", "ix", F.col("v").alias("b"))
    return a.join(b, ["iy", "ix"]).select("iy", "ix", F.round(F.col("b") - F.col("a"), 4).alias("z"))


@query("G15_low_pass", f"WITH {BLOCKS}, {NODES}, k AS (SELECT nodes.iy, nodes.ix, least(greatest(nodes.iy + dy, 0), 9) AS jy, least(greatest(nodes.ix + dx, 0), 19) AS jx FROM nodes, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)) SELECT k.iy, k.ix, round(avg(v), 4) AS smooth FROM k LEFT JOIN blocks ON blocks.iy = jy AND blocks.ix = jx GROUP BY 1, 2")
def _(spark, d):
    b = A.block_medians(area(spark, d), 5.0).select("iy", "ix", F.col("v").alias("z"))
    g = S.grid_nodes(SPEC, spark).select("iy", "ix").join(b, ["iy", "ix"], "left")
    return S.low_pass(g, 3, 20, 10).select("iy", "ix", F.round("smooth", 4).alias("smooth"))


@query("G18_merge", f"""WITH {AREA}, a AS (SELECT rid, x, y, v, '0:' || line AS line FROM area WHERE year = 1995), b AS (SELECT rid, x, y, v - 100 AS v, '1:' || line AS line FROM area WHERE year = 1996),
 n AS (SELECT DISTINCT ON (b.line, b.rid) a.v - b.v AS diff FROM b, (SELECT unnest(range(-2, 3)) AS dx) c, (SELECT unnest(range(-2, 3)) AS dy) e JOIN a ON a.x = b.x + dx AND a.y = b.y + dy AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 2.25 ORDER BY b.line, b.rid, pow(a.x - b.x, 2) + pow(a.y - b.y, 2), a.line, a.rid),
 o AS (SELECT CASE WHEN count(*) >= 5 THEN median(diff) ELSE 0 END AS offset_1 FROM n), m AS (SELECT line, v FROM a UNION ALL SELECT line, v + offset_1 FROM b, o) SELECT line, count(*) AS n, round(sum(v), 2) AS total FROM m GROUP BY 1""")
def _(spark, d):
    p = area(spark, d)
    out, _ = S.merged([p.where("year = 1995"), p.where("year = 1996").withColumn("v", F.col("v") - 100.0)], 1.5)
    return out.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("I8_bilinear", f"WITH {BLOCKS}, p AS (SELECT o_orderkey AS id, (o_custkey % 1000) / 10.0 / 5 - 0.5 AS u, (o_orderkey % 500) / 10.0 / 5 - 0.5 AS w FROM orders), q AS (SELECT id, u, w, least(floor(u), 18)::BIGINT AS i, least(floor(w), 8)::BIGINT AS j FROM p), s AS (SELECT q.id, any_value(u) AS u, any_value(w) AS w, count(v) AS c, sum(v * (CASE dx WHEN 1 THEN u - i ELSE 1 - (u - i) END) * (CASE dy WHEN 1 THEN w - j ELSE 1 - (w - j) END)) AS z FROM q, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) LEFT JOIN blocks ON blocks.ix = i + dx AND blocks.iy = j + dy GROUP BY 1) SELECT id, CASE WHEN u BETWEEN 0 AND 19 AND w BETWEEN 0 AND 9 AND c = 4 THEN round(z, 6) END AS z FROM s")
def _(spark, d):
    g = A.block_medians(area(spark, d), 5.0).select("iy", "ix", F.col("v").alias("z"))
    return S.bilinear(g, SPEC, _samples(spark, d).select("id", "x", "y")).select("id", F.round("z", 6).alias("z"))


@query("K4_grid_rows", f"WITH {BLOCKS}, {IDW} SELECT x, y, round(z, 4) AS value FROM grid WHERE d <= 0.6")
def _(spark, d):
    b = _blocks(spark, d)
    return S.blanked(S.idw(S.grid_nodes(SPEC, spark), b, ["iy", "ix"]), b, 0.6).where("z is not null").select("x", "y", F.round("z", 4).alias("value"))


@query("K5_asc_lines", f"WITH {BLOCKS}, {IDW} SELECT iy, string_agg(CAST(CAST(round(z) AS BIGINT) AS VARCHAR), ' ' ORDER BY ix) AS line FROM grid GROUP BY 1")
def _(spark, d):
    from furrow.sources.rasters import asc_lines

    g = S.idw(S.grid_nodes(SPEC, spark), _blocks(spark, d), ["iy", "ix"]).withColumn("z", F.round("z").cast("bigint"))
    return asc_lines(g)


FEATURES = "f AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)"


def _features(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[e[k].cast("double").alias(n) for k, n in enumerate("abc")], (F.col("vec_id") % 25).cast("double").alias("x"), F.floor(F.col("vec_id") / 25).cast("double").alias("y"))


@query("Z2_standardise", f"WITH {FEATURES} SELECT id, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS a, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) AS b FROM f")
def _(spark, d):
    return Z.standardised(_features(spark, d), ["a", "b"]).select("id", r6("a", "a"), r6("b", "b"))


@query("Z2_robust", f"WITH {FEATURES}, p AS (SELECT quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi FROM f), k AS (SELECT id, least(greatest(a, lo), hi) AS a FROM f, p) SELECT id, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS a FROM k")
def _(spark, d):
    return Z.standardised(_features(spark, d), ["a"], robust=True).select("id", r6("a", "a"))


@query("A19_correlation", f"WITH {FEATURES} SELECT round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(b, c), 6) AS bc FROM f")
def _(spark, d):
    return _features(spark, d).agg(*[r6(F.corr(p[0], p[1]), p) for p in ("ab", "ac", "bc")])


@query("Z3_principal_scores")
def _(spark, d):
    return Z.principal_scores(_features(spark, d), ["a", "b", "c"]).select("id", "pc1", "pc2")


@query("Z5_sampling_design")
def _(spark, d):
    return spark.createDataFrame(Z.sampling_design(Z.principal_scores(_features(spark, d), ["a", "b", "c"]), 12))


_SOIL = "soil AS (SELECT o_orderkey AS id, ln(o_totalprice) AS y, ln(1 + o_custkey) AS x FROM orders)"


@query("Z6_ols_1ch", f"WITH {_SOIL} SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM soil")
def _(spark, d):
    s = table(spark, d, "orders").select((1 + F.col("o_custkey")).alias("ec"), F.col("o_totalprice").alias("clay"))
    m = Z.property_fit(s, ["ec"], "clay")
    return spark.createDataFrame([(round(m["coef"][0], 6), round(m["coef"][1], 6), round(m["r2"], 6), m["n"])], "intercept double, slope double, r2 double, n long")


@query("Z7_predict", "SELECT p_partkey AS id, round(exp(0.5 + 0.25 * ln(p_retailprice)), 6) AS predicted FROM part WHERE p_retailprice > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_retailprice <= 0")
def _(spark, d):
    m = {"terms": ["1", "p_retailprice"], "coef": [0.5, 0.25], "logs": True}
    return Z.predicted(table(spark, d, "part"), m).select(F.col("p_partkey").alias("id"), r6("predicted", "predicted"))


@query("Z8_fuzzy_zones")
def _(spark, d):
    out, _ = Z.fuzzy_zones(Z.standardised(_features(spark, d), ["a", "b"]), ["a", "b"], 3, most=60)
    return out.select("id", "zone", r6("u1", "u1"), r6("u2", "u2"), r6("u3", "u3"))


@query("Z9_fpi_mpe", "WITH u AS (SELECT (l_quantity / 100) AS a, 1 - l_quantity / 100 AS b FROM lineitem) SELECT round(2 * (1 - sum(a * a + b * b) / count(*)), 6) AS fpi, round(-sum(a * ln(a) + b * ln(b)) / (count(*) * ln(2)), 6) AS mpe FROM u")
def _(spark, d):
    u = table(spark, d, "lineitem").select((F.col("l_quantity") / 100).alias("a"), (1 - F.col("l_quantity") / 100).alias("b"))
    return rounded(Z.zone_indices(u, ["a", "b"]), "fpi", "mpe")


@query("A10_nn_spacing", f"WITH {BLOCKS}, p AS (SELECT DISTINCT x, y FROM blocks), n AS (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y GROUP BY a.x, a.y) SELECT round(median(d), 6) AS spacing FROM n")
def _(spark, d):
    p = _blocks(spark, d).select("x", "y").distinct().withColumn("id", F.xxhash64("x", "y")).withColumn("v", F.lit(0.0))
    near = S.k_nearest(p.select("id", "x", "y"), p, 2, ["id"])
    return near.select(F.sqrt(F.col("near")[1]["d2"]).alias("d")).agg(r6(A.median("d"), "spacing"))
