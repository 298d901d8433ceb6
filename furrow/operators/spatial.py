"""Joins in space, by cells: an equi-join on cell numbers, then the exact distance. Nothing is compared with all of the other side."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.neighbours import Cells

#: Rows that a small side may have to be broadcast.
SMALL = 50_000


def _cells(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(f"{prefix}x") / size).cast("long")).withColumn("_cy", F.floor(F.col(f"{prefix}y") / size).cast("long"))


def _spread(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row in its own cell and all cells within reach."""
    near = [F.lit(k) for k in range(-reach, reach + 1)]
    df = df.withColumn("_dx", F.explode(F.array(*near))).withColumn("_dy", F.explode(F.array(*near)))
    return df.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")


def within(points: DataFrame, readings: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """(points' columns as they are, readings' as r_...), for all pairs at most radius apart (less, if strict), and their d2. The points are spread
    over nine cells, so the readings, of which there may be very many, are shuffled once and not copied."""
    r = _cells(readings.select(*[F.col(c).alias(f"r_{c}") for c in readings.columns]), radius, "r_")
    p = _spread(_cells(points, radius))
    d2 = F.pow(F.col("x") - F.col("r_x"), 2) + F.pow(F.col("y") - F.col("r_y"), 2)
    both = p.join(r, ["_cx", "_cy"]).withColumn("d2", d2).drop("_cx", "_cy")
    return both.where(F.col("d2") < radius**2 if strict else F.col("d2") <= radius**2)


#: Rows of a square that one task compares in memory; squares with more are cut smaller, and then go through a join and an aggregate, which spill.
SQUARE_ROWS = 2_000_000
#: Sides of the squares in radii, the smaller ones for crowded squares of the larger.
SIDES = (8, 2)
#: Readings that a task packs by squares at once.
PACKED_ROWS = 200_000


def _pack_squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Readings (_sx, _sy, x, y, v), many to a row: those of a square, sorted by place, as compressed byte planes. Few and small rows are what is shuffled and sorted."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in ("x", "y", "_sx", "_sy")])]
        sx, sy, values = rows["_sx"].to_numpy(), rows["_sy"].to_numpy(), rows[["x", "y", "v"]].to_numpy(float)
        start = np.flatnonzero(np.r_[True, (np.diff(sx) != 0) | (np.diff(sy) != 0)])
        bodies = [zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values[a:z].T).view(np.uint8).reshape(-1, 8).T).tobytes(), 1) for a, z in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True)]
        return pd.DataFrame({"_sx": sx[start], "_sy": sy[start], "_body": bodies})

    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= PACKED_ROWS:
            yield packed(pd.concat(held))
            held = []
    if sum(map(len, held)):
        yield packed(pd.concat(held))


def _unpacked(bodies: list[bytes]) -> pd.DataFrame:
    """The readings (x, y, v) of packed rows."""
    parts = [np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.float64).reshape(3, -1) for b in bodies]
    values = np.concatenate([*parts, np.zeros((3, 0))], axis=1)
    return pd.DataFrame({"x": values[0], "y": values[1], "v": values[2]})


def _set_medians(left: pd.DataFrame, right: pd.DataFrame, radius: float) -> pd.DataFrame:
    """For the points (_key, x, y), the median and number of the readings (x, y, v) within the radius. Readings at one place are found once, and points with the same places
    around them share their median."""
    out: dict[str, object] = {"_key": left["_key"], "value": None, "n": 0}
    if not len(left) or not len(right):
        return pd.DataFrame(out)[:0]
    v = right["v"].to_numpy(float)
    order = np.lexsort((right["x"].to_numpy(float), right["y"].to_numpy(float)))
    x, y, v = right["x"].to_numpy(float)[order], right["y"].to_numpy(float)[order], v[order]
    start = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)])
    end, x, y = np.r_[start[1:], len(v)], x[start], y[start]
    at, which = np.unique(np.c_[left["x"].to_numpy(float), left["y"].to_numpy(float)], axis=0, return_inverse=True)
    y0 = min(y.min(), at[:, 1].min())
    row, own = np.floor((y - y0) / radius).astype(np.int64), np.floor((at[:, 1] - y0) / radius).astype(np.int64)
    order = np.lexsort((x, row))
    x, y, row, start, end = x[order], y[order], row[order], start[order], end[order]
    bands = {k: (int(np.searchsorted(row, k)), int(np.searchsorted(row, k + 1))) for k in np.unique(np.concatenate([own - 1, own, own + 1])).tolist()}
    known: dict[bytes, tuple[float, int]] = {}
    value, n = np.full(len(at), np.nan), np.zeros(len(at), np.int64)
    for i, (k, (qx, qy)) in enumerate(zip(own.tolist(), at.tolist(), strict=True)):
        near = []
        for q in (k - 1, k, k + 1):
            a, z = bands[q]
            if a < z:
                lo, hi = a + np.searchsorted(x[a:z], qx - radius * 1.001), a + np.searchsorted(x[a:z], qx + radius * 1.001, "right")
                near.append(lo + np.flatnonzero((x[lo:hi] - qx) ** 2 + (y[lo:hi] - qy) ** 2 <= radius**2))
        places = np.concatenate(near) if near else np.zeros(0, np.int64)
        if not len(places):
            continue
        name = places.tobytes()
        if name not in known:
            got = np.concatenate([v[a:z] for a, z in zip(start[places].tolist(), end[places].tolist(), strict=True)])
            present = got[~np.isnan(got)]
            known[name] = float(np.median(present)) if len(present) else math.nan, len(got)
        value[i], n[i] = known[name]
    which = which.ravel()
    hit = n[which] > 0
    return pd.DataFrame({"_key": left["_key"].to_numpy()[hit], "value": value[which][hit], "n": n[which][hit]})


def radius_medians(points: DataFrame, readings: DataFrame, radius: float, key: str = "id", v: str = "v", most: int = SQUARE_ROWS) -> DataFrame:
    """Per point, the median of the readings within the radius and their number; points without any aren't there.

    The field is cut into squares of eight radii. A square's points and all readings it may need, those up to a radius beyond its sides and many to a row, meet in one
    task where they are few enough. Crowded squares are cut into squares of two radii. What is crowded even then is joined: each place with points, once, with the
    different readings around. One small action counts the rows of squares."""
    spark, kind = points.sparkSession, points.schema[key].dataType.simpleString()
    p = points.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    r = readings.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(v).cast("double").alias("v")).where("x is not null and y is not null")
    square, out = ["_sx", "_sy"], None

    def medians(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = _set_medians(left, _unpacked(right["_body"].to_list()) if len(left) else right, radius)
        return got.assign(value=got["value"].astype(object).where(got["value"].notna(), None))

    for factor in SIDES:
        side = factor * radius
        reach = lambda c, side=side: F.transform(F.sequence(F.floor((F.col(c) - radius * 1.001) / side), F.floor((F.col(c) + radius * 1.001) / side)), lambda k: k.cast("long"))
        own = _cells(p, side).withColumnsRenamed({"_cx": "_sx", "_cy": "_sy"})
        there = r.withColumn("_sx", F.explode(reach("x"))).withColumn("_sy", F.explode(reach("y")))
        if out is not None:
            there = there.join(own.select(*square).distinct(), square, "left_semi")
        rows = own.select(*square).unionByName(there.select(*square)).groupBy(*square).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*square).collect()  # a row for each `most` rows at most
        crowded = spark.createDataFrame(rows, "_sx long, _sy long") if rows else None
        keep = (lambda df, c=crowded: df if c is None else df.join(F.broadcast(c), square, "left_anti"))
        bodies = keep(there).select(*square, "x", "y", "v").mapInPandas(_pack_squares, "_sx long, _sy long, _body binary")
        few = keep(own).groupBy(*square).cogroup(bodies.groupBy(*square)).applyInPandas(medians, f"_key {kind}, value double, n long")
        out = few if out is None else out.unionByName(few)
        if crowded is None:
            return out.withColumnRenamed("_key", key)
        p = own.join(F.broadcast(crowded), square, "left_semi").drop(*square)
    values = r.groupBy("x", "y", "v").agg(F.count(F.lit(1)).alias("m"))
    each = within(p.select("x", "y").distinct().withColumn("_at", F.struct("x", "y")), values, radius).groupBy("_at").agg(F.percentile("r_v", F.lit(0.5), F.col("r_m")).alias("value"), F.sum("r_m").alias("n"))
    many = p.join(each.select("_at.x", "_at.y", "value", "n"), ["x", "y"]).select("_key", "value", "n")
    return out.unionByName(many).withColumnRenamed("_key", key)


def nearest_within(points: DataFrame, readings: DataFrame, radius: float, key: str, order: str, strict: bool = True) -> DataFrame:
    """J2 with a cap: per point its nearest reading closer than the radius, the first in order among equals."""
    rest = [c for c in points.columns if c != key]
    best = F.min_by(F.struct(*[F.col(c) for c in rest], *[F.col(f"r_{c}") for c in readings.columns], "d2"), F.struct("d2", f"r_{order}"))
    return within(points, readings, radius, strict).groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def wide_median(df: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """median: the exact median of a column of very many different values, of each group; n: the group's rows. percentile() holds all different values in one task: here a first
    pass finds two values close around the median, and only what lies between them is kept apart in the second."""
    by = by or []
    near = df.groupBy(*by).agg(F.percentile_approx(c, [0.4995, 0.5005], 10_000).alias("_q"))  # each is right to a ten-thousandth of the rows
    low, high = F.col("_q")[0], F.col("_q")[1]
    v = F.when(F.col(c) < low, F.lit(-math.inf)).when(F.col(c) > high, F.lit(math.inf)).otherwise(F.col(c))
    own = df.select(*by, c)
    both = own.join(F.broadcast(near), by) if by else own.crossJoin(F.broadcast(near))
    counts = both.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.percentile("_v", F.lit(0.5), F.col("_n")).alias("median"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def nearest_differences(reference: DataFrame, survey: DataFrame, tolerance: float, v: str = "v") -> DataFrame:
    """Per reading (rid) of the survey that has a reference reading nearer than the tolerance, the difference (d) of the nearest one, the first by rid among equals. Where several
    readings share a rid and that leaves more than one, the one with the smallest value is taken, of the reference and then of the survey, however rows are dealt to tasks. Of reference
    readings at one place only the first matters, and each place of the survey is looked at once, so that pairs grow with places, not with readings."""
    value = [F.col(v).isNull().alias("_u"), F.col(v).alias("v")]  # those without a value come last
    first = reference.groupBy("x", "y").agg(F.min(F.struct(F.col("rid").isNull().alias("_w"), "rid", *value)).alias("first"))
    places = survey.select("x", "y").where("x is not null and y is not null").distinct().withColumn("_at", F.struct("x", "y"))
    near = nearest_within(places, first, tolerance, "_at", "first").select("x", "y", F.struct("d2", "r_first").alias("_o"))
    both = survey.select("rid", "x", "y", v).join(near, ["x", "y"])
    return both.groupBy("rid").agg(F.min(F.struct("_o", *value)).alias("_b")).select("rid", (F.col("_b._o.r_first.v") - F.col("_b.v")).alias("d"))


def edge_offset(reference: DataFrame, survey: DataFrame, tolerance: float, v: str = "v", least: int = 5) -> DataFrame:
    """The median difference of the reference from the survey over pairs nearer than the tolerance; 0 with under five pairs."""
    pairs = wide_median(nearest_differences(reference, survey, tolerance, v), "d").withColumnsRenamed({"median": "m", "n": "pairs"})
    return pairs.select(F.when(F.col("pairs") >= least, F.col("m")).otherwise(0.0).alias("offset"), "pairs")


def merged(surveys: list[DataFrame], tolerance: float, v: str = "v", match: bool = True, least: int = 5) -> tuple[DataFrame, list[float]]:
    """Surveys (rid, line, x, y, v and more) as one, with their lines as "<survey>:<line>", and the offset that each took. With match, each after the first is
    moved by its edge offset from all before it, as these were moved; columns that a survey lacks are NULL. One small action for each survey."""
    out, offsets = None, []
    for k, survey in enumerate(surveys):
        part = survey.withColumn("line", F.concat(F.lit(f"{k}:"), F.col("line").cast("string")))
        offset = 0.0
        if out is not None and match:
            usable = lambda df: df.where(f"x is not null and y is not null and {v} is not null")
            before = usable(out).select(F.struct("line", "rid").alias("rid"), "x", "y", v)
            offset = edge_offset(before, usable(part).select(F.struct("line", "rid").alias("rid"), "x", "y", v), tolerance, v, least).first()["offset"]
            part = part.withColumn(v, F.col(v) + F.lit(float(offset)))
        offsets.append(float(offset))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, offsets


def k_nearest(nodes: DataFrame, points: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Near, the k nearest (d2, id, v) of a checked small set of points (x, y, v, id) for each node, the smallest id first among equals. The points go to the
    tasks with the code; nodes stay where they are and look at the points' cells around them, in Arrow batches."""
    rows = points.select("x", "y", "v", "id").where("x is not null and y is not null").limit(SMALL + 1).toPandas()
    if len(rows) > SMALL:
        raise ValueError(f"over {SMALL} points are too many to send to every task; thin them to blocks first")
    rows = rows.sort_values("id", ignore_index=True)
    names, values = rows["id"].to_numpy(), rows["v"].to_numpy(float)
    cells = Cells(rows["x"].to_numpy(float), rows["y"].to_numpy(float), k)
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in [*key, "x", "y"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d2, i = cells.nearest(b["x"].to_numpy(float), b["y"].to_numpy(float), k)
            yield b.assign(_d2=list(d2), _id=list(names[i]), _v=list(values[i]))

    columns, kind = ", ".join(f"{c} {t}" for c, t in kinds.items()), points.schema["id"].dataType.simpleString()
    got = nodes.select(*kinds).mapInPandas(run, f"{columns}, _d2 array<double>, _id array<{kind}>, _v array<double>")
    return got.select(*kinds, F.arrays_zip("_d2", "_id", "_v").cast(f"array<struct<d2:double,id:{kind},v:double>>").alias("near"))


def idw(nodes: DataFrame, points: DataFrame, key: list[str], power: float = 2.0, delta: float = 0.0, k: int = 64) -> DataFrame:
    """Weights 1 / (d2 + delta2) ** (p / 2) over the k nearest; a node on a point takes its value."""
    if power <= 0:
        raise ValueError("the power must be positive")
    near = k_nearest(nodes, points, k, key)
    eps = 1e-24
    d = lambda p: p["d2"] + delta**2
    w = lambda p: 1 / F.pow(F.when(d(p) > eps, d(p)).otherwise(1.0), F.lit(power / 2))
    zero = F.lit(0.0)
    top = F.aggregate("near", zero, lambda a, p: a + w(p) * p["v"])
    low = F.aggregate("near", zero, lambda a, p: a + w(p))
    hit = (F.col("near")[0]["d2"] + delta**2) <= eps
    return near.select(*key, "x", "y", F.when(hit, F.col("near")[0]["v"]).otherwise(top / low).alias("z"))


def node_distance(nodes: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Each node's distance to the nearest of a checked small set of points."""
    return k_nearest(nodes, points, 1, key).select(*key, "x", "y", F.sqrt(F.col("near")[0]["d2"]).alias("d"))


def blanked(grid: DataFrame, points: DataFrame, limit: float, key: list[str] | None = None) -> DataFrame:
    """no value at nodes further than the limit from all points."""
    key = key or ["iy", "ix"]
    far = node_distance(grid.select(*key, "x", "y"), points, key).select(*key, "d")
    return grid.join(far, key).withColumn("z", F.when(F.col("d") <= limit, F.col("z"))).drop("d")


def grid_nodes(spec: tuple[float, float, float, int, int], spark) -> DataFrame:
    """G1: the nodes (iy, ix, x, y) of (x0, y0, cell, nx, ny), made where they are needed."""
    x0, y0, cell, nx, ny = spec
    n = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("long").alias("iy"), (F.col("id") % nx).alias("ix"))
    return n.withColumn("x", x0 + (F.col("ix") + 0.5) * cell).withColumn("y", y0 + (F.col("iy") + 0.5) * cell)


#: Nodes that a grid may have.
MOST_NODES = 4_000_000


def grid_spec(df: DataFrame, cell: float) -> tuple[float, float, float, int, int]:
    """G1: a grid aligned to multiples of the cell that holds all points (one small action)."""
    a = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y0 = math.floor(a["x0"] / cell) * cell, math.floor(a["y0"] / cell) * cell
    nx, ny = math.floor((a["x1"] - x0) / cell) + 1, math.floor((a["y1"] - y0) / cell) + 1
    if nx * ny > MOST_NODES:
        raise ValueError(f"the grid would have {nx * ny} nodes; {MOST_NODES} are allowed")
    return x0, y0, cell, nx, ny


def natural_neighbours(spec: tuple[float, float, float, int, int], points: DataFrame, spark, fine: int = 4) -> DataFrame:
    """Discrete Sibson interpolation. Each cell of a raster finer by `fine` gives its nearest point's value to all nodes that are
    no further from it than that point; a node takes the mean of what it gets. The raster's cells meet the nodes by cells again."""
    x0, y0, cell, nx, ny = spec
    raster = grid_nodes((x0, y0, cell / fine, nx * fine, ny * fine), spark).withColumnsRenamed({"iy": "jy", "ix": "jx"})
    near = k_nearest(raster, points, 1, ["jy", "jx"]).select("x", "y", F.col("near")[0]["d2"].alias("d2"), F.col("near")[0]["v"].alias("v"))
    r = F.sqrt("d2")
    ix = F.sequence(F.greatest(F.ceil((F.col("x") - r - x0) / cell - 0.5), F.lit(0)), F.least(F.floor((F.col("x") + r - x0) / cell - 0.5), F.lit(nx - 1)))
    iy = F.sequence(F.greatest(F.ceil((F.col("y") - r - y0) / cell - 0.5), F.lit(0)), F.least(F.floor((F.col("y") + r - y0) / cell - 0.5), F.lit(ny - 1)))
    ok = (F.ceil((F.col("x") - r - x0) / cell - 0.5) <= F.floor((F.col("x") + r - x0) / cell - 0.5)) & (F.ceil((F.col("y") - r - y0) / cell - 0.5) <= F.floor((F.col("y") + r - y0) / cell - 0.5))
    got = near.where(ok).withColumn("iy", F.explode(iy)).withColumn("ix", F.explode(ix))
    gx, gy = x0 + (F.col("ix") + 0.5) * cell, y0 + (F.col("iy") + 0.5) * cell
    got = got.where(F.pow(gx - F.col("x"), 2) + F.pow(gy - F.col("y"), 2) <= F.col("d2"))
    return got.groupBy("iy", "ix").agg(F.avg("v").alias("z"))


def bilinear(grid: DataFrame, spec: tuple[float, float, float, int, int], points: DataFrame, key: str = "id") -> DataFrame:
    """I8: the grid at points, from the four nodes around; NULL outside or where one of them is blank."""
    x0, y0, cell, nx, ny = spec
    p = points.withColumn("_u", (F.col("x") - x0) / cell - 0.5).withColumn("_v", (F.col("y") - y0) / cell - 0.5)
    p = p.withColumn("_i", F.least(F.floor("_u"), F.lit(nx - 2)).cast("long")).withColumn("_j", F.least(F.floor("_v"), F.lit(ny - 2)).cast("long"))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = p.withColumn("_c", F.explode(corners)).withColumn("ix", F.col("_i") + F.col("_c.a")).withColumn("iy", F.col("_j") + F.col("_c.b"))
    one = lambda f, c: F.when(c == 1, f).otherwise(1 - f)
    w = one(F.col("_u") - F.col("_i"), F.col("_c.a")) * one(F.col("_v") - F.col("_j"), F.col("_c.b"))
    inside = (F.col("_u") >= 0) & (F.col("_u") <= nx - 1) & (F.col("_v") >= 0) & (F.col("_v") <= ny - 1)
    g = grid.select("iy", "ix", "z")
    m = p.withColumn("_w", w).withColumn("_in", inside).join(g, ["iy", "ix"], "left").groupBy(key).agg(F.sum(F.col("_w") * F.col("z")).alias("s"), F.count("z").alias("n"), F.first("_in").alias("ok"))
    return m.select(key, F.when(F.col("ok") & (F.col("n") == 4), F.col("s")).alias("z"))


def low_pass(grid: DataFrame, size: int, nx: int, ny: int, z: str = "z") -> DataFrame:
    """The mean of the present values in a square of `size` nodes, edges repeated outwards. As a sum over rows and then over columns: each
    node gives its value to the `size` rows (columns) around, more than once where the edge repeats it."""
    half_lo, half_hi = size // 2, (size - 1) // 2

    def one_way(df: DataFrame, axis: str, n: int) -> DataFrame:
        reach = F.sequence(F.col(axis) - half_hi, F.col(axis) + half_lo)
        first, last = F.col(axis) == 0, F.col(axis) == n - 1
        low = F.when(first, F.sequence(F.lit(-half_hi), F.lit(half_lo))).otherwise(reach)
        times = lambda k: 1 + F.when(first, F.greatest(F.lit(0), half_lo - k)).otherwise(0) + F.when(last, F.greatest(F.lit(0), k + half_hi - (n - 1))).otherwise(0)
        out = df.withColumn("_k", F.explode(low)).where((F.col("_k") >= 0) & (F.col("_k") < n))
        out = out.withColumn("_t", times(F.col("_k")))
        other = "iy" if axis == "ix" else "ix"
        return out.groupBy(F.col("_k").alias(axis), other).agg(F.sum(F.col("_s") * F.col("_t")).alias("_s"), F.sum(F.col("_n") * F.col("_t")).alias("_n"))

    df = grid.select("iy", "ix", F.coalesce(z, F.lit(0.0)).alias("_s"), F.col(z).isNotNull().cast("int").alias("_n"))
    df = one_way(one_way(df, "ix", nx), "iy", ny)
    return df.select(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.try_divide("_s", "_n").alias("smooth"))



def filtered(grid: DataFrame, kind: str, size: int, nx: int, ny: int) -> DataFrame:
    """The grid (iy, ix, z) smoothed, or without its smoothed self; blank nodes of a high pass stay blank."""
    if kind == "none":
        return grid
    if kind not in ("low-pass", "high-pass"):
        raise ValueError(f"no filter {kind!r}; spikes of a grid are furrow.operators.gridders.despiked_grid")
    smooth = low_pass(grid, size, nx, ny)
    if kind == "low-pass":
        return smooth.withColumnRenamed("smooth", "z")
    return grid.join(smooth, ["iy", "ix"]).withColumn("z", F.col("z") - F.col("smooth")).drop("smooth")
