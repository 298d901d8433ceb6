"""Blocks, levels, summaries, colour levels and variogram classes. All combine before their shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.spatial import within


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def in_cells(df: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("iy", F.floor((F.col(y) - y0) / cell).cast("long")).withColumn("ix", F.floor((F.col(x) - x0) / cell).cast("long"))


def block_medians(df: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0, v: str = "v", by: list[str] | None = None) -> DataFrame:
    """A1: per cell, the medians of x, y and the value, each by itself."""
    return in_cells(df.where(F.col(v).isNotNull()), cell, x0, y0).groupBy(*(by or []), "iy", "ix").agg(median("x").alias("x"), median("y").alias("y"), median(v).alias("v"), F.count(F.lit(1)).alias("n"))


def block_lines(df: DataFrame, cell: float, line: str = "line", order: str = "rid") -> DataFrame:
    """A2: per cell, the line of its first reading that has one."""
    return in_cells(df.where(F.col(line).isNotNull()), cell).groupBy("iy", "ix").agg(F.min_by(line, order).alias("line"))


def levelled(df: DataFrame, v: str = "v", line: str = "line") -> DataFrame:
    """A3: shifts each line by the difference of the median of all from its own; readings without a line are one line."""
    per = df.groupBy(line).agg(median(v).alias("_own"))
    total = df.agg(median(v).alias("_all"))  # one row
    per = per.crossJoin(F.broadcast(total)).withColumnRenamed(line, "_line")
    return df.join(per, F.col(line).eqNullSafe(F.col("_line"))).withColumn("levelled", F.col(v) + (F.col("_all") - F.col("_own"))).drop("_own", "_all", "_line")


def summary(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    """N, mean, deviation (0 for one value), minimum, percentiles 2, 50 and 98, maximum."""
    return df.where(F.col(v).isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"),
        F.percentile(v, F.lit(0.02)).alias("p2"), median(v).alias("median"), F.percentile(v, F.lit(0.98)).alias("p98"), F.max(v).alias("max"),
    )


def median_spacing(df: DataFrame, d: str = "dist", line: str = "line") -> DataFrame:
    """The median positive gap between neighbours along each line, over all lines; one row."""
    gap = F.lead(d).over(Window.partitionBy(line).orderBy(d)) - F.col(d)
    return df.where(F.col(d).isNotNull()).select(gap.alias("gap")).where("gap > 0").agg(median("gap").alias("spacing"))


def nice_step(spacing: Column) -> Column:
    """The nearest of 1, 2 and 5 times a power of ten, by ratio."""
    k = F.floor(F.log10(spacing))
    options = [F.struct(F.abs(F.ln(F.lit(m) * F.pow(F.lit(10.0), k) / spacing)).alias("far"), (F.lit(m) * F.pow(F.lit(10.0), k)).alias("step")) for m in (1.0, 2.0, 5.0, 10.0)]
    return F.array_min(F.array(*options))["step"]


def step_mismatch(step: Column, spacing: Column) -> Column:
    return (step < 0.5 * spacing) | (step > 5 * spacing)


def cell_size(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The root of the bounding box's area for each reading, to two significant figures; one row."""
    from furrow.functions.columns import significant

    raw = F.sqrt((F.max(x) - F.min(x)) * (F.max(y) - F.min(y)) / F.count(F.lit(1)))
    return df.agg(raw.alias("raw")).select(significant(F.col("raw")).alias("cell"))


def principal_axis(df: DataFrame, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """The unit main axis (pointing east or else north) and the ratio of the minor to the major spread, by the closed form of a 2 x 2 matrix."""
    m = df.groupBy(*(by or [])).agg(F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c"), F.count(F.lit(1)).alias("n"))
    mid, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    angle = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    return m.select(*(by or []), F.cos(angle).alias("ax"), F.sin(angle).alias("ay"), F.sqrt(F.greatest(F.try_divide(mid - root, mid + root), F.lit(0.0))).alias("spread"), "n")


def track_count(df: DataFrame, axis: tuple[float, float], line: str = "line", gap: float = 1.0) -> DataFrame:
    """How many tracks the lines make: their medians across the axis, parted by gaps of over a metre."""
    across = -axis[1] * F.col("x") + axis[0] * F.col("y")
    per = df.groupBy(line).agg(median(across).alias("pos"))
    steps = per.select((F.col("pos") - F.lag("pos").over(Window.orderBy("pos")) > gap).alias("new"))  # one row a line
    return steps.agg((F.sum(F.coalesce(F.col("new").cast("int"), F.lit(0))) + 1).cast("long").alias("tracks"))


def tracks(lines: DataFrame, line: str = "line", pos: str = "pos", reach: float = 1.0) -> DataFrame:
    """Lines in order of position join a track while within a metre of its first line. A fold over one row a line (hundreds)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("l"))))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(-1).cast("long").alias("t"), F.array().cast("array<struct<line:string,track:bigint>>").alias("out"))

    def step(acc, x):
        new = acc["s"].isNull() | (x["p"] - acc["s"] > reach)
        t = acc["t"] + new.cast("long")
        return F.struct(F.when(new, x["p"]).otherwise(acc["s"]).alias("s"), t.alias("t"), F.concat(acc["out"], F.array(F.struct(x["l"].alias("line"), t.alias("track")))).alias("out"))

    return lines.agg(F.aggregate(rows, start, step)["out"].alias("out")).select(F.inline("out"))


def height_levels(df: DataFrame, h: str, values: list[str], bin_m: float = 0.05) -> DataFrame:
    """Means of the values in bins of height; levels where one is missing go."""
    out = df.withColumn("level", F.bround(F.col(h) / bin_m) * bin_m).groupBy("level").agg(*[F.avg(v).alias(v) for v in values])
    return out.dropna(subset=values)


def anomaly(df: DataFrame, cx: float, cy: float, radius: float, by: list[str], v: str = "v", annulus: bool = True) -> DataFrame:
    """Mean within the radius, less the median of the ring to twice the radius (or of all the rest), and how many are within."""
    r2 = F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)
    inside, around = r2 <= radius**2, (r2 > radius**2) & ((r2 <= 4 * radius**2) if annulus else F.lit(True))
    m = df.groupBy(*by).agg(F.avg(F.when(inside, F.col(v))).alias("mean"), median(F.when(around, F.col(v))).alias("ground"), F.count(F.when(inside, F.col(v))).alias("n"))
    return m.select(*by, (F.col("mean") - F.col("ground")).alias("anomaly"), "n")


def semivariogram(points: DataFrame, edges: list[float], least: int = 30) -> DataFrame:
    """Per lag class, mean half squared difference, mean lag and number of pairs, of points (x, y, v, id). Pairs meet by cells as wide as the last edge,
    so only those that may count are made."""
    own = points.select("id", "x", "y", "v")
    pairs = within(own, own, float(edges[-1])).where(F.col("id") < F.col("r_id"))
    lag = sum((F.when(F.col("d") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    pairs = pairs.select(F.sqrt("d2").alias("d"), (0.5 * F.pow(F.col("v") - F.col("r_v"), 2)).alias("g")).where(F.col("d") <= edges[-1]).withColumn("lag", lag.cast("long"))
    return pairs.groupBy("lag").agg(F.avg("d").alias("distance"), F.avg("g").alias("gamma"), F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= least)


def levels(df: DataFrame, v: str, n: int, low: float = 0.02, high: float = 0.98, scale: str = "linear", span: str = "percentiles", least: float | None = None, most: float | None = None) -> DataFrame:
    """N + 1 class boundaries, linear, geometric (log) or of equal counts (equalised). span: from the percentile `low` to `high`, minmax, or fixed (least, most;
    the data's where one isn't given). A flat span is widened a little."""
    if not 0 <= low < high <= 1:
        raise ValueError("the percentiles must be in order, from 0 to 1")
    if span == "fixed" and least is not None and most is not None and most <= least:
        raise ValueError("the largest value must be above the smallest")
    if scale == "equalised" and span == "percentiles":
        q = df.agg(F.percentile(v, F.array(*[F.lit(low + (high - low) * k / n) for k in range(n + 1)])).alias("q"))
        return q.select(F.posexplode(F.array_distinct("q")).alias("k", "level"))
    if span == "percentiles":
        ends = F.percentile(v, F.lit(low)), F.percentile(v, F.lit(high))
    else:
        ends = tuple(F.lit(float(x)) if span == "fixed" and x is not None else f(v) for x, f in ((least, F.min), (most, F.max)))
    m = df.agg(ends[0].alias("a"), ends[1].alias("b"))
    if scale == "equalised":
        inside = df.crossJoin(F.broadcast(m)).where(F.col(v).between(F.col("a"), F.col("b")))  # one row
        q = inside.agg(F.percentile(v, F.array(*[F.lit(k / n) for k in range(n + 1)])).alias("q"), F.first("a").alias("a"), F.first("b").alias("b"))
        return q.select(F.posexplode(F.array_distinct(F.concat(F.array("a"), F.slice("q", 2, n - 1), F.array("b")))).alias("k", "level"))
    flat = F.col("b") - F.col("a") <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-12))
    m = m.withColumn("pad", F.when(flat, F.greatest(F.abs("a") * 1e-6, F.lit(1e-12))).otherwise(0.0)).selectExpr("a - pad as a", "b + pad as b")
    k = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")
    if scale == "log":
        return m.select(k, "a", "b").select("k", F.when(F.col("a") > 0, F.col("a") * F.pow(F.col("b") / F.col("a"), F.col("k") / n)).otherwise(F.raise_error(F.lit("a logarithmic scale needs positive values"))).alias("level"))
    return m.select(k, "a", "b").select("k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / n).alias("level"))


def histogram(df: DataFrame, v: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins, the last closed; one bin when all values agree to a billionth."""
    m = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))  # one row
    flat = F.col("b") - F.col("a") <= 1e-9 * F.greatest(F.abs("a"), F.abs("b"))
    k = F.when(flat, 0).otherwise(F.least(F.floor((F.col(v) - F.col("a")) / F.when(~flat, (F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)))
    return df.where(F.col(v).isNotNull()).crossJoin(F.broadcast(m)).groupBy(k.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lag_edges(lo: float, hi: float, n: int = 15) -> list[float]:
    """The variogram's class edges: evenly spaced in the logarithm, the first at 0."""
    return [0.0] + [lo * math.pow(hi / lo, k / n) for k in range(1, n + 1)]
