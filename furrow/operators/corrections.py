"""Corrections of readings, in their fixed order. Fits come from small aggregates; readings are corrected by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ordered import linear_drift
from furrow.operators.spatial import radius_medians


def drop_flagged(df: DataFrame, status: str = "status") -> DataFrame:
    """a missing status counts as 0."""
    return df.where(F.coalesce(F.col(status), F.lit(0.0)) == 0)


def exclude_lines(df: DataFrame, excluded: list[str], base: tuple[str, ...] = (), line: str = "line") -> DataFrame:
    """without the named lines, but for base stations."""
    return df.where(~F.col(line).isin([x for x in excluded if x not in base]) | F.col(line).isNull())


def clipped(df: DataFrame, v: str, low: float, high: float, by: list[str]) -> DataFrame:
    """blanks values outside two percentiles of their channel."""
    p = df.groupBy(*by).agg(F.percentile(v, F.array(F.lit(low / 100), F.lit(high / 100))).alias("_p"))
    return df.join(p, by).withColumn(v, F.when(F.col(v).between(F.col("_p")[0], F.col("_p")[1]), F.col(v))).drop("_p")


def occupations(df: DataFrame, lines: list[str], line: str = "line", values: tuple[str, ...] = ("t", "v")) -> DataFrame:
    """A5: means over each base-station line."""
    return df.where(F.col(line).isin(lines)).groupBy(line).agg(*[F.avg(v).alias(v) for v in values])


def without_drift(df: DataFrame, lines: list[str], v: str = "value") -> DataFrame:
    """C3, linear: subtracts the straight line through occupation means, less its value at the first one; base-station rows go."""
    occ = occupations(df, lines, values=("t", v))
    fit = linear_drift(occ, v=v).crossJoin(occ.agg(F.min("t").alias("t_first")))  # two rows of one aggregate each
    kept = df.where(~F.col("line").isin(lines)).crossJoin(F.broadcast(fit))
    return kept.withColumn("corrected", F.col(v) - F.col("slope") * (F.col("t") - F.col("t_first"))).drop("slope", "intercept", "t_first")


def without_temperature(df: DataFrame, occ: DataFrame, temp: str, v: str) -> DataFrame:
    """C2, one term: subtracts the slope over occupation means times the distance from their mean temperature."""
    fit = occ.agg(F.regr_slope(v, temp).alias("_c"), F.avg(temp).alias("_t"))
    return df.crossJoin(F.broadcast(fit)).withColumn("corrected", F.col(v) - F.col("_c") * (F.col(temp) - F.col("_t"))).drop("_c", "_t")


def height_line(df: DataFrame, h: str, v: str, by: list[str]) -> DataFrame:
    """C1, linear: moves values to the median height along the fitted line of their channel."""
    fit = df.groupBy(*by).agg(F.regr_slope(v, h).alias("_b"), F.percentile(h, F.lit(0.5)).alias("_h"))
    return df.join(fit, by).withColumn("corrected", F.col(v) - F.col("_b") * (F.col(h) - F.col("_h"))).drop("_b", "_h")


#: Candidate exponents, over the span of heights, of each round of the search, and rounds.
EXPONENTS, ROUNDS = 24, 5


def height_exponential(df: DataFrame, h: str, v: str, by: list[str], reference: float | None = None) -> DataFrame:
    """Moves values to the reference height (or their channel's median one) along a + b exp(c h) of their channel, by least squares; along a straight line where no curve
    fits better, which includes channels with under four readings or heights.

    For a given c, a and b are linear, so a candidate's misfit follows from five sums. All candidates of all channels are one aggregate, and each round looks more closely around the best.
    """
    ok = df.where(F.col(h).isNotNull() & F.col(v).isNotNull() & ~F.isnan(h) & ~F.isnan(v)).select(*by, F.col(h).cast("double").alias("_h"), F.col(v).cast("double").alias("_v"))
    line = ok.groupBy(*by).agg(F.percentile("_h", F.lit(0.5)).alias("_mid"), F.min("_h").alias("_low"), F.max("_h").alias("_high"), F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mv"), F.avg("_h").alias("_mh"), F.regr_slope("_v", "_h").alias("_slope"), F.regr_r2("_v", "_h").alias("_r2"), F.var_pop("_v").alias("_var"))
    line = line.withColumn("_span", F.col("_high") - F.col("_low"))
    spread = [sign * 0.05 * (400 ** (k / (EXPONENTS - 1))) for k in range(EXPONENTS) for sign in (-1, 1)]
    tried = line.where("_span > 0 and _n >= 4").select(*by, "_mid", "_span", "_mv", F.explode(F.array(*[F.lit(x) for x in spread])).alias("_k"), F.lit(0.35).alias("_reach"))
    best = None
    for _ in range(ROUNDS):
        e = F.exp(F.col("_k") / F.col("_span") * (F.col("_h") - F.col("_mid")))
        y = F.col("_v") - F.col("_mv")
        sums = ok.join(F.broadcast(tried), by).groupBy(*by, "_k", "_mid", "_span", "_mv", "_reach").agg(F.covar_pop(y, e).alias("_ve"), F.var_pop(e).alias("_ee"), F.var_pop(y).alias("_vv"), F.avg(e).alias("_me"), F.avg(y).alias("_my"))
        sums = sums.where("_ee > 0").withColumn("_miss", F.col("_vv") - F.col("_ve") * F.col("_ve") / F.col("_ee")).withColumn("_b", F.col("_ve") / F.col("_ee"))
        best = sums.groupBy(*by).agg(F.min_by(F.struct("_k", "_b", "_mid", "_span", "_mv", "_reach", "_miss"), F.struct("_miss", "_k")).alias("_f")).select(*by, "_f.*")
        best = best.sparkSession.createDataFrame(best.collect(), best.schema)  # one row a channel
        closer = F.array(*[F.col("_k") * F.exp(F.col("_reach") * x / 6) for x in range(-6, 7)])
        tried = best.select(*by, "_mid", "_span", "_mv", F.explode(closer).alias("_k"), (F.col("_reach") / 5).alias("_reach"))
    fit = line.join(best.select(*by, "_k", "_b", "_miss"), by, "left")
    at = F.col("_mid") if reference is None else F.lit(float(reference))
    rate = F.col("_k") / F.col("_span")
    bent = F.col("_b") * (F.exp(rate * (F.col(h) - F.col("_mid"))) - F.exp(rate * (at - F.col("_mid"))))
    straight = F.coalesce(F.col("_slope"), F.lit(0.0)) * (F.col(h) - at)
    curved = F.col("_miss").isNotNull() & (F.col("_miss") < (1 - F.coalesce(F.col("_r2"), F.lit(0.0))) * F.col("_var"))
    drop = ["_mid", "_low", "_high", "_n", "_mv", "_mh", "_slope", "_r2", "_var", "_span", "_k", "_b", "_miss"]
    return df.join(F.broadcast(fit), by, "left").withColumn("corrected", F.col(v) - F.when(curved, bent).otherwise(straight)).drop(*drop)


def temperature_slopes(occupations: DataFrame, by: list[str], temp: str = "c", v: str = "v", t: str | None = "t") -> DataFrame:
    """By, _b (the value's change with temperature) and _c (the mean temperature) over occupation means. With four occupations or more whose times and temperatures
    aren't one line, it is fitted together with a trend in time: the normal equations of two regressors, from covariances."""
    cov = lambda a, b: F.covar_pop(a, b)
    if t is None:
        return occupations.groupBy(*by).agg(F.coalesce(F.regr_slope(v, temp), F.lit(0.0)).alias("_b"), F.avg(temp).alias("_c"))
    a = occupations.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cov(v, temp).alias("vc"), cov(v, t).alias("vt"), F.var_pop(temp).alias("cc"), F.var_pop(t).alias("tt"), cov(temp, t).alias("ct"), F.avg(temp).alias("_c"))
    det = F.col("cc") * F.col("tt") - F.col("ct") * F.col("ct")
    both = (F.col("n") >= 4) & (det > 2e-9 * F.col("cc") * F.col("tt"))  # correlation below 1 by a billionth
    slope = F.when(both, (F.col("vc") * F.col("tt") - F.col("vt") * F.col("ct")) / det).otherwise(F.try_divide(F.col("vc"), F.col("cc")))
    return a.select(*by, F.coalesce(slope, F.lit(0.0)).alias("_b"), "_c")


def with_offsets(df: DataFrame, offsets: dict[str, float], key: str = "label", v: str = "value") -> DataFrame:
    """C4: subtracts each channel's offset; the offsets are settings, part of the plan."""
    if not offsets:
        return df
    table = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return df.withColumn(v, F.col(v) - F.coalesce(table[F.col(key)], F.lit(0.0)))


def reference_fit(reference: DataFrame, readings: DataFrame, radius: float, moments: bool = False) -> DataFrame:
    """Gain, offset, R2 and number of pairs of reference values (x, y, ref) against the medians of readings around them. Each value goes along to its median as the point's
    key, so nothing is joined by ids."""
    pairs = radius_medians(reference.select(F.col("ref").cast("double").alias("ref"), "x", "y"), readings, radius, key="ref")
    gain = F.stddev_samp("ref") / F.stddev_samp("value") if moments else F.regr_slope("ref", "value")
    fit = pairs.agg(gain.alias("gain"), F.avg("ref").alias("mr"), F.avg("value").alias("mv"), F.pow(F.corr("ref", "value"), 2).alias("r2"), F.count(F.lit(1)).alias("pairs"))
    return fit.where("pairs >= 3 and gain is not null").select("gain", (F.col("mr") - F.col("gain") * F.col("mv")).alias("offset"), "r2", "pairs")


def shifted(df: DataFrame, lag: float | Column, line: str = "line", t: str = "t", order: str = "rid", end_s: float = 2.0) -> DataFrame:
    """Positions where the sensor was `lag` seconds before, by linear interpolation in time along the line; beyond the ends by the velocity
    of the first or last two seconds. Readings at (0, 0) have no fix and stay."""
    fix = df.where("x is not null and y is not null and t is not null and not (x = 0 and y = 0)")
    w = Window.partitionBy(line).orderBy(t)
    seg = fix.select(line, F.col(t).alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead(t).over(w).alias("t1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    ends = fix.groupBy(line).agg(F.min(t).alias("ta"), F.max(t).alias("tb"))
    near = fix.join(ends, line)
    first, last = F.col(t) <= F.col("ta") + end_s, F.col(t) >= F.col("tb") - end_s
    slopes = near.groupBy(line).agg(*[F.coalesce(F.regr_slope(F.when(side, F.col(c)), F.when(side, F.col(t))), F.lit(0.0)).alias(f"{c}{name}") for c in ("x", "y") for side, name in ((first, "a"), (last, "b"))], F.first("ta").alias("ta"), F.first("tb").alias("tb"), *[F.min_by(c, t).alias(f"{c}0a") for c in ("x", "y")], *[F.max_by(c, t).alias(f"{c}0b") for c in ("x", "y")])
    want = fix.select(line, order, (F.col(t) - lag).alias("tn"))
    # As-of: the wanted times and the fixes in one order along the line, each time after its fix.
    both = want.select(line, order, F.col("tn").alias("tt"), F.lit(1).alias("is_want")).unionByName(seg.withColumnRenamed("t0", "tt").withColumn("is_want", F.lit(0)), allowMissingColumns=True)
    back = Window.partitionBy(line).orderBy("tt", "is_want").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.last(F.when(F.col("is_want") == 0, F.struct(F.col("tt").alias("t0"), "x0", "y0", "t1", "x1", "y1")), True).over(back)
    got = both.withColumn("_s", packed).where("is_want = 1").join(slopes, line)

    def at(c: str):
        inner = F.col(f"_s.{c}0") + (F.col(f"_s.{c}1") - F.col(f"_s.{c}0")) * (F.col("tt") - F.col("_s.t0")) / F.when(F.col("_s.t1") > F.col("_s.t0"), F.col("_s.t1") - F.col("_s.t0"))
        before, after = F.col(f"{c}0a") + F.col(f"{c}a") * (F.col("tt") - F.col("ta")), F.col(f"{c}0b") + F.col(f"{c}b") * (F.col("tt") - F.col("tb"))
        return F.when(F.col("tt") < F.col("ta"), before).when(F.col("tt") >= F.col("tb"), after).otherwise(F.coalesce(inner, F.col(f"_s.{c}0")))

    moved = got.select(line, order, at("x").alias("_x"), at("y").alias("_y"))
    return df.join(moved, [line, order], "left").withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y")).drop("_x", "_y")
