"""Profiles on a common grid, their noise, signal and score. One plan over all channels: no loop over channels or traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ordered import first_readings, robust_noise


def grid(points: DataFrame, step: float, by: list[str]) -> DataFrame:
    """Per channel dmin, n nodes and their actual spacing h; channels shorter than a step have none."""
    g = points.groupBy(*by).agg(F.min("dist").alias("dmin"), F.max("dist").alias("dmax"))
    g = g.where(F.col("dmax") - F.col("dmin") >= step).withColumn("n", (F.bround((F.col("dmax") - F.col("dmin")) / step) + 1).cast("long"))
    return g.withColumn("h", (F.col("dmax") - F.col("dmin")) / (F.col("n") - 1))


def segments(points: DataFrame, by: list[str], trace: str) -> DataFrame:
    """Neighbouring readings of each trace of at least two, as (d0, v0, d1, v1), the last one marked; duplicates: first reading."""
    p = first_readings(points.where("value is not null and dist is not null").select(*by, trace, "dist", "rid", "value"), [*by, trace, "dist"])
    w = Window.partitionBy(*by, trace).orderBy("dist")
    s = p.select(*by, trace, F.col("dist").alias("d0"), F.col("value").alias("v0"), F.lead("dist").over(w).alias("d1"), F.lead("value").over(w).alias("v1"), F.lag("dist").over(w).alias("dp"), F.lag("value").over(w).alias("vp"), F.lead("dist", 2).over(w).alias("dn"), F.lead("value", 2).over(w).alias("vn"))
    return s.where("d1 is not null").withColumn("is_last", F.col("dn").isNull())


def _pchip_slope(h0, h1, m0, m1):
    """The harmonic mean slope at an inner point of secants m0 and m1 over h0 and h1; 0 at an extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    safe = F.when(m0 * m1 > 0, (w0 + w1) / (w0 / F.when(m0 != 0, m0) + w1 / F.when(m1 != 0, m1)))
    return F.coalesce(safe, F.lit(0.0))


def _pchip_end(h0, h1, m0, m1):
    """The slope at an end by three points, kept to the sign and three times the size of the secant there."""
    s = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return F.when(F.signum(s) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(s) > 3 * F.abs(m0)), 3 * m0).otherwise(s)


def resampled(points: DataFrame, step: float, by: list[str], trace: str = "line", kind: str = "linear") -> DataFrame:
    """(by, trace, gi, dist, value): each trace at the channel's grid nodes within its own range.

    Each segment makes the nodes it covers, so there is no range join; the node at a trace's end belongs to its last segment.
    """
    g = grid(points.where("dist is not null"), step, by)
    s = segments(points, by, trace).join(g, by)
    lo = F.greatest(F.floor((F.col("d0") - F.col("dmin")) / F.col("h")) - 1, F.lit(0)).cast("long")
    hi = F.least(F.ceil((F.col("d1") - F.col("dmin")) / F.col("h")) + 1, F.col("n") - 1).cast("long")
    s = s.where(lo <= hi).withColumn("gi", F.explode(F.sequence(lo, hi)))
    s = s.withColumn("dist", F.when(F.col("gi") == F.col("n") - 1, F.col("dmax")).otherwise(F.col("dmin") + F.col("gi") * F.col("h")))
    s = s.where((F.col("dist") >= F.col("d0")) & ((F.col("dist") < F.col("d1")) | (F.col("is_last") & (F.col("dist") == F.col("d1")))))
    width, rise = F.col("d1") - F.col("d0"), F.col("v1") - F.col("v0")
    if kind == "linear":
        value = F.col("v0") + rise * (F.col("dist") - F.col("d0")) / width
    elif kind == "nearest":
        value = F.when(F.col("dist") - F.col("d0") <= width / 2, F.col("v0")).otherwise(F.col("v1"))
    elif kind == "pchip":
        hp, hn = F.col("d0") - F.col("dp"), F.col("dn") - F.col("d1")
        m, mp, mn = rise / width, (F.col("v0") - F.col("vp")) / hp, (F.col("vn") - F.col("v1")) / hn
        a = F.when(hp.isNull() & hn.isNull(), m).when(hp.isNull(), _pchip_end(width, hn, m, mn)).otherwise(_pchip_slope(hp, width, mp, m))
        b = F.when(hp.isNull() & hn.isNull(), m).when(hn.isNull(), _pchip_end(width, hp, m, mp)).otherwise(_pchip_slope(width, hn, m, mn))
        t = (F.col("dist") - F.col("d0")) / width
        value = F.col("v0") * (1 + 2 * t) * (1 - t) * (1 - t) + a * width * t * (1 - t) * (1 - t) + F.col("v1") * t * t * (3 - 2 * t) - b * width * t * t * (1 - t)
    else:
        raise ValueError(f"no interpolation {kind!r}; linear, nearest and pchip are expressions, kriging is furrow.operators.kriging.profile")
    return s.select(*by, trace, "gi", "dist", value.alias("value"))


def envelope(profiles: DataFrame, by: list[str]) -> DataFrame:
    """A4: mean, sample deviation and number of passes at each node."""
    return profiles.groupBy(*by, "gi", "dist").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("passes"))


def pass_noise(profiles: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """The root of the mean variance between passes, over nodes (and tracks) with at least two."""
    per = profiles.groupBy(*by, *group, "gi").agg(F.var_samp("value").alias("s2"), F.count("value").alias("k")).where("k > 1")
    return per.groupBy(*by).agg(F.sqrt(F.avg("s2")).alias("sigma"))


def scored(points: DataFrame, step: float, by: list[str], trace: str = "line", track: str | None = None, kind: str = "linear") -> DataFrame:
    """Per channel mean_std, signal_std, snr, score, noise_method, n_traces, passes.

    Passes of a track are repeats; where no track has two, noise comes from each pass by itself. track: a column of points; without one all
    traces are passes of one.
    """
    points = points.withColumn("_track", F.coalesce(F.col(track).cast("string"), F.concat(F.lit("line "), F.col(trace).cast("string"))) if track else F.lit("0"))
    owner = points.groupBy(*by, trace).agg(F.min("_track").alias("_track"))
    profiles = resampled(points, step, by, trace, kind).join(owner, [*by, trace])
    sizes = profiles.groupBy(*by, "_track").agg(F.countDistinct(trace).alias("traces"))
    repeats = sizes.groupBy(*by).agg(F.max(F.col("traces") > 1).alias("repeated"))
    node = profiles.join(sizes, [*by, "_track"]).join(repeats, by).where(~F.col("repeated") | (F.col("traces") > 1))
    per = node.groupBy(*by, "repeated", "_track", "gi").agg(F.var_samp("value").alias("s2"), F.avg("value").alias("m"), F.count("value").alias("k"))
    between = per.where("repeated and k > 1").groupBy(*by).agg(F.sqrt(F.avg("s2")).alias("sigma"))
    alone = robust_noise(first_readings(points.where("value is not null").select(*by, trace, "dist", "rid", "value"), [*by, trace, "dist"]), "value", [*by, trace], "dist", fallback=True)
    within = alone.groupBy(*by).agg(F.sqrt(F.avg(F.col("sigma") * F.col("sigma"))).alias("inner"))
    noise = repeats.join(between, by, "left").join(within, by, "left").select(*by, "repeated", F.when(F.col("repeated"), F.col("sigma")).otherwise(F.col("inner")).alias("sigma"))
    shares = per.where("not repeated or k > 1").groupBy(*by, "_track").agg(F.var_samp("m").alias("var"), F.avg(1 / F.col("k")).alias("share"), F.count(F.lit(1)).alias("n")).where("n > 1")
    power = shares.join(noise, by).groupBy(*by).agg((F.sum(F.col("n") * (F.col("var") - F.col("sigma") * F.col("sigma") * F.col("share"))) / F.sum("n")).alias("ps"))
    used = sizes.join(repeats, by).where("not repeated or traces > 1").groupBy(*by).agg(F.percentile("traces", F.lit(0.5)).cast("long").alias("passes"))
    all_traces = sizes.groupBy(*by).agg(F.sum("traces").alias("n_traces"))
    out = noise.join(power, by, "left").join(used, by).join(all_traces, by)
    known = F.col("sigma").isNotNull() & (F.col("sigma") >= 1e-8)
    positive = F.col("ps") > 0
    snr = F.when(known, F.when(positive, F.col("ps") / (F.col("sigma") * F.col("sigma"))).otherwise(0.0))
    return out.select(
        *by, F.col("sigma").alias("mean_std"), F.when(positive, F.sqrt(F.when(positive, F.col("ps")))).otherwise(0.0).alias("signal_std"), snr.alias("snr"),
        F.when(known & positive, 10 * F.log10(F.when(positive, F.col("ps")) / (F.col("sigma") * F.col("sigma")))).alias("score"),
        F.when(F.col("repeated"), "between passes").otherwise("within passes").alias("noise_method"), "n_traces", "passes",
    )


def pseudosection(means: DataFrame, label: str = "label") -> DataFrame:
    """Mean profiles (label, dist, value) on the distances all share, at the least of their median steps."""
    w = Window.partitionBy(label).orderBy("dist")
    lo_hi = means.groupBy(label).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    gap = means.withColumn("gap", F.lead("dist").over(w) - F.col("dist")).where("gap > 0").groupBy(label).agg(F.percentile("gap", F.lit(0.5)).alias("step"))
    common = lo_hi.join(gap, label).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.min("step").alias("step"))  # one row
    s = means.select(label, F.col("dist").alias("d0"), F.col("value").alias("v0"), F.lead("dist").over(w).alias("d1"), F.lead("value").over(w).alias("v1"), F.lead("dist", 2).over(w).isNull().alias("is_last"))
    s = s.where("d1 is not null").crossJoin(F.broadcast(common)).withColumn("n", (F.bround((F.col("hi") - F.col("lo")) / F.col("step")) + 1).cast("long"))
    s = s.where("hi > lo").withColumn("h", (F.col("hi") - F.col("lo")) / (F.col("n") - 1))
    a = F.greatest(F.floor((F.col("d0") - F.col("lo")) / F.col("h")) - 1, F.lit(0)).cast("long")
    z = F.least(F.ceil((F.col("d1") - F.col("lo")) / F.col("h")) + 1, F.col("n") - 1).cast("long")
    s = s.where(a <= z).withColumn("gi", F.explode(F.sequence(a, z))).withColumn("dist", F.when(F.col("gi") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + F.col("gi") * F.col("h")))
    s = s.where((F.col("dist") >= F.col("d0")) & ((F.col("dist") < F.col("d1")) | (F.col("is_last") & (F.col("dist") == F.col("d1")))))
    return s.select(label, "gi", "dist", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("dist") - F.col("d0")) / (F.col("d1") - F.col("d0"))).alias("value"))


def mixed_methods(scores: DataFrame, mode: str = "mode") -> DataFrame:
    """Modes whose channels were given noise by different methods."""
    return scores.groupBy(mode).agg(F.count_if(F.col("noise_method") == "between passes").alias("between"), F.count_if(F.col("noise_method") == "within passes").alias("within")).where("between > 0 and within > 0")
