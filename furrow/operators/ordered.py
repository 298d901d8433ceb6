"""Operators along a survey line. Reading order is an explicit column, never the physical order of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import DAY_S, HALF_DAY_S


def along(by: list[str], order: str = "rid"):
    return Window.partitionBy(*by).orderBy(order)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def unwrapped(df: DataFrame, t: str = "t", order: str = "rid", by: list[str] | None = None) -> DataFrame:
    """T5: a day more for all readings after each step back of over half a day. Missing times stay so; steps are taken across them."""
    w = along(by or [], order)
    before = F.last(t, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_back", (F.col(t) - before < -HALF_DAY_S).cast("int")).withColumn(t, F.col(t) + DAY_S * F.coalesce(F.sum("_back").over(upto(w)), F.lit(0))).drop("_back")


def markers(df: DataFrame, mark: str = "mark", line: str = "line", order: str = "rid") -> DataFrame:
    """is_marker where the mark differs from the reading before on the line, both present, and isn't 0."""
    before = F.lag(mark).over(along([line], order))
    return df.withColumn("is_marker", F.coalesce((F.col(mark) != before) & (F.col(mark) != 0), F.lit(False)))


def sample_distance(df: DataFrame, spacing: float, line: str = "line", order: str = "rid") -> DataFrame:
    """The reading's number on its line, times the spacing."""
    return df.withColumn("dist", (F.row_number().over(along([line], order)) - 1) * F.lit(float(spacing)))


def first_readings(df: DataFrame, keys: list[str], order: str = "rid") -> DataFrame:
    """The first reading of each key; an aggregate, which combines before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def path_distance(df: DataFrame, line: str = "line", order: str = "rid", x: str = "x", y: str = "y") -> DataFrame:
    """The summed steps between positions on the line, from 0; readings without position have none."""
    w = along([line], order)
    px, py = (F.last(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)), True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in (x, y))
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - px, 2) + F.pow(F.col(y) - py, 2)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("dist", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.sum("_step").over(upto(w)))).drop("_step")


def marker_distance(df: DataFrame, spacing: float, line: str = "line", order: str = "rid") -> DataFrame:
    """The k-th marker of a line stands at k times the spacing; between markers by reading number; NULL outside them, or with fewer than two."""
    w = along([line], order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_k", F.sum(F.col("is_marker").cast("int")).over(upto(w)))
    at = F.when(F.col("is_marker"), F.struct(F.col("_n").alias("n"), (F.col("_k") - 1).alias("k")))
    df = df.withColumn("_a", F.last(at, True).over(upto(w))).withColumn("_b", F.last(at, True).over(upto(Window.partitionBy(line).orderBy(F.desc(order)))))
    share = F.coalesce(F.try_divide(F.col("_n") - F.col("_a.n"), F.col("_b.n") - F.col("_a.n")), F.lit(0.0))
    many = F.sum(F.col("is_marker").cast("int")).over(Window.partitionBy(line)) > 1
    value = (F.col("_a.k") + share * (F.col("_b.k") - F.col("_a.k"))) * F.lit(float(spacing))
    return df.withColumn("dist", F.when(many & F.col("_a").isNotNull() & F.col("_b").isNotNull(), value)).drop("_n", "_k", "_a", "_b")


def projection_distance(df: DataFrame, axis: tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Positions along the survey's axis, which points east or else north, from the least on (one small aggregate, broadcast)."""
    ax, ay = axis
    if ax < 0 or (ax == 0 and ay < 0):
        ax, ay = -ax, -ay
    p = F.col(x) * ax + F.col(y) * ay
    least = df.agg(F.min(p).alias("_least"))  # one row
    return df.crossJoin(F.broadcast(least)).withColumn("dist", p - F.col("_least")).drop("_least")


def second_differences(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    w = along(keys, order)
    return df.where(F.col(value).isNotNull()).withColumn("d1", F.col(value) - F.lag(value).over(w)).withColumn("d2", F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))


def robust_noise(df: DataFrame, value: str, keys: list[str], order: str, fallback: bool = False) -> DataFrame:
    """Per key, sigma: 1.4826 times the median deviation of second differences over the root of six. With under three of them NULL.
    W8 (fallback): where that deviation is 0, their standard deviation over the root of six."""
    d = second_differences(df, value, keys, order)
    mid = d.groupBy(*keys).agg(F.percentile("d2", F.lit(0.5)).alias("m"), F.count("d2").alias("n"))
    dev = d.join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("d2") - F.col("m")), F.lit(0.5)).alias("mad"), F.stddev_samp("d2").alias("sd"), F.first("n").alias("n"), F.min(F.when(F.abs("d1") > 0, F.abs("d1"))).alias("least_step"))
    sigma = 1.4826 * F.col("mad") / math.sqrt(6)
    if fallback:
        sigma = F.when(F.col("mad") == 0, F.col("sd") / math.sqrt(6)).otherwise(sigma)
    return dev.select(*keys, F.when(F.col("n") >= 3, sigma).alias("sigma"), "least_step")


def despiked(df: DataFrame, value: str, keys: list[str], order: str = "rid", window: int = 5, threshold: float = 4.0) -> DataFrame:
    """Blanks a value further than threshold * sigma from the median of a full centred window of present values. A sigma of 0 or NULL
    is replaced by the smallest non-zero step over the root of twelve; without one nothing is a spike."""
    half = window // 2
    frame = along(keys, order).rowsBetween(-half, half)
    noise = robust_noise(df, value, keys, order)
    spread = F.when(F.coalesce("sigma", F.lit(0.0)) > 0, F.col("sigma")).otherwise(F.col("least_step") / math.sqrt(12))
    df = df.withColumn("_mid", F.when(F.count(value).over(frame) == window, F.percentile(value, F.lit(0.5)).over(frame)))
    df = df.join(noise, keys, "left")
    spike = F.coalesce(F.abs(F.col(value) - F.col("_mid")) > threshold * spread, F.lit(False))
    return df.withColumn("is_spike", spike).withColumn(value, F.when(~spike, F.col(value))).drop("_mid", "sigma", "least_step")


def time_gap_lines(df: DataFrame, gap_s: float, t: str = "t", order: str = "rid") -> DataFrame:
    """W9 without usable coordinates: a new line after each pause of over gap_s seconds."""
    w = along([], order)
    start = F.coalesce(F.col(t) - F.last(t, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap_s, F.lit(False))
    df = df.withColumn("_start", start.cast("int"))
    return df.withColumn("inferred", F.sum("_start").over(upto(w)).cast("long")).drop("_start")


def constant_runs(df: DataFrame, coordinate: str, order: str = "rid", by: list[str] | None = None) -> DataFrame:
    """W9 with a constant coordinate: a new run wherever it changes."""
    w = along(by or [], order)
    return df.withColumn("_start", F.coalesce((F.col(coordinate) != F.lag(coordinate).over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("_start").over(upto(w)).cast("long")).drop("_start")


# Readings a line has on average at least, the pause in seconds and the steps of a jump back that start a new line.
LINE_READINGS, LINE_PAUSE_S, RESTART_STEPS = 10, 3.0, 5


def inferred_lines(df: DataFrame, order: str = "rid", x: str | None = "x", y: str | None = "y", t: str | None = "t") -> tuple[DataFrame, str]:
    """(the readings with `inferred`, the line's label as a number, and how lines were found) for one survey without line labels.

    A coordinate that is constant along each line starts a line where it changes (of two, the one that changes less often, if lines then have ten readings on average),
    and so does the other one where it jumps back to a line's start. Lines are then called by their coordinate if each has its own, or numbered from 0. A single
    coordinate column starts lines where it jumps back; else pauses do; else there is one line. Missing coordinates take the last one before, or the first one.

    Which rule holds follows from one aggregate; the flags from one window over the survey, whose order is all there is to go by.
    """
    w = along([], order)
    names = {n: c for n, c in (("x", x), ("y", y)) if c is not None and c in df.columns}
    filled = df
    for n, c in names.items():
        ahead = F.first(c, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        filled = filled.withColumn(f"_{n}", F.coalesce(F.last(c, True).over(upto(w)), ahead).cast("double"))
    for n in names:
        filled = filled.withColumn(f"_s{n}", F.col(f"_{n}") - F.lag(f"_{n}").over(w))
    steps = [F.col(f"_s{n}") for n in names]
    moving = [F.when(v != 0, v) for v in steps]
    facts = filled.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(f"_{n}").alias(f"have_{n}") for n in names], *[F.count(m).alias(f"turns_{n}") for n, m in zip(names, moving, strict=True)],
        *[F.percentile(m, F.lit(0.5)).alias(f"way_{n}") for n, m in zip(names, moving, strict=True)], *[F.percentile(F.abs(m), F.lit(0.5)).alias(f"step_{n}") for n, m in zip(names, moving, strict=True)],
    ).first()
    names = {n: c for n, c in names.items() if facts["n"] and facts[f"have_{n}"] == facts["n"]}

    def back(n: str):
        if not facts[f"way_{n}"]:
            return F.lit(False)
        against = F.col(f"_s{n}") < 0 if facts[f"way_{n}"] > 0 else F.col(f"_s{n}") > 0
        return F.coalesce(against & (F.abs(f"_s{n}") > RESTART_STEPS * facts[f"step_{n}"]), F.lit(False))

    def numbered(start, how: str) -> tuple[DataFrame, str]:
        out = filled.withColumn("_start", start.cast("int")).withColumn("inferred", F.sum("_start").over(upto(w)).cast("double"))
        return out.drop("_start", *[c for n in ("x", "y") for c in (f"_{n}", f"_s{n}")]), how

    runs = sorted((facts[f"turns_{n}"] + 1, n) for n in names if facts[f"turns_{n}"] + 1 <= max(1, facts["n"] // LINE_READINGS))
    if runs:
        n = runs[0][1]
        other = next((m for m in names if m != n), None)
        change = F.coalesce(F.col(f"_s{n}") != 0, F.lit(False))
        start = change | back(other) if other else change
        flagged = filled.withColumn("_start", start)
        count = flagged.agg(F.sum(start.cast("int")).alias("starts"), F.sum((start & ~change).cast("int")).alias("jumps")).first()
        first = filled.select(F.row_number().over(w).alias("_k"), f"_{n}", start.alias("_start")).where("_start or _k = 1")
        own = first.select(f"_{n}").distinct().count() == (count["starts"] or 0) + 1
        how = f"lines taken from runs of constant {n.upper()}" + (f" and where {other.upper()} restarts" if count["jumps"] else "")
        if not own:
            return numbered(start, how)
        return filled.withColumn("inferred", F.col(f"_{n}")).drop(*[c for m in ("x", "y") for c in (f"_{m}", f"_s{m}")]), how
    if len(names) == 1:
        (n,) = names
        jumps = back(n)
        if filled.where(jumps).limit(1).count():
            return numbered(jumps, f"lines split where {n.upper()} restarts")
    if t is not None and t in df.columns:
        out = time_gap_lines(df, LINE_PAUSE_S, t, order)
        return out.withColumn("inferred", F.col("inferred").cast("double")), f"lines split at pauses longer than {LINE_PAUSE_S:g} s"
    return df.withColumn("inferred", F.lit(0.0)), "the whole file is treated as one line"


def ranked(scores: DataFrame, score: str = "score", tie: str = "label", by: list[str] | None = None) -> DataFrame:
    """Best first, blank last, ties by name."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc_nulls_last(score), tie)
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def linear_drift(occupations: DataFrame, t: str = "t", v: str = "v") -> DataFrame:
    """The straight line through occupation means, one row (slope, intercept)."""
    return occupations.agg(F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"))


def piecewise_drift(readings: DataFrame, occupations: DataFrame, t: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Drift at each reading by linear interpolation between occupation means (of its channel, if `by` names it), flat beyond them. Occupations are tens of
    rows a channel; over 10,000 are refused."""
    if occupations.limit(10_001).count() > 10_000:
        raise ValueError("over 10,000 base-station occupations; merge them first")
    w = Window.partitionBy(*by).orderBy("ot")
    seg = occupations.select(*by, F.col(t).alias("ot"), F.col("v").alias("ov")).withColumn("nt", F.lead("ot").over(w)).withColumn("nv", F.lead("ov").over(w)).withColumn("is_first", F.row_number().over(w) == 1)
    seg = seg.withColumnsRenamed({c: f"_{c}" for c in by})
    r = F.col(t)
    inside = ((r >= F.col("ot")) | F.col("is_first")) & (r < F.coalesce("nt", F.lit(float("inf"))))
    for c in by:
        inside = inside & (F.col(c) == F.col(f"_{c}"))
    joined = readings.join(F.broadcast(seg), inside, "left" if by else "inner")
    value = F.when(r <= F.col("ot"), F.col("ov")).when(F.col("nt").isNull(), F.col("ov")).otherwise(F.col("ov") + (F.col("nv") - F.col("ov")) * (r - F.col("ot")) / (F.col("nt") - F.col("ot")))
    return joined.withColumn("drift", value).drop("ot", "ov", "nt", "nv", "is_first", *[f"_{c}" for c in by])
