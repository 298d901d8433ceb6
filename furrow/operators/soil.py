"""Soil tools: standardised features, principal scores, sampling design, property models, fuzzy zones. Sums in Spark, small matrices on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, features: list[str], robust: bool = False, clip: tuple[float, float] = (1.0, 99.0)) -> DataFrame:
    """(v - mean) / sample deviation; a constant feature is 0. Robust: clipped to two percentiles first. One broadcast row."""
    if robust:
        p = df.agg(*[F.percentile(f, F.array(F.lit(clip[0] / 100), F.lit(clip[1] / 100))).alias(f"_p{k}") for k, f in enumerate(features)])
        df = df.crossJoin(F.broadcast(p))
        df = df.withColumns({f: F.least(F.greatest(F.col(f), F.col(f"_p{k}")[0]), F.col(f"_p{k}")[1]) for k, f in enumerate(features)}).drop(*[f"_p{k}" for k in range(len(features))])
    m = df.agg(*[F.avg(f).alias(f"_m{k}") for k, f in enumerate(features)], *[F.stddev_samp(f).alias(f"_s{k}") for k, f in enumerate(features)])
    z = {f: F.when(F.col(f"_s{k}") > 0, (F.col(f) - F.col(f"_m{k}")) / F.col(f"_s{k}")).when(F.col(f).isNotNull(), 0.0) for k, f in enumerate(features)}
    return df.crossJoin(F.broadcast(m)).withColumns(z).drop(*[f"_{c}{k}" for k in range(len(features)) for c in "ms"])


def gram(df: DataFrame, features: list[str]) -> tuple[np.ndarray, int]:
    """The features' product sums and the number of rows: k * k numbers, whatever the rows."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    r = df.dropna(subset=features).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(features), len(features)))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, r["n"]


def principal_scores(df: DataFrame, features: list[str], components: int = 2, noise: float = 1e-6) -> DataFrame:
    """Z3: scores pc1.. of standardised features, each of deviation 1; components of hardly any variance are left out; the largest loading is positive."""
    z = standardised(df, features, robust=True)
    z = standardised(z, features)
    g, n = gram(z, features)
    values, vectors = np.linalg.eigh(g / max(1, n - 1))
    order = np.argsort(-values)[:components]
    out = {}
    for k, i in enumerate(order):
        if values[i] <= noise * values[order[0]]:
            break
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        out[f"pc{k + 1}"] = sum((F.lit(float(w)) * F.col(f) for w, f in zip(v, features, strict=True)), F.lit(0.0)) / math.sqrt(values[i])
    return z.withColumns(out)


def design_targets(sites: int, components: int) -> list[tuple[float, ...]]:
    """Where in score space sites should lie: normal quantiles on one axis, or a centre and rings of radius 1 and 1.75."""
    if components == 1:
        return [(NormalDist().inv_cdf((k + 0.5) / sites),) for k in range(sites)]
    inner = max(1, (sites - 1) // 2)
    out = [(0.0, 0.0)]
    for r, n in ((1.0, inner), (1.75, sites - 1 - inner)):
        out += [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return out[:sites]


def sampling_design(scored: DataFrame, sites: int, components: int = 2, pool: int = 20) -> list[dict]:
    """For each target the reading, of the `pool` nearest in score space, that is furthest in space from the sites chosen so far. Spark keeps the
    pool of each target in one pass; the choice goes over sites * pool rows."""
    pcs = [f"pc{k + 1}" for k in range(components)]
    chosen: list[dict] = []
    targets = design_targets(sites, components)
    dist = [sum(((F.col(c) - F.lit(t)) * (F.col(c) - F.lit(t)) for c, t in zip(pcs, at, strict=True)), F.lit(0.0)) for at in targets]
    rows = scored.select("id", "x", "y", F.posexplode(F.array(*dist)).alias("target", "d2"))
    from pyspark.sql import Window

    near = rows.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("d2", "id"))).where(F.col("k") <= pool).orderBy("target", "k").collect()
    for t in range(len(targets)):
        own = [r for r in near if r["target"] == t and r["id"] not in {c["id"] for c in chosen}]
        if not own:
            continue
        far = (lambda r: min((r["x"] - c["x"]) ** 2 + (r["y"] - c["y"]) ** 2 for c in chosen)) if chosen else (lambda r: -r["d2"])
        r = max(own, key=far)
        chosen.append({"site": t, "id": r["id"], "x": r["x"], "y": r["y"]})
    return chosen


def property_fit(samples: DataFrame, channels: list[str], target: str, logs: bool = True) -> dict:
    """Least squares of ln(property) on ln(EC): coefficients, R2, RMSE and that of leaving one sample out, by leverages. Two aggregates of one row: means and
    covariances, which give the same normal equations as the samples do, then sums of squares."""
    ok = samples.select(*channels, target).dropna()
    if logs:
        ok = ok.where(" and ".join(f"`{c}` > 0" for c in [*channels, target]))
    k = len(channels)
    names = [f"_{i}" for i in range(k + 1)]  # the target is the last
    ok = ok.select(*[(F.ln(F.col(f"`{c}`").cast("double")) if logs else F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip([*channels, target], names, strict=True)])
    r = ok.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in names], *[F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    n = r["n"]
    if n <= k + 2:
        raise ValueError("too few samples")
    mean = np.array([r[f"m{c}"] for c in names])
    cov = np.array([[r[f"c{names[min(i, j)]}{names[max(i, j)]}"] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.diag(cov)[:k])
    scale[scale == 0] = 1.0
    w, axes = np.linalg.eigh(cov[:k, :k] / np.outer(scale, scale))
    w[w < 1e-12 * max(w.max(), 1e-300)] = 0.0  # channels that say the same
    inverse = np.divide(1.0, w, out=np.zeros(k), where=w > 0)
    # k + 1 rows with the normal equations of all samples.
    a = np.r_[np.c_[1.0, mean[None, :k]], np.c_[np.zeros(k), (axes * np.sqrt(w)).T * scale]]
    coef, *_ = np.linalg.lstsq(a, np.r_[mean[k], np.sqrt(inverse) * (axes.T @ (cov[:k, k] / scale))], rcond=None)
    left = [F.col(c) - F.lit(float(m)) for c, m in zip(names, mean, strict=True)]
    e = left[k] - F.lit(float(coef[0] + coef[1:] @ mean[:k] - mean[k]))
    for c, v in zip(left, coef[1:], strict=False):
        e = e - F.lit(float(v)) * c
    within = (axes * inverse) @ axes.T / np.outer(scale, scale) / n
    lever = F.lit(1.0 / n)
    for i in range(k):
        for j in range(k):
            lever = lever + F.lit(float(within[i, j])) * left[i] * left[j]
    loo = e / F.greatest(1 - lever, F.lit(1e-12))
    s = ok.agg(F.sum(e * e).alias("e"), F.sum(loo * loo).alias("loo"), F.sum(left[k] * left[k]).alias("y")).first()
    return {"terms": ["1", *channels], "coef": coef.tolist(), "n": n, "r2": float(1 - s["e"] / s["y"]) if s["y"] else float("nan"), "rmse": math.sqrt(s["e"] / n), "loo": math.sqrt(s["loo"] / n), "logs": logs}


def predicted(df: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    """The model at every reading; NULL where a channel isn't positive."""
    f = (lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)))) if model["logs"] else F.col
    v: Column = F.lit(model["coef"][0])
    for c, w in zip(model["terms"][1:], model["coef"][1:], strict=True):
        v = v + F.lit(w) * f(c)
    return df.withColumn(name, F.exp(v) if model["logs"] else v)


def fuzzy_zones(df: DataFrame, features: list[str], c: int, m: float = 1.3, tol: float = 1e-6, most: int = 300, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Fuzzy c-means. Each step is one aggregate of c * (k + 1) sums over the rows; the memberships follow from the centres by expressions, so
    nothing is kept between the steps but the centres. Zones are ordered by their first feature. Starts from c rows spread over a bounded hashed sample."""
    z = df.dropna(subset=features).persist()  # read once for each step; lost parts are computed again
    sample = z.orderBy(F.xxhash64(F.lit(seed), *features)).limit(1000).select(*features).collect()
    if len(sample) < c:
        raise ValueError("fewer rows than zones")
    s = np.array([[float(r[f]) for f in features] for r in sample])
    centres = [s[0]]
    for _ in range(c - 1):  # the next start is the row furthest from those chosen
        centres.append(s[np.argmax(np.min([((s - q) ** 2).sum(1) for q in centres], axis=0))])
    v = np.array(centres)
    for _ in range(most):
        u = memberships(features, v, m)
        sums = [F.sum(F.pow(u[i], F.lit(m))).alias(f"w{i}") for i in range(c)] + [F.sum(F.pow(u[i], F.lit(m)) * F.col(f)).alias(f"s{i}_{k}") for i in range(c) for k, f in enumerate(features)]
        r = z.agg(*sums).first()
        new = np.array([[r[f"s{i}_{k}"] / r[f"w{i}"] for k in range(len(features))] for i in range(c)])
        moved, v = float(np.abs(new - v).max()), new
        if moved < tol:
            break
    v = v[np.argsort(v[:, 0], kind="stable")]
    u = memberships(features, v, m)
    out = z.withColumns({f"u{i + 1}": u[i] for i in range(c)})
    top = F.greatest(*[F.col(f"u{i + 1}") for i in range(c)])
    zone = F.coalesce(*[F.when(F.col(f"u{i + 1}") == top, i + 1) for i in range(c)])
    return out.withColumn("zone", zone), v


def memberships(features: list[str], centres: np.ndarray, m: float) -> list[Column]:
    d = [F.greatest(F.sqrt(sum(((F.col(f) - F.lit(float(x))) * (F.col(f) - F.lit(float(x))) for f, x in zip(features, q, strict=True)), F.lit(0.0))), F.lit(1e-12)) for q in centres]
    p = 2 / (m - 1)
    return [1 / sum((F.pow(d[i] / d[j], F.lit(p)) for j in range(len(d))), F.lit(0.0)) for i in range(len(d))]


def zone_indices(u: DataFrame, names: list[str]) -> DataFrame:
    """Fuzziness performance index and modified partition entropy, one row."""
    c = len(names)
    sq = F.sum(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    ent = F.sum(sum((F.col(n) * F.ln(F.when(F.col(n) > 0, F.col(n)).otherwise(1.0)) for n in names), F.lit(0.0)))
    n = F.count(F.lit(1))
    return u.agg((c / (c - 1) * (1 - sq / n)).alias("fpi"), (-ent / (n * math.log(c))).alias("mpe"))


def select_channels(ranked: list[tuple[str, float | None]], corr: dict[tuple[str, str], float], most: int = 3, limit: float = 0.95) -> list[tuple[str, str]]:
    """Channels best first, each kept unless it is correlated above the limit with one kept; (label, reason)."""
    kept: list[str] = []
    out = []
    for label, score in ranked:
        twin = next((k for k in kept if abs(corr.get((min(k, label), max(k, label)), 0.0)) > limit), None)
        if score is None:
            out.append((label, "no score"))
        elif twin:
            out.append((label, f"redundant with {twin}"))
        elif len(kept) >= most:
            out.append((label, "enough"))
        else:
            kept.append(label)
            out.append((label, "selected"))
    return out
