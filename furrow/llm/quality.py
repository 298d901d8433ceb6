"""Quality rules with robust multivariate outliers.

Counts of each text make a transformed vector. For each language and source, a minimum (regularised) covariance determinant
estimate is sought: of all shares `h` of the group's rows, the one whose covariance, with a small diagonal added, has the
least determinant. Three deterministic starts (median deviations, the correlations of squashed values, those of directions
from the median) are improved by concentration steps until no determinant falls any more: the rows with the smallest
distance from an estimate give the next. The start that ends lowest is taken. Rows too far from it, in Mahalanobis
distance, are rejected. A group of bounded size is estimated by one task. Larger ones never meet in a task: there every step is two
aggregates over saved vectors of a few numbers a row, for all groups and starts at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import WORD, Scratch

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_word = re.compile(WORD)


@dataclass(frozen=True)
class Settings:
    """h: the share that an estimate rests on. tail: the chance by which a row of a normal group is rejected. least: rows that an estimate of
    covariances needs, five for each part; smaller groups are held against all rows of their language, or of the corpus. floors: deviations whose
    squares are added to the covariances, shrunk by `shrink`; a part that never varies so has this deviation. settled: the change of a determinant's
    logarithm that counts as none. most: steps after which the search ends even so. together: rows of a group that one task takes at most, five
    numbers each."""

    h: float = 0.75
    tail: float = 1e-5
    least: int = 25
    floors: tuple[float, ...] = (0.7, 0.5, 0.7, 0.6, 0.6)
    shrink: float = 0.8
    settled: float = 1e-4
    most: int = 40
    together: int = 200_000
    groups_sent: int = 10_000


NAMES = ("length", "word_length", "symbols", "dup_lines", "repeats")


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _word.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif _word.search(line):
                seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[str, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        m = len(ids)
        pair = x[:-1] * m + x[1:]
        if m > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        _, inverse, times = np.unique(pair[:-1] * m + x[2:], return_inverse=True, return_counts=True)
        start = np.flatnonzero(times[inverse] > 1)
        if len(start):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + 3, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


def vector(n: int, chars: int, symbols: int, dup: int, repeat: int, lines: int) -> tuple[float, ...]:
    """Shares as logarithms: each part can lie so far out that it alone rejects a text."""
    return math.log(n), chars / n, math.log(1e-3 + symbols / (chars + 1)), math.log(1e-2 + dup / max(1, lines)), math.log(1e-2 + repeat / n)


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(degrees / 2, mid / 2) < p else (low, mid)
    return low


def prediction_quantile(p: float, degrees: int, n: int) -> float:
    """Of a further row's squared distance from the estimate of n normal rows; for large n, chi2_quantile."""
    n = max(n, degrees + 1)
    t = np.linspace(0, math.pi / 2, 400_001)
    weight = np.sin(t) ** (degrees - 1) * np.cos(t) ** (n - degrees - 1)
    beyond = np.cumsum(weight[::-1])[::-1] / weight.sum()
    at = t[np.flatnonzero(beyond >= 1 - p)[-1]]
    return (n * n - 1) / n * math.tan(at) ** 2


def statistics(docs: DataFrame, id_col: str, text_col: str, by: tuple[str, ...]) -> DataFrame:
    """Per row: _id, the group columns, the counts, and the vector's parts (null for texts without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["_text"]:
                c = counts(t)
                rows.append((*c, *(vector(*c, t.count("\n") + 1) if c[0] else [None] * len(NAMES))))
            made = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *NAMES], index=b.index)
            yield pd.concat([b.drop(columns="_text"), made], axis=1)

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)])).alias("_fine"), F.to_json(F.struct(F.col(by[0]).cast("string").alias("k0"))).alias("_coarse"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.mapInPandas(run, f"_id string, _fine string, _coarse string, {longs}, " + ", ".join(f"{c} double" for c in NAMES)).withColumn("_id", F.col("_id").cast(key))


def _distance(p: int):
    """The squared Mahalanobis distance from columns z0.., m0.. and the inverse's i00, i01.."""
    d = [F.col(NAMES[j]) - F.col(f"m{j}") for j in range(p)]
    return sum((F.col(f"i{j}{k}") * d[j] * d[k] * (1 if j == k else 2) for j in range(p) for k in range(j, p)), F.lit(0.0))


#: Starts of the search.
STARTS = ("deviations", "squashed", "directions")


def regularised(cov: np.ndarray, s: Settings, factor: float) -> np.ndarray:
    return np.diag(np.array(s.floors) ** 2) + s.shrink * factor * cov


def estimated(x: np.ndarray, s: Settings, concentrate: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the logarithm of its determinant for the rows of one group."""
    p = x.shape[1]
    factor = s.h / _gamma_p(p / 2 + 1, chi2_quantile(s.h, p) / 2)
    rank = max(1, math.ceil(s.h * len(x))) - 1
    lower = lambda v: np.partition(v, (len(v) + 1) // 2 - 1, axis=0)[(len(v) + 1) // 2 - 1]  # noqa: E731  the lower median, a row's own value
    mid = lower(x)
    best = None
    for cov in starts(x - mid, np.maximum(1.4826 * lower(np.abs(x - mid)), s.floors), concentrate):
        mean, det = mid, np.linalg.slogdet(cov)[1]
        for _ in range(s.most if concentrate else 0):
            y = x - mean
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov), y)
            own = y[d <= np.partition(d, rank)[rank]]
            shift = own.mean(axis=0)
            cov = regularised(own.T @ own / len(own) - np.outer(shift, shift), s, factor)
            mean, before, det = mean + shift, det, np.linalg.slogdet(cov)[1]
            if abs(det - before) <= s.settled:
                break
        if best is None or det < best[2]:
            best = mean, np.linalg.inv(cov), float(det)
    return best


def starts(y: np.ndarray, dev: np.ndarray, all_of_them: bool) -> list[np.ndarray]:
    """First covariances from the rows less their medians and the median deviations."""
    p, wide, z = y.shape[1], np.outer(dev, dev), y / dev
    out = [np.eye(p) * wide]
    if all_of_them:
        t, u = np.tanh(z), z / np.sqrt((z * z).sum(axis=1, keepdims=True) + 1e-12)
        out += [alike(t.T @ t / len(z)) * wide, (p * u.T @ u / len(z) + 0.05 * np.eye(p)) * wide]
    return out


def alike(t: np.ndarray) -> np.ndarray:
    """Correlations from squared sums, drawn in a little so that they can be inverted."""
    scale = np.sqrt(np.einsum("...jj->...j", t)) + 1e-12
    return np.where(np.eye(t.shape[-1]) > 0, 1.0, 0.95 * t / (scale[..., :, None] * scale[..., None, :]))


def mcd(spark: SparkSession, scratch: Scratch, rows: DataFrame, s: Settings, concentrate: bool = True) -> DataFrame:
    """Per _group: its mean m0.., the inverse of its covariance i00.. and the logarithm of that one's determinant; rows have _group and the vector's parts.
    concentrate: False for the first start alone, medians and deviations."""
    p = len(NAMES)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    columns = [f"m{j}" for j in range(p)] + [f"i{j}{k}" for j, k in pairs] + ["_det"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, inverse, det = estimated(pdf[list(NAMES)].to_numpy(float), s, concentrate)
        return pd.DataFrame([[pdf["_group"].iloc[0], *mean, *(inverse[j, k] for j, k in pairs), det]], columns=["_group", *columns])

    sizes = scratch.save(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")))
    few = sizes.count() <= s.groups_sent
    small = F.broadcast if few else (lambda df: df)  # one row for each group: broadcast only after their count
    sized = rows.select("_group", *NAMES).join(small(sizes), "_group")
    out = sized.where(F.col("_rows") <= s.together).drop("_rows").groupBy("_group").applyInPandas(one, "_group string, " + ", ".join(f"{c} double" for c in columns))
    if not sizes.where(F.col("_rows") > s.together).isEmpty():
        out = out.unionByName(_large(scratch, sized.where(F.col("_rows") > s.together).drop("_rows"), s, concentrate))
    return small(scratch.save(out))


def _large(scratch: Scratch, rows: DataFrame, s: Settings, concentrate: bool) -> DataFrame:
    """mcd() for groups that no task could hold."""
    p = len(NAMES)
    factor = s.h / _gamma_p(p / 2 + 1, chi2_quantile(s.h, p) / 2)  # makes the covariance of the nearest share that of all rows of a normal group
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    columns = [f"m{j}" for j in range(p)] + [f"i{j}{k}" for j, k in pairs] + ["_det"]
    schema = "_group string, _start string, " + ", ".join(f"{c} double" for c in columns)

    def symmetric(b: pd.DataFrame, name: str) -> np.ndarray:
        out = np.empty((len(b), p, p))
        for j, k in pairs:
            out[:, j, k] = out[:, k, j] = b[f"{name}{j}{k}"].to_numpy(float)
        return out

    def out(names, start, means: np.ndarray, covs: np.ndarray) -> pd.DataFrame:
        inv, det = np.linalg.inv(covs), np.linalg.slogdet(covs)[1]
        made = pd.DataFrame(np.c_[means, np.stack([inv[:, j, k] for j, k in pairs], axis=1), det], columns=columns)
        made.insert(0, "_start", start)
        made.insert(0, "_group", list(names))
        return made

    def first(batches):
        for b in batches:
            dev = np.maximum(1.4826 * b[[f"d{j}" for j in range(p)]].to_numpy(float), s.floors)
            means, n, wide = b[[f"m{j}" for j in range(p)]].to_numpy(float), b["n"].to_numpy(float), dev[:, :, None] * dev[:, None, :]
            yield out(b["_group"], STARTS[0], means, np.eye(p) * wide)
            if concentrate:
                yield out(b["_group"], STARTS[1], means, alike(symmetric(b, "t") / n[:, None, None]) * wide)
                yield out(b["_group"], STARTS[2], means, (p * symmetric(b, "u") / n[:, None, None] + 0.05 * np.eye(p)) * wide)

    def following(batches):
        for b in batches:
            n = b["n"].to_numpy(float)
            mean = b[[f"s{j}" for j in range(p)]].to_numpy(float) / n[:, None]
            cov = symmetric(b, "q") / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            for start, own in b.groupby("_start", sort=False):
                k = b.index.get_indexer(own.index)
                at = own[[f"c{j}" for j in range(p)]].to_numpy(float)
                yield out(own["_group"], start, at + mean[k], np.stack([regularised(c, s, factor) for c in cov[k]]))

    med = scratch.save(rows.groupBy("_group").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"m{j}") for j, c in enumerate(NAMES)]))
    small = F.broadcast if med.count() <= s.groups_sent else (lambda df: df)  # one row for each group: broadcast only after their count
    dev = rows.join(small(med), "_group").groupBy("_group").agg(*[F.first(f"m{j}").alias(f"m{j}") for j in range(p)], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{j}")), 0.5, 10_000).alias(f"d{j}") for j, c in enumerate(NAMES)])
    dev = scratch.save(dev)
    z = [(F.col(c) - F.col(f"m{j}")) / F.greatest(1.4826 * F.col(f"d{j}"), F.lit(s.floors[j])) for j, c in enumerate(NAMES)]
    norm = F.sqrt(sum((x * x for x in z), F.lit(1e-12)))
    shape = rows.join(small(dev.select("_group", *[f"m{j}" for j in range(p)], *[f"d{j}" for j in range(p)])), "_group").groupBy("_group")
    shape = shape.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.tanh(z[j]) * F.tanh(z[k])).alias(f"t{j}{k}") for j, k in pairs], *[F.sum(z[j] * z[k] / (norm * norm)).alias(f"u{j}{k}") for j, k in pairs])
    now = scratch.save(dev.join(shape, "_group").mapInPandas(first, schema))
    keys = ["_group", "_start"]
    for _ in range(s.most if concentrate else 0):
        far = rows.join(small(now), "_group").withColumn("_d", _distance(p))
        edge = scratch.save(far.groupBy(*keys).agg(F.percentile_approx("_d", s.h, 10_000).alias("_edge")))
        near = far.join(small(edge), keys).where("_d <= _edge")
        y = [F.col(c) - F.col(f"m{j}") for j, c in enumerate(NAMES)]
        sums = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(f"m{j}").alias(f"c{j}") for j in range(p)], *[F.sum(y[j]).alias(f"s{j}") for j in range(p)], *[F.sum(y[j] * y[k]).alias(f"q{j}{k}") for j, k in pairs])
        new = scratch.save(sums.mapInPandas(following, schema))
        moved = now.select(*keys, F.col("_det").alias("_was")).join(new, keys).agg(F.max(F.abs(F.col("_det") - F.col("_was")))).first()[0]
        now = new
        if moved is None or moved <= s.settled:
            break
    return now.groupBy("_group").agg(F.min_by(F.struct(*columns), F.struct("_det", "_start")).alias("_best")).select("_group", "_best.*")


def quality(spark: SparkSession, docs: DataFrame, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. Estimates rest on all
    rows that pass. Null and empty texts have no words and fail. A null language or source is a
    group of its own. Groups too small for an estimate are held against all rows of their language, or if these are too
    few of the corpus. distance is null where no row of the group passes. Repeated rows give a row each; an empty table gives none.
    Columns other than the id, the text and those of `by`, whatever their names, aren't read. A very long text is counted whole, in memory some hundred
    times its words.
    """
    s = s or Settings()
    scratch = Scratch(spark)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = scratch.save(statistics(docs, id_col, text_col, by).withColumn("base_failed", failed))
    passed = rows.where(~F.col("base_failed"))
    sizes = scratch.save(passed.groupBy("_fine", "_coarse").agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    fine, coarse, corpus = F.concat(F.lit("f"), F.col("_fine")), F.concat(F.lit("c"), F.col("_coarse")), F.lit("all")
    per = sizes.join(sizes.groupBy("_coarse").agg(F.sum("_n").alias("_m")), "_coarse")
    own = F.when(F.col("_n") >= s.least, fine).when(F.col("_m") >= s.least, coarse).otherwise(corpus)
    named = scratch.save(per.select("_fine", "_coarse", own.alias("_group")))
    # A row counts in every estimate of a group that holds it and that some row is held against.
    rests = named.select("_fine", F.explode(F.array(fine, coarse, corpus)).alias("_group")).join(named.select("_group").distinct(), "_group", "left_semi")
    rests = scratch.save(rests)
    small = F.broadcast if rests.count() <= s.groups_sent else (lambda df: df)
    enough = total >= s.least  # or else the medians and deviations of so few rows decide, with the cutoff of so few
    estimates = mcd(spark, scratch, rows.where(~F.col("base_failed")).join(small(rests), "_fine"), s, enough)
    far = rows.join(small(named.select("_fine", "_group")), "_fine", "left").join(estimates, "_group", "left").withColumn("_d", _distance(len(NAMES)))
    cutoff = chi2_quantile(1 - s.tail, len(NAMES)) if enough else prediction_quantile(1 - s.tail, len(NAMES), total)
    return far.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("_d") <= cutoff, F.lit(True))).alias("kept"), F.sqrt("_d").alias("distance"))
