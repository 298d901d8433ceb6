"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window is compressed once
against the ordinary one and once against the toxic one put behind it, so that what both kinds of text share
costs the same either way; a window that gets shorter the second time resembles toxic text. The score is a
logistic curve over the counts of a text's windows above each of several thresholds, whose weights are
calibrated on labelled texts that the dictionaries have not seen.

Toxic texts are mostly ordinary, so the toxic dictionary is trained on those of their words whose beginnings
ordinary training texts hardly have.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD, bounded_batches, fresh, lean, using


@dataclass(frozen=True)
class Settings:
    """width, stride: of a window, in bytes. often, ratio, stem: see residue(). sample: labelled texts of each class that are fitted on, at
    most, each whole, however long. size: of a dictionary."""

    width: int = 48
    stride: int = 32
    sample: int = 3000
    size: int = 8192
    ordinary_size: int = 32_768
    segment: int = 16
    often: float = 0.02
    ratio: float = 10.0
    stem: int = 4
    level: int = 3
    match: int = 6


@dataclass
class Model:
    settings: Settings
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    constant: float | None = None  # the score of every text where the labels have one class or none


def distinct(texts: list[str]) -> list[str]:
    """Without near copies of earlier ones, so that one text copied often doesn't pass for what many texts have in
    common: a text goes if a quarter of the 32 smallest hashes of its five-word runs were among those of one kept."""
    kept, seen = [], set()
    for t in texts:
        w = re.findall(WORD, t)
        runs = {zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 4))}
        least = sorted(runs)[:32]
        if sum(x in seen for x in least) * 4 < len(least):
            seen.update(least)
            kept.append(t)
    return kept


def residue(toxic: list[str], ordinary: list[str], s: Settings) -> list[bytes]:
    """Of each toxic text, its words with a beginning that ordinary texts hardly have: one of `stem` letters or more (or the whole word) that a share `often`
    of the toxic texts has (three at least, in small samples two), at least `ratio` times as often as ordinary ones."""

    def stems(w: str) -> list[str]:
        return [w[:k] for k in range(min(s.stem, len(w)), min(len(w), 24) + 1)]

    words = [[re.findall(WORD, t.lower()) for t in x] for x in (toxic, ordinary)]
    seen = [Counter(p for t in x for p in {p for w in set(t) for p in stems(w)}) for x in words]
    least = max(3, s.often * len(toxic)) if len(toxic) >= 50 else 2
    own = {p for p, n in seen[0].items() if n >= least and n * len(ordinary) >= s.ratio * (seen[1][p] + 0.5) * len(toxic)}
    return [y for t in words[0] if (y := " ".join(w for w in t if any(p in own for p in stems(w))).encode("utf-8", "replace"))]


def windows(text: str, width: int, stride: int) -> list[bytes]:
    """Windows over the whole text, in lower case and UTF-8, the last one ending with the text."""
    b = text.lower().encode("utf-8", "replace")
    last = max(0, len(b) - width)
    return [b[i : i + width] for i in range(0, last, stride)] + [b[last:]]


def _train(samples: list[bytes], size: int, s: Settings) -> bytes:
    """A dictionary of the samples; where there are too few to train on, their text itself."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=s.segment, d=6, level=s.level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:] or b"-" * 8


class Lengths:
    """How much shorter each window gets with the toxic dictionary than with the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes, s: Settings):
        log = max(10, (len(toxic) + len(ordinary) + s.width).bit_length())
        how = zstandard.ZstdCompressionParameters.from_level(s.level, window_log=log, min_match=s.match, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = []
        for content in (ordinary + toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, w: list[bytes]) -> np.ndarray:
        a, b = self.pair
        return np.array([len(b.compress(x)) - len(a.compress(x)) for x in w], float)


def features(d: np.ndarray) -> list[float]:
    """How many windows get shorter by at least 1, 2 ... 8 bytes, the best, the best three, and how many there are, as logarithms."""
    top = np.sort(d)[::-1][:3]
    return [*(float(np.log1p((d >= k).sum())) for k in range(1, 9)), float(top[0]), float(top.mean()), float(np.log(len(d)))]


class Scorer:
    def __init__(self, m: Model):
        self.m, self.lengths = m, None if m.constant is not None else Lengths(m.toxic, m.ordinary, m.settings)

    def __call__(self, text: str) -> float:
        m = self.m
        if m.constant is not None:
            return m.constant
        x = (np.array(features(self.lengths(windows(text, m.settings.width, m.settings.stride)))) - m.centre) / m.scale
        return float(1 / (1 + np.exp(-np.clip(m.weights[0] + x @ np.array(m.weights[1:]), -30, 30))))


def fit(toxic: list[str], ordinary: list[str], s: Settings | None = None, rate: float | None = None) -> Model:
    """A model from labelled texts. rate: the share of toxic texts among all labelled ones, if it is another than here. With one class only, every score is 1 or 0; with none, 0."""
    s = s or Settings()
    if not toxic or not ordinary:
        return Model(s, constant=1.0 if toxic else 0.0)
    rate = rate or len(toxic) / (len(toxic) + len(ordinary))
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    learn = [x[::2] for x in (toxic, ordinary)]
    check = [x[1::2] or x for x in (toxic, ordinary)]
    plain = _train([x for t in learn[1] for x in windows(t, s.width, s.width)], s.ordinary_size, s)
    found = residue(*learn, s) or [x for t in learn[0] for x in windows(t, s.width, s.width)]
    dicts = _train(found, s.size, s), plain
    lengths = Lengths(*dicts, s)
    seen = [[lengths(windows(t, s.width, s.stride)) for t in x] for x in check]
    x = np.array([features(d) for c in seen for d in c])
    y = np.r_[np.ones(len(seen[0])), np.zeros(len(seen[1]))]
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    centre, scale = x.mean(0), x.std(0) + 1e-9
    return Model(s, *dicts, _logistic((x - centre) / scale, y, weight).tolist(), centre.tolist(), scale.tolist())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps, the constant first and unpenalised."""
    x = np.c_[np.ones(len(x)), x]
    pen = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + pen, x.T @ (weight * (y - p)) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, may_learn, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `sample` labelled texts of each class, those with the smallest hash of their id.

    may_learn: a condition on the id; other rows are never fitted on. Rows of null id, label or text are
    passed over. Only the chosen ids are broadcast: at most 2 * sample. The driver holds their texts, whole.
    """
    s = s or Settings()
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & may_learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).distinct()
    n = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id").cast("string")]
    some = marked.where("_toxic = 1").orderBy(*order).limit(s.sample).unionByName(marked.where("_toxic = 0").orderBy(*order).limit(s.sample))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(some), "_id").select("_id", "_toxic", "_text").collect()
    rows.sort(key=lambda r: (str(r["_id"]), r["_text"]))
    rate = n.get(1, 0) / max(1, sum(n.values()))
    return fit([r["_text"] for r in rows if r["_toxic"]], [r["_text"] for r in rows if not r["_toxic"]], s, rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its id, the columns in `keep`, and last its score (0 to 1; _score, or with more underscores if there is one). One map over whole texts, no shuffle.

    Null texts count as empty; an empty text is one empty window and gets a score too. Repeated rows give a
    row each, an empty table none; null ids stay null.
    """
    bounded_batches(docs.sparkSession)
    names = [id_col, *keep]
    whole, scored = fresh(docs, "_whole", "_score")
    rows = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias(whole))
    schema = rows.drop(whole).withColumn(scored, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        scorer = Scorer(model)
        for b in batches:
            scores = pa.array([scorer(t) for t in b.column(whole).to_pylist()], pa.float64())
            yield b.drop_columns([whole]).append_column(scored, scores)

    return rows.mapInArrow(lean(run), schema)


def learns(id_col: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5).

    A null or empty text is scored as one empty window; a null id is not held out and stays null; repeated rows give a row each, an empty
    table none. Other columns, whatever their names, aren't read. A very long text is scored whole, window by window, in memory
    some ten times its length.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels, learns(), s))
    return out.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
