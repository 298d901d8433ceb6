"""Embedding near-duplicates by forests of random-projection trees.

A tree splits the unit vectors by a random direction for each level, at the median or nearby where fewer vectors are close to the cut, again and
again. A few shallow trees, fitted on a bounded sample, deal the vectors into parts, one tree after the other; so a vector moves once for each of
these trees, as it came, and what a tree moved is gone before the next. A part meets in one task, where a forest of deeper trees splits it into
leaves. All pairs within a leaf are compared, and only those whose cosine in double precision is at or above the threshold are links. A pair
is counted in the first part, in the order of trees, that holds both, and there in the first leaf.

A node most of whose vectors lie close to the cut is a group of near copies, and isn't split. Parts that stay large are dealt into blocks, and each two of
these meet in a task. A task returns numbers of links and enough links to connect its vectors, never its pairs.

Equal vectors are one class. Vectors of different lengths have trees of their own and never meet.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Scratch
from furrow.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """trees: that deal vectors into parts. inner: trees within a part. leaf: vectors that an inner leaf is to hold. near: half the width of the band around a cut, in units of
    the distance between vectors at the threshold over the square root of the dimensions. tight: share of a node's vectors within the band from which on it isn't
    split. sample: vectors that the dealing trees are fitted on, about, of a larger table. large: vectors from which on a part is dealt into blocks. block: of a large part. tile: vectors whose
    cosines with as many others are held at once."""

    threshold: float = 0.9
    trees: int = 6
    inner: int = 12
    leaf: int = 512
    near: float = 0.5
    tight: float = 0.6
    sample: int = 20_000
    large: int = 262_144
    block: int = 131_072
    tile: int = 1024
    seed: int = 11


class Tree:
    """Splits as arrays: node k has children 2k + 1 and 2k + 2. The directions, one for each level, follow from the seed alone. A cut at minus infinity leaves a
    node whole."""

    def __init__(self, seed: list[int], size: int, depth: int, s: Settings):
        self.depth, self.s = depth, s
        self.margin = s.near * math.sqrt(2 - 2 * s.threshold) / math.sqrt(size)
        self.directions = np.random.default_rng(seed).standard_normal((size, depth))
        self.directions /= np.linalg.norm(self.directions, axis=0)
        self.cuts = np.full((1 << depth) - 1, -np.inf)

    def _cut(self, p: np.ndarray) -> float:
        p = np.sort(p)
        at = p[(np.array([0.5, 0.35, 0.425, 0.575, 0.65]) * len(p)).astype(int)]
        close = (np.searchsorted(p, at + self.margin) - np.searchsorted(p, at - self.margin)) / len(p)
        best = int(np.argmin(close))
        if close[best] >= 0.7 * close[0]:
            best = 0
        return float(at[best]) if close[best] <= self.s.tight else -math.inf

    def fit(self, x: np.ndarray, least: int = 1) -> np.ndarray:
        """Fits the cuts of nodes of more than `least` vectors; the leaf of each vector."""
        p = x @ self.directions.astype(x.dtype)
        node = np.zeros(len(x), np.int64)
        rows = {0: np.arange(len(x))}
        for k in range(len(self.cuts)):
            own = rows.pop(k, None)
            if own is None:
                continue
            level = (k + 1).bit_length() - 1
            if len(own) > least:
                self.cuts[k] = self._cut(p[own, level])
            high = p[own, level] >= self.cuts[k]
            for child, part in ((2 * k + 1, own[~high]), (2 * k + 2, own[high])):
                if len(part):
                    rows[child] = part
                    node[part] = child
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The number of each vector's leaf, from 0."""
        p = x @ self.directions.astype(x.dtype)
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (p[:, level] >= self.cuts[node])
        return node - ((1 << self.depth) - 1)


def unit(values) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or holds null or non-finite parts."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64) if not isinstance(values, np.ndarray) or values.dtype == object else values.astype(np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def units(body, size: int, kind: str) -> np.ndarray:
    """As unit, for many vectors as they came."""
    x = np.frombuffer(body, kind).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted_depth(vectors: int, sample: int, s: Settings) -> int:
    """Levels of the dealing trees, until a part holds half of what is large, or a sixteenth of a smaller table; not more than leave eight of the sample to a part."""
    part = max(1, min(s.large // 2, max(2048, vectors // 16)))
    return max(0, min(math.ceil(math.log2(max(1.0, vectors / part))), int(math.log2(max(1.0, sample / 8)))))


class Linked:
    """The links among vectors: how many each has, and which are connected."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, s: Settings):
        """raw: as they came, a row each."""
        self.raw, self.weight, self.s = raw, weight, s
        self.n, self.parent = np.zeros(len(raw), np.int64), list(range(len(raw)))
        self.x = np.empty(raw.shape, np.float32)
        for at in range(0, len(raw), 10_000):
            self.x[at : at + 10_000] = units(raw[at : at + 10_000].tobytes(), raw.shape[1], raw.dtype.str)
        self.slack = 1.2e-7 * (raw.shape[1] + 16)  # of a cosine in single precision

    def find(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def compare(self, a: np.ndarray, b: np.ndarray | None, wanted) -> None:
        """Links between the vectors a and b, or among a, of those pairs that are wanted(i, j)."""
        t, kind, size = self.s.threshold, self.raw.dtype.str, self.raw.shape[1]
        g = self.x[a] @ self.x[a if b is None else b].T
        at = np.flatnonzero(g >= t - self.slack)
        if b is None and len(at) <= len(a):  # each with itself
            at = at[at // len(a) != at % len(a)]
        if not len(at):
            return
        p, q = np.divmod(at, g.shape[1])
        g = g.ravel()[at]
        if b is None:
            low = p < q
            p, q, g = p[low], q[low], g[low]
            b = a
        ok = wanted(a[p], b[q])
        p, q, g = p[ok], q[ok], g[ok]
        unsure = np.flatnonzero(g < t + self.slack)
        gone = np.zeros(len(g), bool)
        for k in range(0, len(unsure), 50_000):
            u = unsure[k : k + 50_000]
            v, w = (units(self.raw[r].tobytes(), size, kind) for r in (a[p[u]], b[q[u]]))
            gone[u] = (v * w).sum(axis=1) < t
        p, q = p[~gone], q[~gone]
        if not len(p):
            return
        self.n[a] += np.bincount(p, self.weight[b[q]], len(a)).astype(np.int64)
        self.n[b] += np.bincount(q, self.weight[a[p]], len(b)).astype(np.int64)
        root = [np.zeros(len(r), np.int64) for r in (a, b)]
        for names, rows, hit in ((root[0], a, np.unique(p)), (root[1], b, np.unique(q))):
            names[hit] = [self.find(k) for k in rows[hit].tolist()]
        i, j = root[0][p], root[1][q]
        for pair in np.unique((i * len(self.parent) + j)[i != j]).tolist():
            i, j = (self.find(k) for k in divmod(pair, len(self.parent)))
            self.parent[max(i, j)] = min(i, j)


def links_within(raw: np.ndarray, weight: np.ndarray, s: Settings, seed: list[int], earlier: np.ndarray, side: np.ndarray | None = None) -> Linked:
    """The links among the vectors of a part, by a forest, but for pairs that are equal in a column of `earlier`. With side, only links between the two sides."""
    out, n = Linked(raw, weight, s), len(raw)
    leaves: list[np.ndarray] = []
    depth = max(0, math.ceil(math.log2(n / s.leaf)))
    for k in range(s.inner):
        own = Tree([*seed, k], raw.shape[1], depth, s).fit(out.x, s.leaf)
        order = np.lexsort((leaves[0], own)) if leaves else np.argsort(own, kind="stable")
        edges = np.r_[0, np.flatnonzero(np.diff(own[order])) + 1, n].tolist()

        def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.ones(len(i), bool) if side is None else side[i] != side[j]
            for before in [*earlier.T, *leaves]:  # noqa: B023
                ok &= before[i] != before[j]
            return ok

        for lo, hi in zip(edges, edges[1:], strict=False):
            tiles = [order[q : min(hi, q + s.tile)] for q in range(lo, hi, s.tile)]
            for i, a in enumerate(tiles):
                for b in tiles[i:]:
                    if leaves and leaves[0][a[0]] == leaves[0][b[-1]] and leaves[0][a[0]] == leaves[0][a[-1]] == leaves[0][b[0]]:
                        continue  # in order of their first leaves: all were compared there
                    out.compare(a, None if b is a else b, wanted)
        leaves.append(own)
        if len(edges) == 2:  # one leaf held all
            break
    return out


def near(spark: SparkSession, vectors: DataFrame, s: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (the smallest id reachable), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, and vectors link only with
    those of their length; rows that repeat id and vector are rows of their own, linked with each other. A
    null id takes part; its component is the smallest other id reachable, or null. An empty table gives none. Other
    columns, whatever their names, aren't read.
    """
    s = s or Settings()
    scratch = Scratch(spark)
    key = vectors.schema[id_col].dataType.simpleString()
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # vectors move as they came
    base = vectors.select(F.col(id_col).cast("string").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [unit(v) for v in b["_v"]]
            raw = [None if u is None else np.asarray(v, kind).tobytes() for u, v in zip(own, b["_v"], strict=True)]
            yield pd.DataFrame({"_id": b["_id"], "_raw": raw, "_digest": [None if u is None else hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest() for u in own]})

    scaled = scratch.save(base.mapInPandas(scale, "_id string, _raw binary, _digest binary").withColumn("_id", F.col("_id").cast(key)))
    classes = scaled.where("_digest is not null").groupBy("_digest").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_size"), F.first("_raw").alias("_raw"))
    classes = scratch.save(classes.withColumn("_node", F.monotonically_increasing_id()).withColumn("_d", (F.octet_length("_raw") / int(kind[-1])).cast("int")))
    ids = scratch.save(scaled.select("_id", "_digest"))
    scratch.drop(scaled)
    _let_go(spark)
    trees: dict[int, list[Tree]] = {}
    for r in classes.groupBy("_d").count().orderBy("_d").collect():  # a row for each length
        size, depth = r["_d"], fitted_depth(r["count"], min(r["count"], s.sample), s)
        trees[size] = [Tree([s.seed, t], size, depth, s) for t in range(s.trees if depth else 1)]
        if depth:
            share = F.pmod(F.xxhash64("_digest"), F.lit(1 << 40)) < int(min(1.0, s.sample / r["count"]) * (1 << 40))  # each task sends its own few
            sample = classes.where((F.col("_d") == size) & share).select("_raw").collect()
            sample = units(b"".join(x["_raw"] for x in sample), size, kind)
            for tree in trees[size]:
                tree.fit(sample)
    if not trees:
        return ids.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))

    def parts(size: int, raw: pd.Series, upto: int) -> np.ndarray:
        x = units(b"".join(raw), size, kind)
        return np.stack([t.leaf(x) for t in trees[size][:upto]], axis=1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, own in b.groupby("_d", sort=False):
                p = parts(int(size), own["_raw"], s.trees)
                for t in range(p.shape[1]):
                    part, n = np.unique(p[:, t], return_counts=True)
                    yield pd.DataFrame({"_d": size, "_t": t, "_part": part, "_n": n})

    sizes = classes.select("_raw", "_d").mapInPandas(count, "_d int, _t int, _part long, _n long").groupBy("_d", "_t", "_part").agg(F.sum("_n").alias("_n"))
    blocks = {(r["_d"], r["_t"], r["_part"]): math.ceil(r["_n"] / s.block) for r in sizes.where(F.col("_n") > s.large).collect()}  # as many as parts at most
    found = [_round(spark, scratch, classes, t, blocks, parts, kind, s) for t in range(max(map(len, trees.values())))]
    results = found[0]
    for other in found[1:]:
        results = results.unionByName(other)
    roots = components(spark, scratch, results.where("a <> b").select("a", "b"))
    links = results.where("a = b").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_links"))
    named = classes.select("_node", "_digest", "_rep", "_size").join(links, "_node", "left").join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left")
    named = scratch.save(named.withColumn("root", F.coalesce("root", "_node")))
    scratch.drop(classes)
    least = scratch.save(named.groupBy("root").agg(F.min("_rep").alias("_least")))
    per = scratch.save(named.join(least, "root").select("_digest", (F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("_links"), "_least"))
    out = ids.join(per, "_digest", "left")
    component = F.when(F.col("_links").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _let_go(spark: SparkSession) -> None:
    """Spark removes a shuffle's files when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def _round(spark: SparkSession, scratch: Scratch, classes: DataFrame, t: int, blocks: dict, parts, kind: str, s: Settings) -> DataFrame:
    """What the parts of the tree of number t show: (a, a, links of a) and (a, b, 0) for links that connect."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, own in b.groupby("_d", sort=False):
                p = parts(int(size), own["_raw"], t + 1)
                if p.shape[1] <= t:
                    continue
                own = own.assign(_part=p[:, t], _earlier=[r.tobytes() for r in p[:, :t].astype(np.int32)])
                many = own["_part"].map(lambda part: blocks.get((int(size), t, int(part)), 1)).to_numpy()  # noqa: B023
                mine = own["_node"].to_numpy() % many
                other = [np.arange(m) for m in many]
                copies = np.repeat(np.arange(len(own)), many)
                mine, other = mine[copies], np.concatenate(other)
                yield own.iloc[copies].assign(_x=np.minimum(mine, other), _y=np.maximum(mine, other), _mine=mine)

    def compare(table: pa.Table) -> pa.Table:
        cols = {c: table[c].combine_chunks() for c in ("_raw", "_earlier")}
        size, x, y, part = (table[c][0].as_py() for c in ("_d", "_x", "_y", "_part"))

        def body(c: str, dtype: str, width: int) -> np.ndarray:
            a = cols[c].chunk(0) if isinstance(cols[c], pa.ChunkedArray) else cols[c]
            first = a.buffers()[1]
            at = np.frombuffer(first, np.int32 if pa.types.is_binary(a.type) else np.int64)[a.offset]
            return np.frombuffer(a.buffers()[2] or b"", dtype, len(a) * width, int(at)).reshape(len(a), width) if width else np.zeros((len(a), 0), dtype)

        node, weight, mine = (table[c].to_numpy() for c in ("_node", "_size", "_mine"))
        got = links_within(body("_raw", kind, size), weight, s, [s.seed, t + 1, part], body("_earlier", "<i4", t), mine if x < y else None)
        hit = np.flatnonzero(got.n)
        roots = np.array([got.find(k) for k in hit.tolist()], np.int64)
        tied = hit != roots
        a = np.concatenate([node[hit], node[hit[tied]]])
        b = np.concatenate([node[hit], node[roots[tied]]])
        n = np.concatenate([got.n[hit], np.zeros(int(tied.sum()), np.int64)])
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n})

    dealt = classes.select("_node", "_size", "_raw", "_d").mapInPandas(deal, "_node long, _size long, _raw binary, _d int, _part long, _earlier binary, _x int, _y int, _mine int")
    out = scratch.save(dealt.groupBy("_d", "_part", "_x", "_y").applyInArrow(compare, "a long, b long, n long"))
    _let_go(spark)
    return out
