"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of five-word runs are one class. Each class has a MinHash signature of 128 values
of 16 bits; four values together are a band, and classes that agree in a band meet in its bucket. Within a
bucket, pairs compare their signatures some values at a time; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold, given the matches so far, is below the tolerance. The
survivors are compared exactly, on their texts. A pair is looked at only in the first band that it shares, so
that no pair counts twice and nothing has to be made distinct.

Large buckets are dealt into tiles, each two blocks of the bucket, so that no group of near copies meets in
one task; a tile returns its texts' numbers of links and enough links to connect them, never its pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Scratch, keeps, lean, mix64, partitions, using, window_hashes, word_hashes
from furrow.llm.graph import components, forest


@dataclass(frozen=True)
class Settings:
    """n: words of a shingle. threshold: of similarity. tolerance: see above. step: signature values compared at a
    time. block: classes of a block of a large bucket. With 32 bands of 4 values, two texts of similarity
    0.8 share no band with a chance of 5e-8."""

    n: int = 5
    threshold: float = 0.8
    tolerance: float = 1e-7
    step: int = 16
    block: int = 1024
    values: int = 128
    rows: int = 4


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of a text with fewer words, one hash of them all; of none, none."""
    w = word_hashes(text)
    if not len(w):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(w, min(n, len(w))) ^ np.uint64(0 if len(w) >= n else len(w)))


_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, 4096, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32)


def signature(sh: np.ndarray, values: int) -> np.ndarray:
    """The low 16 bits of the least of each of `values` hashes over the set."""
    x = (mix64(sh) >> np.uint64(32)).astype(np.uint32)
    least = np.full(values, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _A[None, :values] + _B[None, :values]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


@functools.cache
def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(compared, matches) for each step: with fewer matches a pair is dropped.

    With a uniform prior, k matches of n leave Beta(k + 1, n - k + 1) as the posterior of the
    similarity, and its chance of being t or more is that of at most k successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(s.step, s.values + 1, s.step):
        chance, k = 0.0, -1
        while chance < s.tolerance:
            k += 1
            chance += math.exp(math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(s.threshold) + (n + 1 - k) * math.log1p(-s.threshold))
        out.append((n, k))
    return out


#: Pairs whose signatures are compared at once.
AT_ONCE = 60_000


def candidates(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, s: Settings) -> np.ndarray:
    """Which of the pairs (i, j) share `band` as their first band and survive the pruning."""
    keys = np.ascontiguousarray(sig).view(np.uint64)
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), AT_ONCE):
        x, y, z = (v[at : at + AT_ONCE] for v in (i, j, band))
        k = np.flatnonzero((keys[x] == keys[y]).argmax(axis=1) == z)
        same, done = np.zeros(len(k), np.int32), 0
        for n, least in least_matches(s):
            same += (sig[x[k], done:n] == sig[y[k], done:n]).sum(axis=1, dtype=np.int32)
            stay = same >= least
            k, same, done = k[stay], same[stay], n
        out[at + k] = True
    return out


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of the threshold or more, exactly."""
    size = np.array([len(x) for x in sets])
    if len(i) <= 3 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        names, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times > 1  # what one text only has is in no intersection
        own = shared[where]
        owner, where, names = owner[own], (np.cumsum(shared) - 1)[where[own]], names[shared]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, len(names), 4096):  # columns of the incidence matrix
            own = (where >= a) & (where < a + 4096)
            m = np.zeros((len(sets), min(4096, len(names) - a)), np.float32)
            m[owner[own], where[own] - a] = 1
            total += m @ m.T
        common = total[i, j].astype(np.int64)
    # Exact in integers: common / union >= threshold, the threshold taken to six decimals.
    t = round(threshold * 1_000_000)
    return common * 1_000_000 >= t * (size[i] + size[j] - common)


class _Triangles(dict):
    """The pairs i < j below a small n, which most tiles ask for again and again; those of larger n are made anew."""

    def __missing__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        made = np.triu_indices(n, 1)
        if n <= 64:
            self[n] = made
        return made

    def reset(self) -> None:
        self.clear()


_below = keeps("words", _Triangles())


def join(spark: SparkSession, docs: DataFrame, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_links (other documents linked directly), component_id (the smallest id reachable), kept (id = component_id).

    Two documents are linked if the Jaccard similarity of their sets of n-word runs is the threshold or more;
    texts of fewer words have one run. Null, empty and wordless texts link with nothing. Rows that repeat id and
    text count as documents of their own and get the same result. A row of null id takes part; its own
    component is null only if no other id is reachable. An empty table gives none.
    """
    s = s or Settings()
    bands = s.values // s.rows
    scratch = Scratch(spark)
    key = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["_text"]:
                x = shingles(t, s.n)
                rows.append((hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), signature(x, s.values).tobytes() if len(x) else b""))
            made = pd.DataFrame(rows, columns=["_digest", "_n", "_sig"], index=b.index)
            yield pd.concat([b[["_id"]], made], axis=1)

    signed = scratch.save(base.mapInPandas(lean(sign), "_id string, _digest binary, _n int, _sig binary").withColumn("_id", F.col("_id").cast(key)))
    classes = signed.where("_n > 0").groupBy("_digest").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_size"), F.first("_sig").alias("_sig"))
    classes = scratch.save(classes.withColumn("_node", F.monotonically_increasing_id()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.frombuffer(b"".join(b["_sig"]), np.uint64).reshape(len(b), bands)
            salted = mix64(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pd.DataFrame({"_bucket": salted.view(np.int64).ravel(), "_band": np.tile(np.arange(bands, dtype=np.int32), len(b)), "_node": np.repeat(b["_node"].to_numpy(), bands)})

    dealt = scratch.save(classes.select("_node", "_sig").mapInPandas(lean(deal), "_bucket long, _band int, _node long"))
    shared = scratch.save(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"))
    members = dealt.join(shared, "_bucket").withColumn("_blocks", F.ceil(F.col("_m") / s.block).cast("int"))
    members = members.withColumn("_mine", F.pmod(F.xxhash64("_node"), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tiles = members.select("_bucket", "_band", "_node", "_mine", F.least("_mine", "_other").alias("_x"), F.greatest("_mine", "_other").alias("_y"))
    tiles = scratch.save(tiles)
    parts = max(4 * partitions(spark), tiles.count() // 4000)  # many small tiles to a part, few large ones
    part = F.pmod(F.xxhash64("_bucket", "_x", "_y"), F.lit(parts)).cast("int")
    tiles = tiles.join(classes.select("_node", "_sig", "_size"), "_node")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        """All tiles of a part: their surviving pairs."""
        using("words")
        pdf = pdf.sort_values(["_bucket", "_x", "_y"], ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["_sig"]), np.uint16).reshape(len(pdf), s.values)
        tile = pdf[["_bucket", "_x", "_y"]].to_numpy()
        mine, x, y, band = (pdf[c].to_numpy() for c in ("_mine", "_x", "_y", "_band"))
        edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1), True])
        rows: list[pd.DataFrame] = []
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = 0

        def settle() -> None:
            i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            yes = candidates(sig, i, j, band[i], s)
            at = 0
            for a, _, _ in held:
                own = slice(at, at + len(a))
                at += len(a)
                if not yes[own].any():
                    continue
                k, ij = np.unique(np.concatenate([i[own][yes[own]], j[own][yes[own]]]), return_inverse=True)
                pairs = [ij.astype("<i4").tobytes()] + [None] * (len(k) - 1)
                rows.append(pdf.loc[k, ["_bucket", "_x", "_y", "_node", "_size"]].assign(_k=np.arange(len(k)), _pairs=pairs))
            held.clear()

        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if x[a] == y[a]:
                i, j = _below[z - a]
                held.append((a + i, a + j, a))
            else:
                left, right = a + np.flatnonzero(mine[a:z] == x[a]), a + np.flatnonzero(mine[a:z] == y[a])
                held.append((np.repeat(left, len(right)), np.tile(right, len(left)), a))
            n += len(held[-1][0])
            if n > 1_000_000:
                settle()
                n = 0
        if held:
            settle()
        return pd.concat(rows) if rows else pd.DataFrame({"_bucket": [], "_x": [], "_y": [], "_node": [], "_size": [], "_k": [], "_pairs": []})

    found = scratch.save(tiles.groupBy(part.alias("_part")).applyInPandas(lean(prune), "_bucket long, _x int, _y int, _k int, _node long, _size long, _pairs binary"))

    texts = _texts(spark, scratch, base, classes, found, s, key)
    placed = found.join(texts, "_node")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        """All tiles of a part: each text's number of links, and enough links to connect them."""
        known: dict[int, np.ndarray] = {}
        out = []
        for _, tile in pdf.groupby(["_bucket", "_x", "_y"], sort=False):
            tile = tile.drop_duplicates("_k").sort_values("_k")
            size, node = tile["_size"].to_numpy(), tile["_node"].to_numpy()
            for q, t in zip(node.tolist(), tile["_text"], strict=True):
                if q not in known:
                    known[q] = shingles(t, s.n)
            sets = [known[q] for q in node.tolist()]
            i, j = np.frombuffer(tile["_pairs"].iloc[0], "<i4").reshape(2, -1)
            yes = verified(sets, i, j, s.threshold)
            i, j = i[yes], j[yes]
            if not len(i):
                continue
            links = np.zeros(len(tile), np.int64)
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            tree = np.array(forest(len(tile), zip(i.tolist(), j.tolist(), strict=True)))
            own = links > 0
            out += [np.stack([node[own], node[own], links[own]]), np.stack([node[tree[:, 0]], node[tree[:, 1]], np.zeros(len(tree), np.int64)])]
        a, b, n = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"a": a, "b": b, "n": n})

    results = scratch.save(placed.groupBy(part.alias("_part")).applyInPandas(lean(verify), "a long, b long, n long"))
    roots = components(spark, scratch, results.where("a <> b").select("a", "b"))
    links = results.where("a = b").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_links"))
    named = classes.select("_node", "_digest", "_rep", "_size").join(links, "_node", "left").join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left")
    named = scratch.save(named.withColumn("root", F.coalesce("root", "_node")))
    least = scratch.save(named.groupBy("root").agg(F.min("_rep").alias("_least")))
    per = scratch.save(named.join(least, "root").select("_digest", (F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("_links"), "_least"))
    out = signed.select("_id", "_digest").join(per, "_digest", "left")
    component = F.when(F.col("_links").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


#: Bits of the map of documents whose text a survivor needs: a fixed size, whatever the input. Once it is full it only filters less.
MAP_BITS = 1 << 24


def _texts(spark: SparkSession, scratch: Scratch, base: DataFrame, classes: DataFrame, found: DataFrame, s: Settings, key: str) -> DataFrame:
    """(_node, _text) for one document of each class that a candidate pair holds."""
    wanted = scratch.save(found.select("_node").distinct().join(classes.select("_node", "_rep", "_digest"), "_node"))
    place = F.pmod(F.xxhash64("_rep"), F.lit(MAP_BITS)) + 1  # Spark's bitmaps count from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most MAP_BITS / 32768
    bits = np.zeros(MAP_BITS, bool)
    for r in rows:
        start = (r["k"] - 1) * 32768
        bits[start : start + 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:32768]
    packed = np.packbits(bits)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["_place"].to_numpy()
            own = b[(packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)]
            digest = [hashlib.blake2b(shingles(t, s.n).tobytes(), digest_size=16).digest() for t in own["_text"]]
            yield pd.DataFrame({"_rep": own["_id"], "_digest": digest, "_text": own["_text"]})

    some = base.withColumn("_place", F.pmod(F.xxhash64(F.col("_id").cast(key)), F.lit(MAP_BITS))).mapInPandas(lean(pick), "_rep string, _digest binary, _text string").withColumn("_rep", F.col("_rep").cast(key))
    return scratch.save(some.join(wanted, ["_digest"]).where(some["_rep"].eqNullSafe(wanted["_rep"])).select("_node", "_text"))
