"""Substring deduplication of words by fixed-block anchors.

Every text is cut into blocks of `block` words that don't overlap: the index. Every window of `block` words, at
every place, probes it. With 2 * block <= window + 1, a window of `window` words holds a whole block, so if it
occurs twice, a block of the one is hit by a probe from the other. Hits are then extended to maximal exact repeats:
all windows around a hit are compared with those around all other hits, and runs of windows that occur
elsewhere are what is repeated. Blocks, probes and windows are compared by `exchange`, some bytes each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import WORD, Scratch, lean, window_hashes, word_hashes
from furrow.llm.exchange import CHUNK, Keys, answer, bucket_bits, chunk_body, chunk_rows, chunks, exact_keys, list_bits, replies_of, trimmed

_word = re.compile(WORD)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[np.minimum(starts + width, n)] -= 1
    return np.cumsum(edge)[:n] > 0


def without(text: str, gone: np.ndarray) -> str:
    """A text without the runs of words that are gone."""
    at = np.array([m.span() for m in _word.finditer(text)], np.int64).reshape(-1, 2)
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    first, last = at[np.flatnonzero(edge == 1), 0].tolist(), at[np.flatnonzero(edge == -1) - 1, 1].tolist()
    return "".join(text[a:z] for a, z in zip([0, *last], [*first, len(text)], strict=True))


def near_hits(hit: np.ndarray, block: int, window: int, n: int) -> np.ndarray:
    """Starts of the windows that hold a hit block: hit[p] says that the block-sized window at p was hit."""
    if n < window:
        return np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(hit)]
    s = np.arange(n - window + 1)
    return s[total[s + window - block + 1] > total[s]]


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, texts: bool = False, read: Callable[[], None] | None = None, chunked: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (and kept_text, if asked for): words covered by a `window`-word sequence that also starts elsewhere, in
    the same document or another, are removed; the kept ones, joined by one space, are hashed.

    Null, empty and short texts lose nothing. Repeated rows are documents of their own and so remove each other's
    words, if there are enough. Null ids stay null, and an empty table gives no rows. kept_text leaves out each removed run of words
    with what stands between them; all else stays as it was. read: called once all texts have been read. chunked: docs are chunks already, as
    substrings.repeated_bytes gives them; their ids are strings.
    """
    block = (window + 1) // 2
    scratch = Scratch(spark)
    key = "string" if chunked else docs.schema[id_col].dataType.simpleString()
    store = scratch.save(docs if chunked else chunks(docs, id_col, text_col, chunk))
    n_chunks, size = store.agg(F.count("*"), F.sum("_size") if chunked else F.count("*") * chunk).first()
    size = size or 0
    if read:
        read()
    all_bits = bucket_bits(size / 6)
    bits = list_bits(all_bits)

    def probes(said: list[str]) -> tuple[list[np.ndarray], Keys, np.ndarray]:
        words = [word_hashes(t) for t in said]
        rolling = [trimmed(window_hashes(w, block), size / 6) for w in words]
        keys = Keys(np.concatenate([*rolling, np.zeros(0, np.uint64)]))
        grid = np.concatenate([*(np.arange(len(r)) % block == 0 for r in rolling), np.zeros(0, bool)])
        indexed = np.zeros(len(keys.keys), bool)
        indexed[keys.inverse[grid]] = True
        return words, keys, indexed

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, body in zip(b["_chunk"], b["_body"], strict=True):
                _, keys, indexed = probes(chunk_rows(body)[1])
                rows = list(keys.lists(bits, indexed))
                yield pd.DataFrame({"_chunk": c, "_bucket": [r[0] for r in rows], "_list": [r[1] for r in rows]})

    hits = answer(store.mapInPandas(lean(ask), "_chunk long, _bucket int, _list binary"), all_bits, n_chunks)
    columns = ["_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    result = "_id string, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def done(i, text: str, gone: np.ndarray | None) -> tuple:
        words = _word.findall(text)
        kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
        rest = (text if gone is None else without(text, gone)) if texts else None
        return i, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest(), rest

    def window_keys(words: list[np.ndarray], starts: list[np.ndarray]) -> Keys:
        def hashes(which: int) -> np.ndarray:
            return np.concatenate([*(window_hashes(w, window, which)[s] for w, s in zip(words, starts, strict=True)), np.zeros(0, np.uint64)])

        return exact_keys(hashes(0), lambda: hashes(1), size / 6)

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Texts without a hit are done; the others go on, with their windows near hits."""
        if not len(left):
            return pd.DataFrame(columns=["_chunk", "_bucket", "_list", "_body", *columns])
        ids, said = chunk_rows(left["_body"].iloc[0])
        words, keys, _ = probes(said)
        hit = keys.answers(bits, replies_of(right), 2)[0][keys.inverse]
        rows, on, at = [], [], 0
        for k, w in enumerate(words):
            m = max(0, len(w) - block + 1)
            s = near_hits(hit[at : at + m], block, window, len(w))
            at += m
            if len(s):
                on.append((k, s))
            else:
                rows.append(done(ids[k], said[k], None))
        out = [pd.DataFrame(rows, columns=columns)]
        c = left["_chunk"].iloc[0]
        if on:
            lists = list(window_keys([words[k] for k, _ in on], [s for _, s in on]).lists(bits))
            out.append(pd.DataFrame({"_chunk": c, "_bucket": [x[0] for x in lists], "_list": [x[1] for x in lists]}))
            starts = b"".join(np.array([len(s), *s], "<u4").tobytes() for _, s in on)
            out.append(pd.DataFrame({"_chunk": [c], "_bucket": [-1], "_list": [starts], "_body": [chunk_body([ids[k] for k, _ in on], [said[k] for k, _ in on])]}))
        every = pd.concat(out, ignore_index=True)
        return every.reindex(columns=["_chunk", "_bucket", "_list", "_body", *columns])

    mixed = store.groupBy("_chunk").cogroup(hits.groupBy("_chunk")).applyInPandas(_typed(lean(extend)), "_chunk long, _bucket int, _list binary, _body binary, " + result)
    mixed = scratch.save(mixed)
    scratch.drop(store)  # whatever is still needed of it is in `mixed`
    found = answer(mixed.where("_bucket >= 0").select("_chunk", "_bucket", "_list"), all_bits, n_chunks)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            ids, said = chunk_rows(left["_body"].iloc[0])
            raw, starts, at = np.frombuffer(left["_list"].iloc[0], "<u4").astype(np.int64), [], 0
            for _ in ids:
                starts.append(raw[at + 1 : at + 1 + raw[at]])
                at += 1 + raw[at]
            words = [word_hashes(t) for t in said]
            keys = window_keys(words, starts)
            twice = keys.answers(bits, replies_of(right), 2)[0][keys.inverse]
            at = 0
            for i, t, s, hashes in zip(ids, said, starts, words, strict=True):
                own = s[twice[at : at + len(s)]]
                at += len(s)
                rows.append(done(i, t, covered(own, window, len(hashes)) if len(own) else None))
        return pd.DataFrame(rows, columns=columns)

    rest = mixed.where("_bucket = -1").select("_chunk", "_body", "_list")
    last = rest.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInPandas(lean(finish), result)
    out = mixed.where("_bucket is null").select(*columns).unionByName(last).withColumn("_id", F.col("_id").cast(key)).withColumnRenamed("_id", id_col)
    return out if texts else out.drop("kept_text")


def _typed(f):
    """Whole numbers as such where a column also has nulls."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = f(left, right)
        for c in ("_kind", "_chunk", "_bucket", "n_words", "n_removed", "n_bytes", "n_spans", "_size"):
            if c in out:
                out[c] = out[c].astype("Int64")
        return out

    return run
