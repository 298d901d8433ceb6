"""Which of all keys of a corpus occur at two places or more, without a row for each key.

Documents are saved in chunks of some megabytes. A chunk sorts its 64-bit keys (hashes of windows, blocks or
phrases), cuts the sorted list by leading bits into buckets, and sends each bucket one compressed list: a few
bytes a key. A bucket compares the lists of all chunks and answers each with bits in the order of its list; the
chunk, which makes the same list again from the same documents, reads them. Hashes spread evenly over the buckets;
a key enters a list once however often it occurs, so very frequent keys weigh no more than one entry a chunk.

A corpus of very many chunks needs more buckets than a chunk can fill. Then chunks send to TOP buckets at most, and there the lists of GROUP chunks become one, which
is cut again into the many buckets and compared with those of the other groups; answers come back the same way. A frequent key then
weighs one entry a group.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import lean, pack, squeeze, unpack, unsqueeze

#: UTF-8 bytes of a chunk, unless one document is longer; keys of a bucket, about.
CHUNK, BUCKET = 4 << 20, 2_000_000
#: Leading bits by which a chunk cuts its list at most; chunks whose lists are merged where there are more buckets than that.
TOP, GROUP = 12, 1024


def chunk_body(ids: list, texts: list[str]) -> bytes:
    batch = pa.record_batch([pa.array(ids, pa.large_string()), pa.array(texts, pa.large_string())], names=["id", "text"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def chunk_rows(body: bytes) -> tuple[list, list[str]]:
    batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """(_chunk, _size, _body): all rows, in chunks of about `size` characters of text, and how many UTF-8 bytes a chunk has. Save it: the numbers hold only once saved."""

    def chunk(number: int, ids: list, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"_chunk": [number], "_size": [sum(len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts)], "_body": [chunk_body(ids, texts)]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i, t in zip(b["_id"], b["_text"], strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= size:
                    yield chunk((part << 32) + n, ids, texts)
                    n, ids, texts, held = n + 1, [], [], 0
        if ids:
            yield chunk((part << 32) + n, ids, texts)

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(lean(gather), "_chunk long, _size long, _body binary")


def bucket_bits(keys: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, keys / BUCKET))))


def trimmed(hashes: np.ndarray, keys: float) -> np.ndarray:
    """Hashes cut to their leading bits, for a search that an exact comparison follows: as many as make a chance
    agreement of one key with any of `keys` others rarer than 1 in 16,000."""
    bits = min(64, math.ceil(math.log2(max(2.0, keys))) + 14)
    return hashes & np.uint64(~((1 << (64 - bits)) - 1) & 0xFFFFFFFFFFFFFFFF)


def exact_bits(keys: float) -> int:
    """Bits of hash with which two different of `keys` strings agree with a chance of about 1 in 8,000."""
    return math.ceil(2 * math.log2(max(2.0, keys))) + 12


def exact_keys(one: np.ndarray, two, keys: float) -> Keys:
    """The keys of an exact comparison: as much of a first hash as the number of strings needs, and where its 64 bits don't do,
    16 bits of a second one, which two() makes."""
    bits = exact_bits(keys)
    if bits > 64:
        return Keys(one, (two() >> np.uint64(48)).astype(np.uint16))
    return Keys(one & np.uint64(~((1 << (64 - bits)) - 1) & 0xFFFFFFFFFFFFFFFF))


class Keys:
    """A chunk's keys in sorted order, each once."""

    def __init__(self, keys: np.ndarray, check: np.ndarray | None = None):
        if check is None:
            self.keys, self.inverse, self.times = np.unique(keys, return_inverse=True, return_counts=True)
            self.check = None
        else:  # 16 more bits each
            order = np.argsort(keys)
            k, c = keys[order], check[order]
            if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # rare
                order = np.lexsort((check, keys))
                k, c = keys[order], check[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
            self.keys, self.check = k[new], c[new]
            self.inverse = np.empty(len(k), np.int64)
            self.inverse[order] = np.cumsum(new) - 1
            self.times = np.bincount(self.inverse, minlength=len(self.keys))

    def bounds(self, bits: int, first: int = 0, count: int | None = None) -> np.ndarray:
        wanted = first + np.arange((1 << bits if count is None else count) + 1)
        return np.searchsorted((self.keys >> np.uint64(64 - bits)).astype(np.int64), wanted) if bits else np.array([0, len(self.keys)])

    def lists(self, bits: int, indexed: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """(bucket, list) with, for each key, whether it occurs more than once here and whether it is in the index."""
        return self.lists_of(bits, 0, 1 << bits, indexed)

    def lists_of(self, bits: int, first: int, count: int, indexed: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """The lists of some buckets in a row, which hold all keys."""
        at = self.bounds(bits, first, count)
        for b in range(count):
            i, j = at[b], at[b + 1]
            if i < j:
                yield first + b, squeeze(pack(self.keys[i:j]), np.packbits(self.times[i:j] > 1).tobytes(), b"" if indexed is None else np.packbits(indexed[i:j]).tobytes(), b"" if self.check is None else self.check[i:j].astype("<u2").tobytes())

    def answers(self, bits: int, replies: list[tuple[int, bytes]], kinds: int = 1) -> list[np.ndarray]:
        """For each kind of answer, whether it holds for each key of the list."""
        return self.answers_of(bits, 0, 1 << bits, replies, kinds)

    def answers_of(self, bits: int, first: int, count: int, replies: list[tuple[int, bytes]], kinds: int) -> list[np.ndarray]:
        at = self.bounds(bits, first, count)
        out = [np.zeros(len(self.keys), bool) for _ in range(kinds)]
        for b, body in replies:
            i, j = at[b - first], at[b - first + 1]
            for own, part in zip(out, unsqueeze(body), strict=True):
                own[i:j] = np.unpackbits(np.frombuffer(part, np.uint8), count=j - i).astype(bool)
        return out


def compare(lists: list[bytes]) -> list[bytes]:
    """The answers to a bucket's lists: which keys occur at two places or more and are in the index of a chunk
    (where there is one), and in which list the key comes first."""
    parts = [unsqueeze(x) for x in lists]
    keys = [unpack(p[0]) for p in parts]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    many = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)]).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(every, kind="stable")
    new = np.r_[True, np.diff(every[order]) != 0]
    if parts[0][3]:
        check = np.concatenate([np.frombuffer(p[3], "<u2") for p in parts])
        if (~new[1:] & (np.diff(check[order].astype(np.int64)) != 0)).any():  # rare
            order = np.lexsort((owner, check, every))
            new = np.r_[True, (np.diff(every[order]) != 0) | (np.diff(check[order].astype(np.int64)) != 0)]
    group = np.cumsum(new) - 1
    places = np.bincount(group, weights=1 + many[order]).astype(np.int64)
    yes = places > 1
    if parts[0][2]:
        indexed = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
        yes &= np.bincount(group, weights=indexed[order]) > 0
    repeated, first = np.empty(len(every), bool), np.empty(len(every), bool)
    repeated[order], first[order] = yes[group], new
    ends = np.cumsum([0, *sizes])
    return [squeeze(np.packbits(repeated[a:b]).tobytes(), np.packbits(first[a:b]).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def merged(lists: list[bytes]) -> tuple[Keys, np.ndarray | None, list[np.ndarray], np.ndarray]:
    """The lists of several chunks as one: its keys, which of them are in the index (if lists say so), where each list's keys are in it, and which of these come first."""
    parts = [unsqueeze(x) for x in lists]
    keys = [unpack(p[0]) for p in parts]
    check = np.concatenate([np.frombuffer(p[3], "<u2") for p in parts]) if parts[0][3] else None
    own = Keys(np.concatenate(keys), check)
    many = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(k)) for p, k in zip(parts, keys, strict=True)]).astype(np.int64)
    own.times = np.bincount(own.inverse, weights=1 + many, minlength=len(own.keys)).astype(np.int64)
    indexed = None
    if parts[0][2]:
        flag = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(k)) for p, k in zip(parts, keys, strict=True)])
        indexed = np.bincount(own.inverse, weights=flag, minlength=len(own.keys)) > 0
    lead = np.zeros(len(own.inverse), bool)
    lead[np.unique(own.inverse, return_index=True)[1]] = True
    ends = np.cumsum([0, *map(len, keys)])
    return own, indexed, [own.inverse[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], lead


def list_bits(bits: int) -> int:
    """Leading bits by which chunks cut their lists, where `bits` are needed in all."""
    return min(bits, TOP)


def answer(lists: DataFrame, bits: int = 0, n_chunks: int = 1, top: int | None = None, group: int | None = None) -> DataFrame:
    """(_chunk, _bucket, _reply) from (_chunk, _bucket, _list) of n_chunks chunks, which list_bits(bits) bits cut. In two levels the lists are made twice rather than saved."""
    top, group = top or TOP, group or GROUP

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        return pd.DataFrame({"_chunk": pdf["_chunk"], "_bucket": pdf["_bucket"], "_reply": compare(pdf["_list"].to_list())})

    reply = "_chunk long, _bucket int, _reply binary"
    if bits <= top:
        return lists.groupBy("_bucket").applyInPandas(lean(run), reply)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        own, indexed, _, _ = merged(pdf.sort_values("_chunk")["_list"].to_list())
        rows = list(own.lists_of(bits, int(pdf["_bucket"].iloc[0]) << (bits - top), 1 << (bits - top), indexed))
        return pd.DataFrame({"_group": pdf["_group"].iloc[0], "_coarse": pdf["_bucket"].iloc[0], "_fine": [r[0] for r in rows], "_list": [r[1] for r in rows]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_group")
        return pd.DataFrame({"_group": pdf["_group"], "_coarse": pdf["_coarse"], "_fine": pdf["_fine"], "_reply": compare(pdf["_list"].to_list())})

    def split(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"_chunk": [], "_bucket": [], "_reply": []})
        left = left.sort_values("_chunk")
        own, _, where, lead = merged(left["_list"].to_list())
        base = int(left["_bucket"].iloc[0]) << (bits - top)
        got = own.answers_of(bits, base, 1 << (bits - top), list(zip(right["_fine"], right["_reply"], strict=True)), 2)
        out, at = [], 0
        for w in where:
            out.append(squeeze(np.packbits(got[0][w]).tobytes(), np.packbits(got[1][w] & lead[at : at + len(w)]).tobytes()))
            at += len(w)
        return pd.DataFrame({"_chunk": left["_chunk"], "_bucket": left["_bucket"], "_reply": out})

    # Chunks are numbered by partition and then within it, so a hash of the number deals them evenly over the groups.
    groups = n_chunks // group + 1
    dealt = lists.withColumn("_group", F.pmod(F.xxhash64("_chunk"), F.lit(groups)).cast("int"))
    small = dealt.groupBy("_bucket", "_group").applyInPandas(lean(cut), "_group int, _coarse int, _fine int, _list binary")
    back = small.groupBy("_fine").applyInPandas(lean(meet), "_group int, _coarse int, _fine int, _reply binary")
    return dealt.groupBy("_bucket", "_group").cogroup(back.groupBy("_coarse", "_group")).applyInPandas(lean(split), reply)


def replies_of(pdf: pd.DataFrame) -> list[tuple[int, bytes]]:
    return list(zip(pdf["_bucket"], pdf["_reply"], strict=True))
