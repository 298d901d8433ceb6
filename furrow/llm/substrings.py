"""Suffix-array deduplication of repeated byte strings.

Texts are parsed into phrases, some tens of bytes each, that end where a hash of eight bytes is the least of some
window around: a long string is parsed alike wherever it occurs, but for its ends. Phrases that occur once in the
corpus can't lie inside a repeat. For the rest, each phrase that is the least of three in a row is a meeting
point: what stands around it, in all documents, comes together. A suffix array over the phrases, built by linear grouping
(`suffixes`), and its common prefixes tell how far each run of phrases agrees with another place. Where it does from the start
of a phrase to beyond `width` bytes, a stretch, all bytes of the stretch are repeated: this is the inside of every repeat.

What is left are the ends, where a repeated string starts or stops within a phrase. Every string of `width` bytes that occurs twice
holds RUN phrases that do, so it starts and ends near a common run of the suffix array that is long enough. Such strings, if no
stretch settles them, are compared by their hashes; of each repeated stretch one place sends its strings to be compared with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Scratch, _powers, lean, mix64, squeeze, unsqueeze, using
from furrow.llm.exchange import CHUNK, Keys, answer, bucket_bits, chunk_body, chunk_rows, chunks, exact_keys, list_bits, replies_of, trimmed
from furrow.llm.passages import _typed, covered
from furrow.llm.suffixes import common_prefixes, suffix_array

#: Bytes of a gram; grams of the window whose least ends a phrase; phrases in a row that a repeat holds at least;
#: phrases before a meeting point that a run may start. A repeat of `width` bytes parses alike but for WINDOW - 1 grams at each
#: end, so it holds RUN whole phrases of at most WINDOW grams if width - GRAM + 1 - 2 * (WINDOW - 1) >= (RUN + 1) * WINDOW.
GRAM, WINDOW, RUN = 8, 64, 3
AROUND = RUN - 1


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """The least (or largest) of each `width` values in a row, a power of two: by doubling."""
    k = 1
    while k < width and len(x) > k:
        x = op(x[:-k], x[k:])
        k *= 2
    return x if k == width else x[:0]


@dataclass
class Parsed:
    """A text's grams (mixed), where its phrases start, and hashes of phrases."""

    grams: np.ndarray
    at: np.ndarray
    phrases: np.ndarray
    total: np.ndarray  # of the hash polynomial, up to each gram
    ends: np.ndarray  # the stretch from phrase i ends before phrase ends[i], past `width` bytes from the start of phrase i + 1; as many as there are
    n: int

    def strings(self, starts: np.ndarray, width: int, half: bool = False) -> np.ndarray:
        """Hashes of the strings of `width` bytes from the starts, or of their first halves. Strings that differ in both halves agree in the one hash and the other
        by two chances apart; of those that differ in one half only there are far fewer pairs."""
        k = (width - GRAM + 1) // (2 if half else 1)
        down = _powers[0].upto(len(self.grams) + 1)[1]
        return mix64((self.total[starts + k] - self.total[starts]) * down[starts])


def parse(b: bytes, width: int) -> Parsed:
    none = np.zeros(0, np.uint64)
    if len(b) < width:
        return Parsed(none, np.zeros(0, np.int64), none, none, np.zeros(0, np.int64), len(b))
    g = mix64(np.ndarray((len(b) - GRAM + 1,), "<u8", b, strides=(1,)))
    top = (g >> np.uint64(32)).astype(np.uint32)
    least = np.zeros(len(g) + WINDOW - 1, np.uint32)
    least[WINDOW - 1 : len(g)] = sliding(np.minimum, top, WINDOW)
    chosen = sliding(np.maximum, least, WINDOW) == top
    chosen[0] = chosen[-1] = True
    at = np.flatnonzero(chosen)
    down = _powers[0].upto(len(g) + 1)[1]
    up = _powers[0].upto(len(g) + 1)[0]
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(g * up[: len(g)], out=total[1:])

    def between(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix64((total[z + 1] - total[a]) * down[a] + (z - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    end = np.searchsorted(at, at[1:] + width - GRAM)
    return Parsed(g, at, between(at[:-1], at[1:]), total, end[end < len(at)], len(b))


def runs(twice: np.ndarray, length: int = RUN) -> np.ndarray:
    """Starts of `length` in a row."""
    if len(twice) < length:
        return np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(twice)]
    return np.flatnonzero(total[length:] - total[:-length] == length)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of `size` places each, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of `size` places each, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Meetings:
    """A chunk's meeting points with the phrases around them, each neighbourhood once, by the hash of the point.

    A run of phrases that all occur twice meets at the least of its first three (the first of equals), so at one point only, wherever it occurs. It goes on to the
    next phrase that occurs once, or to the end of its stretch. A neighbourhood holds the runs that meet at a point, which start 2, 1 or 0 phrases before it."""

    def __init__(self, docs: list[tuple[Parsed, np.ndarray]]):
        """docs: a parsed text and whether each of its phrases occurs twice in the corpus."""
        gap = np.zeros(AROUND, np.uint64)
        no = np.zeros(AROUND, bool)
        sym = np.concatenate([gap, *(x for p, _ in docs for x in (p.phrases, gap))])
        ok = np.concatenate([no, *(x for _, t in docs for x in (t, no))])
        n = len(sym)
        self.starts = np.cumsum([AROUND, *(len(p.phrases) + AROUND for p, _ in docs)])[:-1]
        end = np.full(n, n, np.int64)
        for at, (p, _) in zip(self.starts.tolist(), docs, strict=True):
            end[at : at + len(p.ends)] = at + p.ends
        stop = np.minimum.accumulate(np.where(ok, n, np.arange(n))[::-1])[::-1]  # the next phrase that occurs once, or a text's end
        self.whole = end <= stop  # all of the stretch may occur twice
        stop = np.minimum(stop, end)
        first = runs(ok)
        least = first + np.argmin(np.stack([sym[first + k] for k in range(RUN)]), axis=0) if len(first) else first
        meets = np.full(n, -1, np.int64)
        meets[first] = least
        m = self.place = np.unique(least)
        start = m[:, None] - AROUND + np.arange(RUN)
        self.sizes = np.where(meets[start] == m[:, None], stop[start] - start, 0)  # phrases of each run
        begin, last = np.where(self.sizes > 0, start, n).min(axis=1, initial=n), (start + self.sizes).max(axis=1, initial=0)
        length = last - begin
        key = ragged_hashes(sym[spread(begin, length)], length, np.c_[sym[m], m - begin, self.sizes])
        _, self.first, self.inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(sym[m[self.first]], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.first, self.times, self.inverse = self.first[order], times[order], back[self.inverse]
        self.sym, self.points, self.before, self.begin, self.length = sym, sym[m[self.first]], (m - begin)[self.first], begin[self.first], length[self.first]

    def bounds(self, bits: int) -> np.ndarray:
        return np.searchsorted((self.points >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)) if bits else np.array([0, len(self.points)])

    def lists(self, bits: int) -> Iterator[tuple[int, bytes]]:
        at = self.bounds(bits)
        for b in range(1 << bits):
            i, j = at[b], at[b + 1]
            if i < j:
                near = (self.sym[spread(self.begin[i:j], self.length[i:j])] >> np.uint64(32)).astype("<u4")
                head = np.c_[self.before[i:j], self.length[i:j], self.sizes[self.first[i:j]]].astype("<u2")
                yield b, squeeze(self.points[i:j].tobytes(), zstandard.compress(np.ascontiguousarray(head.T).tobytes(), 1), near.tobytes(), np.packbits(self.times[i:j] > 1).tobytes())

    def common(self, bits: int, replies: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase of the documents with gaps between them: how many phrases from it on another place has too (0 if fewer than RUN), and whether this is the one
        place of all with these phrases that sends the strings of its stretch."""
        at = self.bounds(bits)
        got = np.zeros((len(self.points), RUN + 1), np.int64)
        for b, body in replies:
            got[at[b] : at[b + 1]] = np.frombuffer(body, "<u2").reshape(-1, RUN + 1)
        lead = np.zeros(len(self.place), bool)
        lead[self.first] = True
        far, sends = np.zeros(len(self.sym), np.int64), np.zeros(len(self.sym), bool)
        for k in range(RUN):
            own = np.flatnonzero(self.sizes[:, k])
            far[self.place[own] + k - AROUND] = got[self.inverse[own], k]
            sends[self.place[own] + k - AROUND] = lead[own] & (got[self.inverse[own], RUN] >> k & 1).astype(bool)
        return far, sends


def ragged_hashes(flat: np.ndarray, length: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of each row of a ragged table, rows one after the other, and of the numbers that go with it."""
    h = np.zeros(len(length), np.uint64)
    if len(length):
        up = _powers[1].upto(int(length.max()) + 1)[0]
        h = mix64(np.add.reduceat(mix64(flat) * up[spread(np.zeros(len(length), np.int64), length)], np.cumsum(length) - length))
    return row_hashes(np.c_[h, length.astype(np.uint64), more.astype(np.uint64)])


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(k + 1))
    return h


#: Symbols of one suffix array, about: meeting points are taken together up to it. A point with more is split by the phrases that its runs start with.
SYMBOLS = 200_000


class Runs:
    """All distinct neighbourhoods of a bucket: flat phrases, where each starts, its point, and the sizes of its runs; `far`, how many phrases of each run another
    place has too, and `leads`, the run that sends for all with these phrases."""

    def __init__(self, points: np.ndarray, head: np.ndarray, near: np.ndarray, places: np.ndarray, start: np.ndarray):
        self.points, self.near, self.start, self.length, self.sizes = points, near, start, head[:, 1], head[:, 2:]
        self.offset = head[:, 0, None] - AROUND + np.arange(RUN)  # of each run within its neighbourhood
        self.far = np.where(places[:, None] > 1, self.sizes, 0)  # the same neighbourhood at another place
        self.leads = self.sizes > 0

    def settle(self) -> None:
        """Points with several neighbourhoods, taken together into suffix arrays of bounded size."""
        order = np.argsort(self.points, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(self.points[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
        take: list[np.ndarray] = []
        held = 0
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if z - a == 1:
                continue
            rows = order[a:z]
            symbols = int(self.length[rows].sum()) + z - a
            if symbols > 2 * SYMBOLS:
                for k in range(RUN):
                    self._split(rows[self.sizes[rows, k] > 0], k, 0)
                continue
            take.append(rows)
            held += symbols
            if held >= SYMBOLS:
                self._order(np.concatenate(take), range(RUN))
                take, held = [], 0
        if take:
            self._order(np.concatenate(take), range(RUN))

    def _split(self, rows: np.ndarray, k: int, depth: int) -> None:
        """The runs k of many neighbourhoods that agree in `depth` phrases. Those that go on alike are one group, with a suffix array of its own once it is small enough;
        one that goes on like no other shares just these phrases."""
        if len(rows) < 2:
            return
        at = self.start[rows] + self.offset[rows, k]
        size = self.sizes[rows, k]
        if depth >= RUN:
            self.far[rows, k] = np.maximum(self.far[rows, k], np.minimum(depth, size))
        if int(size.sum()) + len(rows) <= 2 * SYMBOLS:
            return self._order(rows, (k,))
        ended = size <= depth
        if ended.any():  # equal to the end: one sends for all
            self.leads[np.sort(rows[ended])[1:], k] = False
        rows, at = rows[~ended], at[~ended]
        following = self.near[at + depth] if len(rows) else np.zeros(0, np.uint64)
        order = np.argsort(following, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(following[order]) != 0, True]) if len(rows) else np.zeros(1, np.int64)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self._split(rows[order[a:z]], k, depth + 1)

    def _order(self, rows: np.ndarray, kinds) -> None:
        """A suffix array over some neighbourhoods. Two runs agree in as many phrases as the least common prefix on the way from one to the other in the array."""
        n = self.length[rows]
        flat = mix64(self.near[spread(self.start[rows], n)] ^ mix64(np.repeat(self.points[rows], n)))  # a phrase is another one at another meeting point
        begin = np.cumsum(n + 1) - n - 1
        symbols = np.zeros(int((n + 1).sum()) + 1, np.int64)
        symbols[spread(begin, n)] = np.unique(flat, return_inverse=True)[1] + len(rows) + 1
        symbols[begin + n] = np.arange(len(rows)) + 1  # each neighbourhood ends with a symbol of its own
        s = symbols.tolist()
        order = suffix_array(s)
        common = np.array(common_prefixes(s, order))
        which = np.full(len(s), -1, np.int64)
        for k in kinds:
            own = np.flatnonzero(self.sizes[rows, k])
            which[begin[own] + self.offset[rows[own], k]] = own * RUN + k
        order = np.array(order)
        asked = np.flatnonzero(which[order] >= 0)  # in the array, the suffixes that are runs
        if len(asked) < 2:
            return
        x = which[order[asked]]
        row, k = rows[x // RUN], x % RUN
        size = self.sizes[row, k]
        shared = np.minimum.reduceat(common[: asked[-1] + 1], asked[:-1] + 1)  # between each and the next
        best = np.minimum(np.maximum(np.r_[0, shared], np.r_[shared, 0]), size)
        self.far[row, k] = np.maximum(self.far[row, k], np.where(best >= RUN, best, 0))
        same = (shared >= size[1:]) & (size[1:] == size[:-1])
        group = np.cumsum(np.r_[True, ~same])
        by = np.lexsort((row, group))
        self.leads[row[by], k[by]] = np.r_[True, np.diff(group[by]) != 0]


def meet(lists: list[bytes]) -> list[bytes]:
    """For each list of neighbourhoods, four numbers for each: how many phrases of the runs that start 2, 1 and 0 before the point another place has too, and bits that say
    of which runs this is the first list that has them."""
    parts = [unsqueeze(x) for x in lists]
    sizes = [len(p[0]) // 8 for p in parts]
    points = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
    head = np.concatenate([np.frombuffer(zstandard.decompress(p[1]), "<u2").reshape(2 + RUN, -1).T for p in parts]).astype(np.int64)
    near = np.concatenate([np.frombuffer(p[2], "<u4") for p in parts]).astype(np.uint64)
    many = np.concatenate([np.unpackbits(np.frombuffer(p[3], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
    length = head[:, 1]
    start = np.cumsum(length) - length
    _, first, inverse = np.unique(ragged_hashes(near, length, np.c_[points, head[:, 0], head[:, 2:]]), return_index=True, return_inverse=True)
    own = Runs(points[first], head[first], near, np.bincount(inverse, weights=1 + many), start[first])
    own.settle()
    out = np.zeros((len(inverse), RUN + 1), "<u2")
    out[:, :RUN] = own.far[inverse]
    out[first, RUN] = (own.leads << np.arange(RUN)).sum(axis=1)
    ends = np.cumsum([0, *sizes])
    return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def repeated_bytes(spark: SparkSession, docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, texts: bool = False, scratch: Scratch | None = None, chunked: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for): bytes covered by a `width`-byte string
    that also starts elsewhere, in the same document or another, are removed.

    Null and empty texts, and those shorter than `width`, lose nothing. Repeated rows are documents of their own: each
    removes the other's bytes, if there are enough. Null ids stay null; an empty table gives no rows. kept_text
    leaves out what a cut through a character leaves of it. scratch: where tables are saved, if the caller wants to close it.
    chunked: the ids and kept texts come as chunks (_chunk, _size, _body) instead of rows, each chunk's texts in two at most, so that what reads them in chunks
    needs no other worker beside the one that cuts them.
    """
    if width - GRAM + 1 - 2 * (WINDOW - 1) < (RUN + 1) * WINDOW:
        raise ValueError(f"width must be {GRAM - 1 + 2 * (WINDOW - 1) + (RUN + 1) * WINDOW} at least")
    scratch = scratch or Scratch(spark)
    key = docs.schema[id_col].dataType.simpleString()
    store = scratch.save(chunks(docs, id_col, text_col, chunk))
    n_chunks, held = store.agg(F.count("*"), F.sum("_size")).first()
    size = max(n_chunks * chunk, held or 0)
    all_phrase_bits, meeting_bits, all_string_bits = bucket_bits(size / 24), bucket_bits(size / 8), bucket_bits(size / 8)
    phrase_bits, string_bits = list_bits(all_phrase_bits), list_bits(all_string_bits)
    columns = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    result = "_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    if chunked:
        columns, result, texts = ["_size"], "_size long", True
    empty = [np.zeros(0, np.uint64)]

    def done(i, b: bytes, starts: np.ndarray) -> tuple:
        gone = covered(starts, width, len(b)) if len(starts) else np.zeros(0, bool)
        kept = b if not len(starts) else np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        return i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None

    def rows_of(rows: list[tuple], number: int) -> pd.DataFrame:
        """Rows that are done, or the chunk of them."""
        if not chunked:
            return pd.DataFrame(rows, columns=columns)
        said = [r[-1] for r in rows]
        return pd.DataFrame({"_kind": [4], "_chunk": [number], "_size": [sum(map(len, said))], "_body": [chunk_body([r[0] for r in rows], said)]}).iloc[: len(rows)]

    def read(body: bytes) -> tuple[list, list[bytes], list[Parsed]]:
        using("bytes")
        ids, said = chunk_rows(body)
        raw = [t.encode("utf-8", "surrogatepass") for t in said]
        return ids, raw, [parse(b, width) for b in raw]

    def string_keys(parsed: list[Parsed], picks: list[np.ndarray]) -> Keys:
        def hashes(half: bool) -> np.ndarray:
            return np.concatenate([p.strings(k, width, half) for p, k in zip(parsed, picks, strict=True)] + empty)

        return exact_keys(hashes(False), lambda: hashes(True), size)  # in a corpus full of repeats nearly every string is compared

    def phrase_keys(parsed: list[Parsed]) -> Keys:
        return Keys(trimmed(np.concatenate([p.phrases for p in parsed] + empty), size / 24))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, body in zip(b["_chunk"], b["_body"], strict=True):
                rows = list(phrase_keys(read(body)[2]).lists(phrase_bits))
                yield pd.DataFrame({"_chunk": c, "_bucket": [r[0] for r in rows], "_list": [r[1] for r in rows]})

    phrases = answer(store.mapInPandas(lean(ask), "_chunk long, _bucket int, _list binary"), all_phrase_bits, n_chunks)
    mixed = "_kind int, _chunk long, _bucket int, _list binary, _body binary"
    names = ["_kind", "_chunk", "_bucket", "_list", "_body"]

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Texts without a run of phrases that occur twice are done; the others go on."""
        if not len(left):
            return pd.DataFrame(columns=[*names, *columns])
        ids, raw, parsed = read(left["_body"].iloc[0])
        keys = phrase_keys(parsed)
        twice = keys.answers(phrase_bits, replies_of(right), 2)[0][keys.inverse]
        c, at, on, rows = left["_chunk"].iloc[0], 0, [], []
        for k, p in enumerate(parsed):
            own = twice[at : at + len(p.phrases)]
            at += len(own)
            if len(runs(own)):
                on.append((k, own))
            else:
                rows.append(done(ids[k], raw[k], np.zeros(0, np.int64)))
        out = [rows_of(rows, 2 * int(c))]
        if on:
            lists = [(0, *x) for x in Meetings([(parsed[k], own) for k, own in on]).lists(meeting_bits)]
            out.append(pd.DataFrame({"_kind": [x[0] for x in lists], "_chunk": c, "_bucket": [x[1] for x in lists], "_list": [x[2] for x in lists]}))
            flags = squeeze(*(np.packbits(own).tobytes() for _, own in on))
            out.append(pd.DataFrame({"_kind": [2], "_chunk": [c], "_list": [flags], "_body": [_again([ids[k] for k, _ in on], [raw[k] for k, _ in on])]}))
        return pd.concat(out, ignore_index=True).reindex(columns=[*names, *columns])

    first = scratch.save(store.groupBy("_chunk").cogroup(phrases.groupBy("_chunk")).applyInPandas(_typed(lean(gather)), f"{mixed}, {result}"))

    def come(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        return pd.DataFrame({"_chunk": pdf["_chunk"], "_bucket": pdf["_bucket"], "_reply": meet(pdf["_list"].to_list())})

    scratch.drop(store)  # whatever is still needed of it is in `first`
    reply = "_chunk long, _bucket int, _reply binary"
    replies = scratch.save(first.where("_kind = 0").groupBy("_bucket").applyInPandas(lean(come), reply).selectExpr("0 as _kind", "*"))

    def narrow(left: pd.DataFrame, right: pd.DataFrame) -> tuple:
        """Of each text, which strings are repeated for certain (2, or 3 where others are compared with it) and which are to compare (1)."""
        ids, raw, parsed = read(left["_body"].iloc[0])
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(p.phrases)).astype(bool) for f, p in zip(unsqueeze(left["_list"].iloc[0]), parsed, strict=True)]
        meetings = Meetings(list(zip(parsed, flags, strict=True)))
        common, lead = meetings.common(meeting_bits, replies_of(right[right["_kind"] == 0]))
        states = []
        for k, p in enumerate(parsed):
            n, at = len(p.ends), meetings.starts[k]
            far = common[at : at + len(p.phrases)]
            certain = meetings.whole[at : at + n] & (far[:n] >= p.ends - np.arange(n)) & (far[:n] > 0)
            sends = lead[at : at + n]
            m = p.n - width + 1
            near = np.zeros(m + 1, np.int64)
            run = np.flatnonzero(far)
            # A repeat parses alike but for WINDOW - 1 grams at its ends, so its first common phrase starts, and its last one ends, within 2 * (WINDOW - 1) of them.
            low, high = np.maximum(p.at[run] - 2 * (WINDOW - 1), 0), np.minimum(p.at[run + far[run]] - (width - GRAM - 2 * (WINDOW - 1)), m - 1) + 1
            np.add.at(near, low[low < high], 1)
            np.add.at(near, high[low < high], -1)
            state = (np.cumsum(near)[:m] > 0).astype(np.uint8)
            if n:
                known = np.repeat(np.where(certain, np.where(sends, 3, 2), 0).astype(np.uint8), np.diff(p.at[: n + 1]))[:m]
                head = state[: len(known)]
                head[:] = np.where(known == 0, head, np.where(head == 0, np.minimum(known, 2), known))
            states.append(state)
        picks = [np.flatnonzero((x == 1) | (x == 3)) for x in states]
        return ids, raw, parsed, states, picks

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["_chunk", "_bucket", "_list"])
        _, _, parsed, _, picks = narrow(left, right)
        lists = list(string_keys(parsed, picks).lists(string_bits))
        return pd.DataFrame({"_chunk": left["_chunk"].iloc[0], "_bucket": [x[0] for x in lists], "_list": [x[1] for x in lists]})

    on = first.where("_kind = 2").select("_chunk", "_list", "_body")
    strings = answer(on.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInPandas(_typed(lean(send)), "_chunk long, _bucket int, _list binary"), all_string_bits, n_chunks)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The states are found again rather than saved, as the lists of strings are by far the most that is written."""
        rows, c = [], -1
        if len(left):
            c = int(left["_chunk"].iloc[0])
            ids, raw, parsed, states, picks = narrow(left, right)
            keys = string_keys(parsed, picks)
            twice = keys.answers(string_bits, replies_of(right[right["_kind"] == 3]), 2)[0][keys.inverse]
            at = 0
            for i, b, s, k in zip(ids, raw, states, picks, strict=True):
                yes = s >= 2
                yes[k] |= twice[at : at + len(k)]
                at += len(k)
                rows.append(done(i, b, np.flatnonzero(yes)))
        return rows_of(rows, 2 * c + 1)

    every = replies.unionByName(strings.selectExpr("3 as _kind", "*"))
    finished = on.groupBy("_chunk").cogroup(every.groupBy("_chunk"))
    if chunked:
        body = ["_chunk", "_size", "_body"]
        return first.where("_kind = 4").select(*body).unionByName(finished.applyInPandas(lean(lambda left, right: finish(left, right)[body]), "_chunk long, _size long, _body binary"))
    last = finished.applyInPandas(lean(finish), result)
    out = first.where("_kind is null").select(*columns).unionByName(last).withColumn("_id", F.col("_id").cast(key)).withColumnRenamed("_id", id_col)
    return out if texts else out.drop("kept_text")


def _again(ids: list, raw: list[bytes]) -> bytes:
    return chunk_body(ids, [b.decode("utf-8", "surrogatepass") for b in raw])
