"""SentencePiece encoding and decoding by a max-plus scan.

The model is a BPE one, not a unigram one, so its encoding isn't the path of largest summed score. It is, however, the
only path over the text in which each piece is its own encoding and every two neighbours encode to just
themselves. With weight 0 for such neighbours and minus infinity for all others, that is a max-plus problem:
position by position, the best path's last piece follows from those before.

A giant text is cut into chunks at any characters. The state at a cut is the piece that spans or ends at it. A chunk
yields a transfer matrix: for each state at its left cut, the weight of the path to each state at its right cut.
Matrices combine associatively, by max-plus products: tasks combine neighbours, level by level, and on the way down
each level gives the one below the states at its cuts. Each chunk then traces its own part back, on its own. Texts
of one chunk start and end in the one empty state.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Generations, Scratch, keeps, using

#: Characters of a chunk; longer texts are giant. Bytes that a worker's caches hold each, about.
CHUNK, CACHED = 32_768, 100 << 20
#: Neighbouring matrices that a task combines.
FAN = 64

_SPACE = "▁"
#: No piece crosses from another character to a space mark, which is checked when the model is loaded, so parts end there.
_PART = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")

#: A state at a cut: characters before it that its piece covers, and the piece; (0, "") where a piece ends just there
#: and nothing that follows can join it.
State = tuple[int, str]
CLEAN: State = (0, "")


class _Parts(Generations):
    """The ids of parts between places where no piece can cross."""

    def __init__(self, pieces: Pieces):
        super().__init__(CACHED // 2)
        self.pieces = pieces

    def reset(self) -> None:
        super().reset()
        self.pieces.agreed.clear()

    def make(self, part: str) -> bytes:
        return self.pieces.id_bytes(self.pieces.path(part))


class Pieces:
    """A BPE model's vocabulary as the sentencepiece library has it, and the paths over it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        texts = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.score = {texts[i]: self.library.get_score(i) for i in plain}
        self.ids = {texts[i]: i for i in plain}
        if any(_SPACE in t.lstrip(_SPACE) for t in self.score):
            raise ValueError("pieces that cross into a space mark aren't supported")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, self.bytes)):
            raise ValueError("a model without byte pieces isn't supported")
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.packed_bytes = [i.to_bytes(4, "little") for i in self.bytes]
        self.longest = max(map(len, self.score))
        self.text_of = [t.encode() for t in texts]
        for b, i in enumerate(self.bytes):
            self.text_of[i] = bytes([b])
        for i in range(n):
            if self.library.is_control(i) or self.library.is_unknown(i):
                self.text_of[i] = b""
        self.agreed: dict[tuple[str, str], bool] = {}
        #: Pieces of several characters that are their own encoding, and the longest such by its last two characters.
        self.standing = {t for t in self.score if len(t) > 1 and self.merged(t) == [t]}
        self.reach: dict[str, int] = {}
        begins: dict[str, set[int]] = {}
        for t in self.standing:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 0), len(t))
            begins.setdefault(t[:4], set()).add(len(t))
        #: The lengths of those that begin with four, or are three or two, characters, and of those that such a string begins with itself; the longest first.
        self.ahead = {k: tuple(sorted(own | {len(k[:x]) for x in (1, 2, 3) if x == 1 or k[:x] in self.standing}, reverse=True)) for k, own in begins.items()}
        self.part = self._parting()
        self.parts = keeps("pieces", _Parts(self))

    def _parting(self) -> re.Pattern:
        """What splits a text at places where no piece can cross: before space marks and, if no piece holds a letter and another character than space marks before it, between
        letters and others. Only letters of the vocabulary count; a character that isn't in it is a piece by itself."""
        letters = {c for t in self.score for c in t if c.isalpha()}
        if any(0 < sum(c in letters for c in t.lstrip(_SPACE)) < len(t.lstrip(_SPACE)) for t in self.score):
            return _PART
        a = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{_SPACE}*[{a}]+|{_SPACE}*[^{_SPACE}{a}]+|{_SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for strings of two pieces at most: the best-scored pair first, the leftmost of equals."""
        s, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                x = score.get(s[k] + s[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def stands(self, piece: str) -> bool:
        """Whether a piece is its own encoding."""
        return len(piece) == 1 or piece in self.standing

    def agree(self, a: str, b: str) -> bool:
        """Whether two pieces next to each other encode to just themselves."""
        k = (a, b)
        if k not in self.agreed:
            if len(self.agreed) > CACHED // 256:  # pieces are short
                self.agreed.clear()
            self.agreed[k] = self.merged(a + b) == [a, b]
        return self.agreed[k]

    def last_pieces(self, text: str, state: State = CLEAN) -> list[str | None]:
        """For each place p up to the end, the last piece of the path from the state to p; None where no path leads.

        The text starts at the cut; a state's piece may reach into it."""
        n, standing, reach, agreed, agree = len(text), self.standing, self.reach, self.agreed, self.agree
        back, first = state
        last: list[str | None] = [None] * (n + 1)
        begin = len(first) - back
        if begin > n:
            return last
        last[begin] = first
        for p in range(begin + 1, n + 1):
            for q in range(max(begin, p - reach.get(text[max(0, p - 2) : p], 1)), p):
                u = last[q]
                if u is None:
                    continue
                t = text[q:p]
                if t in standing or p - q == 1:
                    yes = not u or agreed.get((u, t))
                    if yes is None:
                        yes = agree(u, t)
                    if yes:
                        last[p] = t
                        break
        return last

    def trace(self, text: str, last: list[str | None], end: int, begin: int) -> list[str]:
        out = []
        while end > begin:
            t = last[end]
            out.append(t)
            end -= len(t)
        return out[::-1]

    def path(self, text: str) -> list[str]:
        """The one path of weight 0 over a whole part, the longest piece tried first. A place has only one such path to it, so one from
        which the end can't be reached is not tried again."""
        n, standing, ahead, agreed, out, dead = len(text), self.standing, self.ahead, self.agreed, [], set()
        at, before, tried = 0, "", 0  # tried: the length of the piece that led nowhere from here, or 0
        while at < n:
            for size in ahead.get(text[at : at + 4]) or ahead.get(text[at : at + 3]) or ahead.get(text[at : at + 2]) or (1,):
                t = text[at : at + size]
                if len(t) < size or (tried and size >= tried) or (dead and at + size in dead) or (size > 1 and t not in standing):
                    continue
                if before:
                    yes = agreed.get((before, t))
                    if yes is None:
                        yes = self.agree(before, t)
                    if not yes:
                        continue
                out.append(t)
                at += size
                before, tried = t, 0
                break
            else:
                dead.add(at)
                tried = len(out.pop())
                at -= tried
                before = out[-1] if out else ""
        return out

    def id_bytes(self, pieces: list[str]) -> bytes:
        out = []
        for t in pieces:
            i = self.packed.get(t)
            out += [i] if i is not None else [self.packed_bytes[b] for b in t.encode("utf-8", "surrogatepass")]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text of one chunk."""
        using("pieces")
        return b"".join(map(self.parts.__getitem__, self.part.findall(self.library.normalize(text))))

    def decode(self, ids: bytes) -> str:
        body = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(_SPACE, " ")
        return body[1:] if body.startswith(" ") else body

    # Chunks of giant texts: `text` starts at the left cut, `cut` is the right one, and behind it follow as many characters as a
    # piece can reach; `before` ends at the left cut.

    def states(self, before: str, after: str) -> list[State]:
        """All states possible at a cut between two strings."""
        if not before or not after or (after[0] == _SPACE and before[-1] != _SPACE):
            return [CLEAN]
        out: list[State] = []
        for back in range(1, min(len(before), self.longest) + 1):
            head = before[-back:]
            for ahead in range(0, min(len(after), self.longest - back) + 1):
                t = head + after[:ahead]
                if (t in self.score or len(t) == 1) and self.stands(t):
                    out.append((back, t))
        return out

    def ends(self, before: str, text: str, cut: int) -> list[State]:
        return self.states((before + text[:cut])[-self.longest :], text[cut:])

    def transfer(self, before: str, text: str, cut: int) -> tuple[list[State], list[State], np.ndarray]:
        """The states at both cuts and the chunk's max-plus matrix over them."""
        left, right = self.states(before, text), self.ends(before, text, cut)
        weight = np.full((len(left), len(right)), -np.inf)
        inner = self._inner(text[:cut])
        for i, a in enumerate(left):
            begin, last = self._reach(text, cut, a, inner)
            for j, b in enumerate(right):
                if self._joins(last, begin, cut, a, b):
                    weight[i, j] = 0.0
        return left, right, weight

    def _inner(self, text: str) -> tuple[int, int]:
        """The first and last place in a chunk that no piece crosses; both -1 if there is none."""
        first = next((m.start() for m in re.finditer(f"(?<=[^{_SPACE}]){_SPACE}", text)), -1)
        if first < 0:
            return -1, -1
        p = len(text)
        while not (text[p - 1] != _SPACE and p < len(text) and text[p] == _SPACE):
            p -= 1
        return first, p

    def _reach(self, text: str, cut: int, a: State, inner: tuple[int, int]) -> tuple[int, list[str | None]]:
        """Where the last path starts that matters at the right cut, and its last pieces; none if the state leads nowhere."""
        first, tail = inner
        if first < 0:
            return 0, self.last_pieces(text[:cut], a)
        if self.last_pieces(text[:first], a)[first] is None:
            return tail, [None] * (cut - tail + 1)
        return tail, self.last_pieces(text[tail:cut])

    def _joins(self, last: list[str | None], begin: int, cut: int, a: State, b: State) -> bool:
        back, piece = b
        if not piece:
            return last[cut - begin] is not None
        start = cut - back - begin
        if start < 0:  # one piece covers the whole chunk: both cuts see the same
            return begin == 0 and a[1] == piece and a[0] + cut == back
        u = last[start]
        return u is not None and (not u or self.agree(u, piece))

    def between(self, before: str, text: str, cut: int, a: State, b: State) -> bytes:
        """The ids of the pieces that start in the chunk, given the states at its cuts."""
        first, tail = self._inner(text[:cut])
        end = cut - b[0] if b[1] else cut
        reach = len(a[1]) - a[0]
        if end < 0:  # the piece at the right cut started before the chunk
            return b""
        final = [b[1]] if b[1] else []
        if first < 0:
            return self.id_bytes(self.trace(text, self.last_pieces(text[:cut], a), end, reach) + final)
        head = self.trace(text, self.last_pieces(text[:first], a), first, reach)
        middle = self.part.findall(text[first:tail])
        rest = self.trace(text[tail:cut], self.last_pieces(text[tail:cut]), end - tail, 0)
        return self.id_bytes(head) + b"".join(map(self.parts.__getitem__, middle)) + self.id_bytes(rest + final)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices, pairwise in a tree: it doesn't matter which pairs are taken first."""
    while len(matrices) > 1:
        matrices = [product(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def scan(matrices: list[np.ndarray], first: int = 0, last: int = 0) -> list[int]:
    """The state's number at each cut, from that at the first and that at the last. Halves are combined by themselves; the state between them is the one by which the
    two halves weigh most, and then each half is looked at on its own."""
    if len(matrices) == 1:
        return [first, last]
    half = len(matrices) // 2
    left, right = combined(matrices[:half]), combined(matrices[half:])
    middle = int(np.argmax(left[first] + right[:, last]))
    return scan(matrices[:half], first, middle)[:-1] + scan(matrices[half:], middle, last)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def crc(body: bytes) -> int:
    return zlib.crc32(body) & 0xFFFFFFFF


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, ids: bool = False) -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), n_chunks, round_trip (whether the decoded
    ids are the text), and ids (binary) if asked for.

    Null and empty texts have no pieces. Repeated rows give a row each, null ids stay null, an empty table gives none. A text with
    a space mark of its own is decoded with a space there, as by the library, so round_trip is false. Other columns, whatever their names,
    aren't read. A very long text is handled in chunks, but cut, normalised and put together again by one task each, in memory some ten times its length.
    """
    scratch = Scratch(spark)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    columns = ["_id", "n_pieces", "ids_crc32", "n_chunks", "round_trip", "ids"]
    schema = "_id string, n_pieces long, ids_crc32 long, n_chunks int, round_trip boolean, ids binary"

    def result(i, text: str, body: bytes, n: int, m: Pieces) -> tuple:
        return i, len(body) // 4, crc(body), n, m.decode(body) == text, body if ids else None

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame([result(i, t, m.encode(t), 1, m) for i, t in zip(b["_id"], b["_text"], strict=True)], columns=columns)

    short = rows.where(F.length("_text") <= chunk).mapInPandas(small, schema)
    giant = scratch.save(rows.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            for r, t in zip(b["_row"], b["_text"], strict=True):
                s = m.library.normalize(t)
                at = list(range(0, len(s), chunk))
                yield pd.DataFrame({"_row": r, "_k": range(len(at)), "_before": [s[max(0, x - m.longest) : x] for x in at], "_part": [s[x : x + chunk + m.longest] for x in at], "_cut": [min(chunk, len(s) - x) for x in at]})

    parts = scratch.save(giant.mapInPandas(cut, "_row long, _k int, _before string, _part string, _cut int").repartition("_row", "_k"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            made = [m.transfer(x, t, c) for x, t, c in zip(b["_before"], b["_part"], b["_cut"], strict=True)]
            yield pd.DataFrame({"_row": b["_row"], "_k": b["_k"], "_n": [len(x[0]) for x in made], "_m": [len(x[1]) for x in made], "_w": [x[2].ravel().tolist() for x in made]})

    kind, fan = "_row long, _k int, _n int, _m int, _w array<double>", FAN
    longest = giant.agg(F.max(F.length("_text"))).first()[0] or 0

    def matrix(w, n, m) -> np.ndarray:
        return np.array(w, float).reshape(n, m)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        w = combined([matrix(*x) for x in zip(pdf["_w"], pdf["_n"], pdf["_m"], strict=True)])
        return pd.DataFrame({"_row": [pdf["_row"].iloc[0]], "_k": [pdf["_k"].iloc[0] // fan], "_n": [w.shape[0]], "_m": [w.shape[1]], "_w": [w.ravel().tolist()]})

    # Up: a level has the products of FAN neighbours of the level below, until a text has FAN at most. Normalised texts may be longer than read, by a few times.
    levels = [scratch.save(parts.mapInPandas(weigh, kind))]
    chunks_left = longest // chunk + 1
    while chunks_left > fan:
        below = levels[-1].withColumn("_b", F.floor(F.col("_k") / fan).cast("int"))
        levels.append(scratch.save(below.groupBy("_row", "_b").applyInPandas(combine, kind)))
        chunks_left = chunks_left // fan + 1

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        states = scan([matrix(*x) for x in zip(pdf["_w"], pdf["_n"], pdf["_m"], strict=True)], int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0]))
        return pd.DataFrame({"_row": pdf["_row"], "_k": pdf["_k"], "_from": states[:-1], "_to": states[1:]})

    # Down: the states at the ends of a group of FAN are known, those within follow from its own matrices.
    states = "_row long, _k int, _from int, _to int"
    found = levels[-1].withColumns({"_first": F.lit(0), "_last": F.lit(0)}).groupBy("_row").applyInPandas(settle, states)
    for level in reversed(levels[:-1]):
        ends = found.select("_row", F.col("_k").alias("_b"), F.col("_from").alias("_first"), F.col("_to").alias("_last"))
        within = level.withColumn("_b", F.floor(F.col("_k") / fan).cast("int")).join(ends, ["_row", "_b"])
        found = within.groupBy("_row", "_b").applyInPandas(settle, states)
    found = scratch.save(found)

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            bodies = []
            for x, t, c, i, j in zip(b["_before"], b["_part"], b["_cut"], b["_from"], b["_to"], strict=True):
                bodies.append(m.between(x, t, c, m.states(x, t)[i], m.ends(x, t, c)[j]))
            yield pd.DataFrame({"_row": b["_row"], "_k": b["_k"], "_ids": bodies})

    traced = parts.join(found, ["_row", "_k"]).mapInPandas(trace, "_row long, _k int, _ids binary")

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m = model(path)
        body = b"".join(right.sort_values("_k")["_ids"])
        return pd.DataFrame([result(i, t, body, len(right), m) for i, t in zip(left["_id"], left["_text"], strict=True)], columns=columns)

    long = giant.groupBy("_row").cogroup(traced.groupBy("_row")).applyInPandas(gather, schema)
    out = short.unionByName(long).withColumn("_id", F.col("_id").cast(key)).withColumnRenamed("_id", id_col)
    return out if ids else out.drop("ids")
