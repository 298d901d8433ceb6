"""What the operators share: the shared folder, saved tables, chunks of documents, packed hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import inspect
import re
import struct
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Words of a text, for every operator that counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept:
        return kept.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="furrow-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder then stays
        pass


def _end() -> None:
    for path, spark in list(_made.items()):
        _remove(spark, path)


atexit.register(_end)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand at a time, where the session still has Spark's own ten thousand: a batch is held several times over,
    by Spark and by each worker. A session that sets another number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


class Scratch:
    """A folder of saved tables within the shared folder, removed when the process ends or on close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        bounded_batches(spark)
        self.path = f"{shared_folder(spark)}/furrow-{uuid.uuid4().hex}"
        _made[self.path] = spark

    def save(self, df: DataFrame) -> DataFrame:
        """Writes the table and reads it again: this cuts the lineage, and the copy outlives lost executors."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._furrow_path = path
        return out

    def drop(self, saved: DataFrame) -> None:
        """Removes a saved table that nothing reads any more."""
        _remove(self.spark, saved._furrow_path)

    def close(self) -> None:
        _remove(self.spark, self.path)
        _made.pop(self.path, None)


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, which it otherwise does when the driver happens to collect its garbage."""
    for _ in range(3):  # what one round frees may hold what the next one finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE, BASE_2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95 | 1)


#: Powers that a worker keeps; those of longer texts are made anew for each.
POWERS = 1 << 18


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.bases = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.kept = self._made(POWERS)

    def _made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in self.bases:
            v = np.full(n, b, np.uint64)
            v[:1] = 1
            out.append(np.multiply.accumulate(v))
        return out[0], out[1]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.kept if n <= POWERS else self._made(n)
        return up[:n], down[:n]


_powers = (Powers(BASE), Powers(BASE_2))


def window_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `width` values (uint64, well mixed): a polynomial modulo 2**64, then mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers[which].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[width:] - total[:n]) * down[:n])


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed differences, byte planes apart."""
    d = np.diff(sorted_hashes.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(*parts: bytes) -> bytes:
    """Byte strings as one, with their lengths."""
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unsqueeze(body: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", body)[0]
    sizes = struct.unpack_from(f"<{n}I", body, 4)
    out, at = [], 4 + 4 * n
    for s in sizes:
        out.append(body[at : at + s])
        at += s
    return out


#: What workers keep from text to text, by operator family.
_kept: dict[str, list] = {}
_using = ""


def keeps(family: str, cache):
    """Enters a cache, which has reset(), under its family."""
    _kept.setdefault(family, []).append(cache)
    return cache


def using(family: str) -> None:
    """A worker that turns to another operator empties the caches of those before and gives freed memory back, as it may live through all
    of a pipeline."""
    global _using
    if family != _using:
        for name, caches in _kept.items():
            if name != family:
                for c in caches:
                    c.reset()
        _using = family
        give_back()


def give_back() -> None:
    """Returns memory that was freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """A function of a group, of two or of batches, after which its worker gives freed memory back: idle workers live on for a minute beside those that run, each
    with what its largest group took."""

    def batches(every):
        yield from f(every)
        give_back()

    def one(group):
        out = f(group)
        give_back()
        return out

    def two(left, right):
        out = f(left, right)
        give_back()
        return out

    return batches if inspect.isgeneratorfunction(f) else two if len(inspect.signature(f).parameters) == 2 else one


class Generations(dict):
    """What `make` gives for a word, in two generations: once the young one holds `most` bytes, about, it becomes the old one, and what is looked up there is young again. Memory
    stays bounded, and what is frequent is not made anew. fixed: entries that always stay."""

    def __init__(self, most: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.most, self.fixed, self.old, self.held = most, fixed or {}, {}, 0

    def make(self, word: str):
        raise NotImplementedError

    def reset(self) -> None:
        self.clear()
        self.update(self.fixed)
        self.old, self.held = {}, 0

    def __missing__(self, word: str):
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
            self.held = 0
        self.held += 160 + 2 * len(word) + (len(made) if isinstance(made, bytes) else 0)
        self[word] = made
        return made


class _WordHashes(dict):
    """Word -> 64-bit hash; starts anew when it holds some 20 MB, so that memory stays bounded."""

    held = 0

    def __missing__(self, word: str) -> int:
        if self.held > 20 << 20:
            self.reset()
        self.held += 200 + 2 * len(word)
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def reset(self) -> None:
        self.clear()
        self.held = 0


_word = re.compile(WORD)
_word_hashes = keeps("words", _WordHashes())


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a whole text, in order."""
    using("words")
    words = _word.findall(text)
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
