"""Best-fit packing by minimum bin slack.

What has to be packed is only a histogram of lengths, at most `capacity` numbers, however many texts
there are. The driver works on that histogram: for each bin it fixes the longest length left, and a
bitset subset-sum dynamic program over the lengths available finds the combination that fills the rest
as far as possible; the combination is removed, as often as the counts allow. Each removal uses up at
least one length below what another copy would need. Pieces find their place by their rank within
their length, which comes from counts by chunk, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.bpe import crc32, encoder
from furrow.llm.common import Scratch, lean


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum that is at most `room`.

    Bit s of `reach` says that sum s can be made. Each step adds a power-of-two bundle of one length;
    the steps are kept to trace the combination back. It ends once `room` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            bundle = min(bundle, left)
            left -= bundle
            steps.append((length, bundle, reach))
            reach |= (reach << (length * bundle)) & mask
            if reach >> room & 1:
                break
            bundle *= 2
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, {}
    for length, bundle, before in reversed(steps):
        if not before >> s & 1:
            s -= length * bundle
            out[length] = out.get(length, 0) + bundle
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (combination {length: times}, how many such bins), for all of the histogram."""
    left, bins = {x: n for x, n in histogram.items() if n}, []
    while left:
        top = max(left)
        left[top] -= 1
        combo = fullest(left, capacity - top)
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[x] // n for x, n in combo.items())
        for x, n in combo.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins.append((combo, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, copies in a bin, first bin, first offset): where the ranks of a length go."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for combo, times in bins:
        at = 0
        for x in sorted(combo, reverse=True):
            r = used.get(x, 0)
            used[x] = r + combo[x] * times
            rows.append((x, r, used[x], combo[x], first, at))
            at += x * combo[x]
        first += times
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each text's pieces with their rank within (partition, length)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, seen, end = encoder(tokenizer), {}, int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = []
            for i, text in zip(b["_id"], b["_text"], strict=True):
                ids = e.id_bytes(text) + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    size = n % capacity or capacity if k == 0 and n > capacity else min(capacity, n - start)
                    rank = seen.get(size, 0)
                    seen[size] = rank + 1
                    rows.append((i, k, start, size, crc32(ids[4 * start : 4 * (start + size)]), rank))
                    start, k = start + size, k + 1
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "_rank"])

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInPandas(lean(cut), "_id string, piece int, start long, length long, ids_crc32 long, _rank long")
    return out.withColumn("_id", F.col("_id").cast(key)).withColumn("_chunk", F.spark_partition_id())


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, source unchanged otherwise.

    A text is its ids and then `end_id`. Only one longer than `capacity` is cut, into pieces of
    `capacity` whose first may be shorter. Null and empty texts are one piece of the end id alone; a
    repeated row is packed again; an empty table gives no rows; other columns aren't read. Equal lengths
    are interchangeable: which takes which place follows the saved order. The pieces are saved
    once (about 50 bytes each), as their ranks must not change between the passes.
    """
    scratch = Scratch(spark)
    saved = scratch.save(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = scratch.save(saved.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    table = places(minimum_bin_slack(histogram, capacity))
    slots = spark.createDataFrame(
        pd.DataFrame(np.array(table, np.int64).reshape(-1, 6), columns=["length", "_from", "_to", "_copies", "_bin", "_offset"]),
        "length long, _from long, _to long, _copies long, _bin long, _offset long",
    )
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n")
    offsets = counts.select("length", "_chunk", before.alias("_before"))
    ranked = saved.join(offsets.hint("merge"), ["length", "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The slots have at most a row for each length and combination, and each combination uses a length up: some thousands of rows.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["_from"]) & (ranked["_rank"] < slots["_to"])).drop(slots["length"])
    rel = F.col("_rank") - F.col("_from")
    return placed.select(
        F.col("_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_bin") + F.floor(rel / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (rel % F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )
