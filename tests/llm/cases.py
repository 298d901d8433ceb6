"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, score double, length int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "den", "lo", "mi", "tra", "su", "ek", "ö"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 160)
    words = base.split()
    near = " ".join([*words[:80], "changed", *words[81:]])
    shared = prose(7, 90)
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, prose(2, 60)), (8, prose(2, 60)), (9, "word " * 120), (None, prose(3, 70)),
        (10, prose(4, 50) + " " + shared), (11, shared + "\n" + prose(5, 40)), (12, "Mr John Smith wrote to hsr.29@mail5.example.com or +1 (269) 555-3296.\nMr Smith, 44.144.35.254, 4041894974608795"),
        (13, prose(6, 9000)), (14, "é" * 500), (9_007_199_254_740_993, "one two three four five six"), (16, "x<|endoftext|>y 日本   ½"),
    ]


def rows():
    return [(i, t, "en" if k % 3 else None, "src0" if k % 2 else "src1", len(t) if t else None, "clash", "clash", 9.9, 3) for k, (i, t) in enumerate(texts())]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def got(df, key="doc_id"):
    """{id: sorted rows as dicts}"""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out
