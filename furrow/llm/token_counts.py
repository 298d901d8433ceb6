"""Token counts by the whole-token shortcut.

Before any text is read, the driver proves from the vocabulary file alone which vocabulary strings encode alone as one
token (`Encoder.prove`); the few that don't go to the workers with the code. A text is split into pre-tokens; those in
the proven set count one each, and only the others go through the merges, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.bpe import encoder
from furrow.llm.common import bounded_batches


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One map over the rows, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give a row each; an
    empty table gives none. Other columns, whatever their names, are not read. Texts are never cut: a
    very long one is counted whole, in memory proportional to its own length.
    """

    unproven = encoder(tokenizer).prove()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer, unproven)
        for b in batches:
            n = [e.count(t) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "_bytes": b["_bytes"], "_n": n})

    bounded_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", F.octet_length("_text").cast("long").alias("_bytes"))
    out = rows.mapInPandas(count, "_id string, _bytes long, _n long")
    return out.select(F.col("_id").cast(key).alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))
