"""A corpus made ready for training: toxic documents go, one of each group of near copies stays, repeated passages are cut, personal
data gets surrogates, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
Null and empty texts pass through every stage; an empty table gives an empty result. Rows are told apart by numbers of their own where they
are compared, so rows of null or repeated ids are judged each by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import jaccard, packing, passages, pii, substrings, toxicity
from furrow.llm.common import Scratch, forget, fresh
from furrow.llm.queries import BYTE_BPE, PII_KEY, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, by a model of the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learns())
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.score(docs, model, keep=others)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest id (null ids last, then the first row)."""
    (row,) = fresh(docs, "_row")
    numbered = Scratch(spark).save(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard.join(spark, numbered, id_col=row).where("n_links > 0")
    linked = found.select(row, F.col("component_id").alias("_group")).join(numbered.select(row, F.col("doc_id").alias("_id")), row)
    stays = linked.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", F.col(row).alias("n"))).alias("_least"))
    gone = linked.join(stays, "_group").where(F.col(row) != F.col("_least.n")).select(row)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


#: Words of a repeated passage. One of over 50 words holds so many even where its first and last words touch other characters.
PASSAGE = 45


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in a 400-byte string found elsewhere too, and then without the words that lie in PASSAGE words found elsewhere too, as passages
    of short words have fewer bytes; n_chars is that of what is left."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("_row"), "text")
    scratch = Scratch(spark)
    cut = substrings.repeated_bytes(spark, rows, id_col="_row", scratch=scratch, chunked=True)

    def read() -> None:
        scratch.close()
        forget(spark)

    cut = passages.repeated_words(spark, cut, PASSAGE, id_col="_row", texts=True, read=read, chunked=True)
    kept = cut.withColumn("_row", F.from_json("_row", docs.select(*others).schema))
    whole = kept.select("_row.*", F.col("kept_text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return whole.select(*docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    out = pii.pseudonymise(spark, docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(spark, docs, BYTE_BPE)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeats", without_repeats),
    ("surrogates", with_surrogates),
    ("packing", packed),
]

#: SQL can't express the learned, hashed and keyed stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each one's result saved in the shared folder for the next."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
