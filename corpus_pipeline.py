"""A corpus pipeline over the training-data operators; each stage's rows are written and read again by the next.

Every stage but the last keeps the columns of its input, whatever they are beside doc_id, text, source and n_chars.
Edge cases: null and empty texts are not toxic, count as one group of exact copies (of which one row stays), have no
words that the mix could take, and so end there; rows repeated in every column are copies; null ids and sources are
handled as the operators say; toxicity learns only from rows of `labels` with an id and a label, and where there are
none (an empty table, or no id in common) every score is 0 and nothing is dropped; an empty `documents` gives an empty
result with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import exact_dedup, mixing, pieces, simhash, toxicity
from quirework.llm.common import fresh, materialise, table
from quirework.llm.queries import tokenizer_file


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each run of a document's words in one output shard and pass, n_chars as it
    is then. Rows are written shard by shard, each in its local order."""
    shard, position = fresh(docs, "shard"), fresh(docs, "position")
    out = mixing.mixed_texts(docs, shard_col=shard, position_col=position).drop(shard, position)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model")).drop("decoded")


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("tokens", encoded)]

#: Learned scores, fingerprints and drawn blocks are not expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
