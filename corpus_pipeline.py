"""From documents to training sequences: every stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns
of documents, and the last one the packed pieces. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, line_dedup, packing, toxicity
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.storage import keep, table
from graphloom.session import local_checkpoints


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the machine learns from the labelled ones among them."""
    machine = toxicity.fit(docs, table(local_checkpoints(spark), sf_dir, "labels"))
    return toxicity.with_score(docs, machine, "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars is counted anew. No document goes."""
    local_checkpoints(spark)
    cleaned = line_dedup.drop_site_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; documents without an id stay."""
    local_checkpoints(spark)
    ids = near_duplicates(docs, size=5, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).union(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.contaminated(docs, table(local_checkpoints(spark), sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    local_checkpoints(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The kernel machine, the alignment and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(local_checkpoints(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs)
    return docs
