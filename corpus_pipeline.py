"""Corpus pipeline: the stages from raw documents to packed training bins.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written as Parquet and read again as the next one's documents.  All but the last
return the columns of documents, so any of them can be left out or put elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.llm import mixing, neardup, packing, quality
from riskloom.llm.common import free_names
from riskloom.session import shared_folder


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule and the list learned from the labels keep."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, rules)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group that fingerprints within three bits, or five-word shingle sets of similarity 0.8, link.

    SimHash alone leaves most edited copies: of pairs with that similarity it links few whose sets differ.
    """
    return neardup.keep_one(docs)


def mixing_sources(spark, docs, sf_dir):
    """Documents in training order, as often as their source's budget of words takes them."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of documents with their places in bins: ``piece_text`` is what a bin holds at ``bin_offset``.

    The slice of the training order that a row lies in is part of what it is dealt by, so
    repeats of a document seldom meet in a bin.
    """
    (part,) = free_names(docs, "slice")
    dealt = docs.withColumn(part, F.spark_partition_id())
    return packing.pack_documents(dealt, keep=("doc_id", "lang", "source", part), with_text=True).drop(part)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: The learned list and the fingerprints are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
