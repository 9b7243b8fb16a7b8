"""Corpus pipeline: quality filter, line de-duplication, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs,
whatever these are called. In every stage an empty table gives an empty one, rows that share an id are one
document, and:

quality: null, empty and very long texts are judged like others; a row goes by its own text and metadata.
lines: null texts stay; a text that is empty as it comes stays, one that has become empty goes.
near_duplicates: texts without words, and rows without id, are linked with nothing and stay.
decontamination: texts without tokens overlap nothing and stay; rows without id are one document.
packing: null and empty texts are one closing id; repeated rows are packed once each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import cotrain, line_chunks, minhash, packing, spaced_seeds
from tapeline.llm.common import STORES, Store, clear_since, free, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training calls neither low in quality nor toxic."""
    model = cotrain.train(docs, table(spark, sf_dir, "labels")).model
    names = tuple(free(docs, n) for n in ("p_low", "p_toxic", "kept"))
    return cotrain.judge(docs, model, names=names).where(names[2]).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more and repeated lines of over 50 words go; a document of nothing else goes with them. n_chars follows the text."""
    counts = (free(docs, "n_lines"), free(docs, "n_removed"))
    out = line_chunks.drop_repeated_chunks(docs, whole=True, counts=counts).where(F.expr(f"{counts[1]} = 0 or text != ''"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Trained models, signatures and tokenizers are not SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored goes once its result is written, and so does its input."""
    docs, store = table(spark, sf_dir, "documents"), Store(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark = len(STORES)
        out = store.save(stage(spark, docs, sf_dir))
        clear_since(mark)
        if k:
            store.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
