"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is
written as Parquet and read again as the next one's docs.  All but the last return the
columns of their input.

1. language_id: documents without a letter go, and those that are less like their nearest
   language than its training rows are like each other (bounds learnt from those rows).
2. line_dedup: lines that an earlier line resembles are cut out; documents of which no
   line is left go.
3. near_duplicates: one document of each linked group stays.
4. decontamination: documents with a benchmark window go.
5. packing: the documents' tokens in windows of 2048; one row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import contamination, langid, line_dedup, ngram_join, packing
from auditgrid.llm.common import table, written
from auditgrid.llm.queries import tokenizer_path

#: Chunks in a generation of the token cache: executors hold other stages' memory, so less than packing alone takes.
CACHE_ENTRIES = 75_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, protos, bounds = langid.learnt(docs, ~langid.held_out(F.col("doc_id")))
    return langid.accepted(docs, names, protos, bounds)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), cache_entries=CACHE_ENTRIES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Vectors, token ids and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
