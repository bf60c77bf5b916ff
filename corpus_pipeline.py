"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on everything its
predecessor kept. All but the last return the columns of documents, whatever more columns there are and whatever
they are called. What a stage returned is written before the next one begins, so a stage first deletes the work tables that
earlier ones left in the shared folder, unless its own input still reads them.

Defined results: an empty table gives no rows from any stage. Null, empty and blank texts: the quality stage gives them the labelled rows'
mean, so they stay if that is at least the threshold; exact dedup keeps one of them; near dedup and decontamination leave it; packing
gives it its end id. Repeated rows are copies: one stays. Of copies the longest text stays, then the smallest doc_id, null ids
last, then the first row; of near copies the smallest doc_id. Rows with null or repeated doc_ids are decided by row. Very long texts are
read whole in every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, jaccard, packing, quality, tokens
from tidemark.llm.common import dropped, free_name, recorded, released, table, written

#: Near copies share 80 of 100 or more of their joint shingles of five words.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


_left: list[str] = []  # work tables of stages that may be over


def tidying(stage):
    """stage, that deletes what earlier ones left and gives the driver's free memory back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for path in [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)]:
            dropped(spark, path)
            _left.remove(path)
        released(spark)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@tidying
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says label 1: at least quality.THRESHOLD. The model is fitted on all folds' labels."""
    column = free_name("__score", docs)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, column).filter(F.col(column) >= quality.THRESHOLD).drop(column)


@tidying
def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


@tidying
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)


@tidying
def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@tidying
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, tokens.default_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("decontamination", no_benchmark_passages),
    ("packing", packed),
]

#: Nearest neighbours, tiling and packing aren't SQL's to express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if path := getattr(before, "_tidemark_path", None):
            dropped(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
