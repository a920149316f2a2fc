"""Documents to packed sequences: rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import STAGED, discard, reads, staged
from stanzagraph.llm.decontamination import find_leaks
from stanzagraph.llm.packing import packed_digest
from stanzagraph.llm.quality_rules import apply_rules
from stanzagraph.llm.simhash import first_of_groups
from stanzagraph.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and their host's verdict keep. Null texts fail; a null doc_id changes nothing."""
    return apply_rules(docs, carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; a null doc_id stands behind all others."""
    return first_of_groups(docs, COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that an earlier one has. A character cut in two goes whole."""
    out = remove_repeats(docs, carry=["lang", "source"], decode=True).withColumnRenamed("kept", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["text", "lang", "source", "n_chars"])
    return leaks.filter("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packed_digest(docs)


#: Tables that stages have made for themselves and that may still be read.
INNER: list[str] = []


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the inner tables of stages before it.

    Stages' results are written and read again, so nothing reads these tables any more;
    those that ``docs`` itself is made of stay.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = reads(docs)
        if not any(p.rsplit("/", 1)[1] in read for p in INNER):
            discard(spark, [p for p in INNER if p in STAGED])
            INNER.clear()
        before = len(STAGED)
        out = stage(spark, docs, sf_dir)
        INNER.extend(STAGED[before:])
        return out

    return run_stage


STAGES = [("quality_rules", tidy(quality)), ("simhash_near_dedup", tidy(near_dedup)), ("suffix_array_dedup", tidy(passage_dedup)), ("benchmark_decontamination", tidy(decontaminate)), ("best_fit_packing", tidy(pack))]

#: Tokenization and suffix arrays are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's output goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(spark, last)
        last = [STAGED[-1]]
    return STAGES[-1][1](spark, docs, sf_dir)
