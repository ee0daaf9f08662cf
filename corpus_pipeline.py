"""A corpus pipeline: quality rules, near-duplicates, repeated passages, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of `documents`. `run` writes every stage's rows to the shared folder and reads them back.

1. quality_rules: documents that the rules reject go.
2. ngram_join: five-word shingles, similarity 0.8; the smallest doc_id of each group stays.
3. suffix_dedup: bytes covered by a repeated string of 256 bytes are cut out of the texts, which is a
   passage of more than 50 words of five bytes with the space after them (op10's own 400 bytes would
   leave passages of 51 to 60 words alone).
4. decontamination: documents with a word inside any benchmark window go.
5. source_mixing: every document that is left with its size, its source's target and the words taken.

A stage may be given rows that another has not written yet. Tables that a stage's rows are read from are
deleted when a later stage over the same folder is called with rows that do not read them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fastbreak.llm import decontam, mixing, ngram_join, rules, suffix_dedup
from fastbreak.llm.common import materialize, remove, scratch, table

SHINGLE, PERCENT = 5, 80
PASSAGE = suffix_dedup.PASSAGE

#: By input folder, the tables of the shared folder that rows of earlier stages are read from.
_LEFT: dict[str, list[str]] = {}


def stage(f):
    """A stage that deletes tables of earlier stages over the same folder, but those that its own input still reads."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left, made = _LEFT.setdefault(sf_dir, []), []
        read = docs.inputFiles() if left else []
        for path in list(left):
            if not any(f"/{path.rsplit('/', 1)[1]}/" in x for x in read):
                remove(spark, path)
                left.remove(path)
        with scratch(spark, made):
            out = f(spark, docs, sf_dir)
        left += made
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, PASSAGE)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.op3_source_mixing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can express neither the cuts of stage 3 within reason nor the pseudorandom mix of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        before, docs = docs, materialize(f(spark, docs, sf_dir), name)
        if hasattr(before, "scratch"):
            remove(spark, before.scratch)
    return STAGES[-1][1](spark, docs, sf_dir)
