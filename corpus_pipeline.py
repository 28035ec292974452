"""A corpus pipeline: every stage works on all that its predecessor kept.

All stages but the last return the columns of their input, whatever others it has
besides doc_id, text, lang and source.

- language_id drops null and letterless texts and texts that no learned language
  knows; equal texts are judged alike, rows without an id like others.
- quality_rules judges every row by its own text; a null language or source is a
  group of its own, values on a fence stay.
- ngram_jaccard_join keeps the row with the smallest id of each class, of repeated
  rows one; rows without an id stay.
- substring_dedup takes from each text what also starts in a smaller id and drops
  texts that lose all words; repeated rows lose the same, rows without an id nothing.
- best_fit_packing returns a row for each piece of each text; nothing is dropped.

Empty tables pass through all stages; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import langid, ngram_join, packing, phrase_dedup, quality
from strandweave.llm.common import forget, remove_folder, scratch, sweep, swept_from, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_dedup.keep_rest(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Signature tries and automata have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; earlier stages' tables are removed."""
    docs, before, mark = table(spark, sf_dir, "documents"), None, swept_from()
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        forget(path)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, mark)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
