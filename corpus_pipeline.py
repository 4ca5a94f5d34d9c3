"""The corpus pipeline: five stages over documents, each written and read again before the next.

Stages get (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Every
threshold is a parameter of the operator that the stage calls.

Defined results of the stages: a null or empty text has no language and goes with the first stage; nulls in the other columns
are kept as they are (a null lang teaches nothing); rows with a null doc_id are in no group, share no line and are
never contaminated, so only the language stage can drop them; equal rows meet the same fate, and a near-duplicate group
named by their doc_id keeps all rows of that id; ties go as the operators state; an empty table stays empty; columns
beside those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import decontam, langid, linededup, neardup, packing
from sentrylake.llm.queries import WORD_BPE, table, tokenizer_path
from sentrylake.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; profiles and the least score of each language are learned from the labelled ones."""
    found = Scratch(spark, "language").write(langid.predict(docs.select(*COLUMNS), langid.learn_profiles(docs)), "found")
    told = F.lit(False)
    for lang, least in langid.least_scores(found).items():
        told = told | ((F.col("lang_pred") == lang) & (F.col("score") >= least))
    return found.filter(told).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; documents with no line left go."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    bare = (F.col("n_dropped") > 0) & (F.length(F.btrim("text", F.lit(linededup.WHITE))) == 0)
    return kept.filter(~F.coalesce(bare, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; those without a doc_id are in no group."""
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    return docs.select(*COLUMNS).join(groups.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS).join(found.filter("n_hit > 0").select("doc_id").distinct(), "doc_id", "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 tokens. A small word cache, as workers live on through all stages."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path(WORD_BPE), cache=250_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

#: learned profiles, sketches and the packing's linear program have no SQL form; tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
