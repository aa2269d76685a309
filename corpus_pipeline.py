"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all that the one before it kept.  All but the last return the columns of
documents, whatever they are; a stage's own columns have names of two underscores inside.  Rows
with null or empty texts, null ids, repeated rows and empty tables pass as each operator's
docstring says; a null text has no language and goes in the first stage.  A stage first gives back
what the one before it, which is written by then, lent to the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import langid, line_dedup, near_dedup, packing, toxicity
from strata.llm.common import column, give_back, stage

#: A language is rejected if its posterior is not this many times what chance gives it.
OVER_CHANCE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus teaches: those without letters go, and those
    whose language is as good as a guess."""
    give_back()
    languages, model = langid.learn(docs.where(~langid.held_out()).select("text", "lang"))
    told = langid.predict(docs, languages, model)
    sure = F.col("__confidence") * len(languages) >= min(OVER_CHANCE, len(languages))
    return told.where((F.col("__lang") != langid.UNKNOWN) & sure).select(*map(column, docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity models predict to be toxic."""
    give_back()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    labelled = docs.where(~langid.held_out()).select("doc_id", "text").join(labels.hint("merge"), "doc_id")
    told = toxicity.score(docs, *toxicity.train(labelled))
    return told.where("__predicted = 0").select(*map(column, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share from all but one; all documents stay, with their lengths put right."""
    give_back()
    done = line_dedup.line_dedup(docs)
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return done.select(*(new.get(c, column(c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: that of the smallest id."""
    give_back()
    found = near_dedup.near_dedup(docs.select("doc_id", "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__doc")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into full sequences: one row per piece."""
    give_back()
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language_id", language_id), ("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_copies), ("packing", pack)]
#: Learned models and tokenizers are not SQL; tests/llm/test_pipeline.py has the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
