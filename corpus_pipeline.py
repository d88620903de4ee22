"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and works on all the documents that its predecessor kept:

1. quality       drops the documents that the quality classifier rejects (predicted 0 at 0.7).
2. toxicity      drops the documents that the toxicity classifier rejects (score 0.7 or more).
3. near-copies   keeps of each group of linked documents the one with the smallest doc_id, told by doc_id and text.
4. secrets       replaces every finding of the secret scan in the text; no document is dropped.
5. packing       returns the pieces of packed token sequences.

All but the last return the columns of documents, whatever further columns they have; helper columns take names
that are free. Classifiers learn from sf_dir's labels, joined to the documents at hand; rows with a doc_id that
is null are judged by their text all the same, since judgement is a column of the same row. Null, empty and
blank texts are judged as texts without words, link with nothing and pack as the end id alone; an empty table
gives empty tables. ORACLE_SQL is None: SQL expresses none of
the trained stages, so the pipeline is tested against a plain version of its rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import ngram_join, packing, quality_model, secrets, toxicity
from linkspark.llm.labelled import free_name
from linkspark.llm.scratch import Scratch

THRESHOLD = 0.7


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.train(docs, _labels(spark, sf_dir))
    score = free_name(docs, "score")
    return quality_model.with_score(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, _labels(spark, sf_dir))
    score = free_name(docs, "score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id; of rows with the same doc_id and text any one stays.

    Rows are told apart by doc_id and text, so different texts with one doc_id, or with none, are judged each
    by its own component. Rows with neither doc_id nor words link with nothing and all stay.
    """
    keep = ngram_join.one_of_each(docs)
    blank = F.col("doc_id").isNull() & F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    own = free_name(docs, "key")
    rows, first = docs.where(~blank).withColumn(own, ngram_join.text_key()).alias("row"), keep.alias("first")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("first.doc_id")) & (F.col(f"row.{own}") == F.col("first.key"))
    kept = rows.join(first, same, "left_semi")
    kept = kept.dropDuplicates(["doc_id", own]) if keep.where("n > 1").take(1) else kept
    return kept.drop(own).unionByName(docs.where(blank))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("toxicity", clean),
    ("near_copies", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        made = work.stash(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=name == STAGES[-1][0])
        work.discard(docs)
        docs = made
    return docs
