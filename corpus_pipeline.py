"""A corpus pipeline: language ID, near-duplicate removal, passage removal, packing.

Every stage works on all documents that the one before it kept, and is written and read again between
stages, so a lost executor costs one stage at most. Stages but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.kernels import table
from tessera.llm.language_id import held_out, keep_identified, learn
from tessera.llm.packing import best_fit_packing
from tessera.llm.substring_dedup import substring_dedup
from tessera.plans.storage import keep, run_dir, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the model stay; it learns from the labelled ones.

    Those without a letter go, and those that no path of languages makes likelier than chance. Labels,
    sources and ids take no part in the decision.
    """
    return keep_identified(docs, learn(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of the smallest id, also where rows repeat an id or have none."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    own_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = keep(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    found = jaccard_join(keyed, id_col="row", text_col=text).where("n_links > 0").select("row", "component_id")
    copies = keep(found.join(keyed.select("row", own_id), "row"))
    stay = copies.groupBy("component_id").agg(F.min(F.struct(F.col(own_id).isNull().alias("none"), own_id, "row"))["row"].alias("row"))
    gone = copies.join(stay, "row", "left_anti").select("row")
    return keyed.join(gone, "row", "left_anti").select(*names).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that earlier documents' passages cover go; every document stays, with n_chars of what is left."""
    return substring_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", packing)]

#: SQL can't express trigram models, MinHash candidates and a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`. What a stage has kept for itself goes when its result is written."""
    docs, folder = table(spark, sf_dir, "documents"), run_dir(spark)
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
