"""The corpus pipeline: five stages over ``documents``, each one of the corpus operators.

Toxicity and quality drop the documents that they reject, near-dedup keeps one document of each class,
mixing takes each leaf's token-prefix, and packing places what is left in sequences. Each stage
reads what its predecessor kept, written as Parquet to the shared folder.

Defined results, each stage on its own input: a null or empty text passes toxicity and quality by the share of the labelled texts
without rules and of label 1; near-dedup keeps each row without words, but one for each id, and of all other classes one
row; mixing takes rows of one id, or without id, of a leaf together or not at all; packing makes one piece of an empty text. Rows
that repeat stay until near-dedup. Columns other than those of the table pass through all stages but the last, whatever their
names. Without labelled texts nothing is toxic and all pass quality. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm.common import crc_mod, documents, kept_rows, saved, unused_name
from sheetlens.llm.minhash_dedup import one_of_each_class
from sheetlens.llm.mixing import mix, tree
from sheetlens.llm.packing import pack
from sheetlens.llm.quality import fit_quality
from sheetlens.llm.queries import TOKENIZER
from sheetlens.llm.toxicity import fit_toxicity

TOXIC_FROM = 0.3
GOOD_FROM = 0.3
#: The mix takes nine tenths of the tokens that reach it, each document once at most.
MIX_FRACTION = 0.9


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, "text", fit_toxicity(docs, labels_of(spark, sf_dir), crc_mod("doc_id", 4) != 2), below=TOXIC_FROM)


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, "text", fit_quality(docs, labels_of(spark, sf_dir), crc_mod("doc_id", 5) != 0), least=GOOD_FROM, rows=500)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs, *tree(), fraction=MIX_FRACTION, epochs=1)
    name = unused_name(docs, "taken")
    ids = saved(taken.select(F.col("doc_id").alias(name)).distinct(), "taken")
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER), capacity=1024)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_ones),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Stages one to three and the packing are beyond SQL; tests hold each stage's rows against loops, and ``run`` against all of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
