"""The queries that apply each corpus operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_sql, embedding_dedup, license_scan, merkle, phrases, topk_search, warc
from .chat_format import ROLES, format_chats, learn
from .common import crc_mod, documents
from .embedding_dedup import linked_vectors
from .language_id import identify_language
from .license_scan import scan_licenses
from .minhash_dedup import near_duplicate_classes
from .mixing import mix, oracle, tree
from .packing import pack
from .quality import score_quality
from .topk_search import top_k
from .toxicity import score_toxicity

TOKENIZER = "byte_bpe_50k.json"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


MIX_FRACTION = 0.5


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), *tree(), fraction=MIX_FRACTION)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), capacity=1024)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rules")


#: How transcripts write a turn, by conversation: the roles' markers, and how a marker is written.
NAMES = (("System", "User", "Assistant"), ("SYS", "Human", "Bot"), ("Instructions", "Q", "A"), ("Context", "Customer", "Agent"))
WRITTEN = (("", ": "), ("### ", "\n"), ("[", "] "), ("<|", "|> "), ("**", ":** "))
#: Of a hundred turns: so many have no marker, an unknown name, a misspelt one, another role's, a line inside that looks like a marker.
MISSING, UNKNOWN, MISSPELT, SWAPPED, INNER = 8, 4, 4, 2, 6
INNER_LINE = "\nNote: see above."


def noise(seed: int) -> Column:
    """A number from 0 to 99 by transcript, part and seed."""
    digest = F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def inner_line() -> Column:
    """The line that looks like a marker inside some turns; it belongs to their text."""
    return F.when(noise(2) < INNER, F.lit(INNER_LINE)).otherwise(F.lit(""))


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, part, text: raw transcripts of labelled turns, with markers that are missing, unknown, misspelt or wrong."""
    style = F.coalesce(F.col("conv_id").cast("long"), F.lit(0))
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("long")  # from 1, 0 for none
    u = noise(1)
    wrong = u < MISSING + UNKNOWN + MISSPELT + SWAPPED
    asked = F.when((u >= MISSING + UNKNOWN + MISSPELT) & wrong & (number > 0), number % 3 + 1).otherwise(number)
    names = F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in NAMES)), (F.pmod(style, F.lit(len(NAMES))) + 1).cast("int"))
    name = F.when(asked > 0, F.try_element_at(names, asked.cast("int")))
    name = F.when((u >= MISSING) & (u < MISSING + UNKNOWN), "Dana").when((u >= MISSING + UNKNOWN) & (u < MISSING + UNKNOWN + MISSPELT), F.concat(name, F.lit("x"))).otherwise(name)
    at = (F.pmod(F.floor(style / len(NAMES)), F.lit(len(WRITTEN))) + 1).cast("int")
    before, after = (F.element_at(F.array(*(F.lit(w[i]) for w in WRITTEN)), at) for i in (0, 1))
    marker = F.when((u < MISSING) | name.isNull(), "").otherwise(F.concat(before, name, after))
    return turns.select("conv_id", F.col("turn").alias("part"), F.concat(marker, F.coalesce("text", F.lit("")), inner_line()).alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_chats(transcripts(turns), learn(turns, "conv_id", "turn", "role", "text"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_language(documents(spark, sf_dir), crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), changed={"text": merkle.lowered("text")}, suspect=crc_mod("doc_id", 5) == 0)


#: One page in so many has a torn write before its record: the archives that the query reads are damaged ones.
TORN = 16


def pages_in_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and gaps of the archives of all pages."""
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), "2024-01-01T00:00:00Z", torn=crc_mod("page_id", TORN) == 3)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pages_in_archives(spark, sf_dir).where("gap IS NULL")
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_topk_search": op7_topk_search,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": oracle(MIX_FRACTION),
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op6_chat_formatting": chat_sql.oracle(NAMES, WRITTEN, MISSING, UNKNOWN, MISSPELT, SWAPPED, INNER, INNER_LINE),
    "op7_topk_search": topk_search.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_phrase_mining": phrases.ORACLE,
    "op12_merkle_manifest": merkle.oracle(),
    "op13_warc": warc.ORACLE,
}
