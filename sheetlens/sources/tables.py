"""Review tables as views over the star-schema tables that stand in for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import guarded

#: Part types that stand for the issue types.
TYPE_OF_PART = {
    "STANDARD": "missing_tag",
    "ECONOMY": "dimension_mismatch",
    "MEDIUM": "unlabeled_element",
    "PROMO": "inconsistent_annotation",
    "SMALL": "missing_scale",
    "LARGE": "incomplete_detail",
}
PAGE_CHARS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readiness_of(read: Callable[[], DataFrame]) -> tuple[str, str]:
    """(ready, ok) if a row can be read, else (unavailable, the error's class and text): a probe that runs a real query."""
    try:
        read().limit(1).collect()
    except Exception as e:  # whatever stands in the way is what the probe reports
        return "unavailable", f"{type(e).__name__}: {e}"
    return "ready", "ok"


def review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: P is pending, O is processing, F is completed."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing").otherwise("completed")
    name, done = F.concat(F.lit("plan_"), F.col("o_orderkey").cast("string"), F.lit(".PDF")), status == "completed"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), name.alias("filename"), F.concat(F.lit("files/"), name).alias("file_path"), F.when(done, F.col("o_orderkey") % 10 + 1).cast("int").alias("page_count"),
        status.alias("status"), F.col("o_orderdate").alias("uploaded_at"), F.when(done, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("analyzed_at"))


def review_issues(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Order lines with their part as issues: one page per line, severity by return flag, type by part.

    With ``documents(id)`` only theirs: lines meet them before their texts are made, so these are not moved.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in TYPE_OF_PART.items() for x in p)), F.split("p_type", " ")[0])
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if documents is None else guarded(lines, documents, "l_orderkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("page_number"), kind.alias("issue_type"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"),
        F.concat("p_name", F.lit(' of "'), "p_brand", F.lit('"')).alias("description"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("grid "), F.col("l_suppkey").cast("string"), F.lit(", north"))).alias("location_hint"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("sheet of "), "p_name")).alias("raw_ocr_text"), F.col("l_shipdate").alias("created_at"))


def text_pages(docs: DataFrame, chars: int = PAGE_CHARS, cap: int | None = None) -> DataFrame:
    """Texts cut into pages: (document_id, page_number from 1, ocr_text), at most ``cap`` pages of each if it is given. A null text has none."""
    pages = F.greatest(F.ceil(F.length("text") / F.lit(chars)), F.lit(1))
    pages = pages if cap is None else F.least(pages, F.lit(cap))
    cut = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), "text", F.explode(F.sequence(F.lit(1), pages.cast("int"))).alias("page_number"))
    return cut.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.substring("text", (F.col("page_number") - 1) * chars + 1, F.lit(chars)).alias("ocr_text"))


DOCUMENTS_SQL = """SELECT o_orderkey AS id, 'plan_' || o_orderkey || '.PDF' AS filename, 'files/plan_' || o_orderkey || '.PDF' AS file_path,
  CASE WHEN o_orderstatus IN ('P', 'O') THEN NULL ELSE o_orderkey % 10 + 1 END::INT AS page_count,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS uploaded_at,
  CASE WHEN o_orderstatus IN ('P', 'O') THEN NULL ELSE o_orderdate + INTERVAL 1 HOUR END AS analyzed_at FROM orders"""
ISSUES_SQL = (
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS document_id, l_linenumber::BIGINT AS page_number,
  CASE split_part(p_type, ' ', 1) """
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_OF_PART.items())
    + """ END AS issue_type,
  CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, p_name || ' of "' || p_brand || '"' AS description,
  CASE WHEN l_linestatus = 'F' THEN 'grid ' || l_suppkey || ', north' END AS location_hint, CASE WHEN l_linestatus = 'F' THEN 'sheet of ' || p_name END AS raw_ocr_text, l_shipdate AS created_at FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def _pages_sql(n: str) -> str:
    return f"""SELECT doc_id AS document_id, p AS page_number, substr(text, (p - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS ocr_text
  FROM (SELECT doc_id, text, unnest(range(1, 1 + ({n})::BIGINT)) AS p FROM documents WHERE text IS NOT NULL)"""


_ALL_PAGES = f"greatest(ceil(length(text) / {PAGE_CHARS}.0), 1)"
WITH_SQL = f"WITH docs AS ({DOCUMENTS_SQL}), issues AS ({ISSUES_SQL}), pages_ AS ({_pages_sql(f'least({_ALL_PAGES}, 10)')}), all_pages AS ({_pages_sql(_ALL_PAGES)})\n"
