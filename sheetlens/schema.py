"""Tables, value domains and display labels of document review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The domains of the stored columns, with their display labels.
STATUSES = {"pending": "Pending", "processing": "Analyzing", "completed": "Completed", "failed": "Failed"}
SEVERITIES = ("high", "medium", "low")
ISSUE_TYPES = {
    "missing_tag": "Missing Tag",
    "dimension_mismatch": "Dimension Mismatch",
    "unlabeled_element": "Unlabeled Element",
    "inconsistent_annotation": "Inconsistent Annotation",
    "missing_scale": "Missing Scale",
    "incomplete_detail": "Incomplete Detail",
}
SEVERITY_COLOURS = {"high": "red", "medium": "amber", "low": "green"}
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_PAGES = 10
MAX_REPLY_TOKENS = 2048
OCR_PREFIX = 4000
LOG_PREFIX = 200


@dataclass(frozen=True)
class Settings:
    """What one review may be told to do otherwise."""

    max_upload_bytes: int = MAX_UPLOAD_BYTES
    max_pages: int = MAX_PAGES
    max_reply_tokens: int = MAX_REPLY_TOKENS


DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("uploaded_at", T.TimestampNTZType(), False),
    T.StructField("analyzed_at", T.TimestampNTZType()),
])

ISSUES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("issue_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("location_hint", T.StringType()),
    T.StructField("raw_ocr_text", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

PAGES = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("image", T.BinaryType()),
    T.StructField("ocr_text", T.StringType(), False),
])

#: A claim of a document by a run, or the end of one.
CLAIMS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("run_id", T.LongType(), False),
    T.StructField("claimed_at", T.TimestampNTZType(), False),
    T.StructField("expires_at", T.TimestampNTZType(), False),
    T.StructField("released", T.BooleanType(), False),
])

REPLIES = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("raw", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("run_id", T.LongType(), False),
])

COUNTS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("n", T.LongType(), False),
])

#: What a stored row must satisfy, by table.
CHECKS = {
    "documents": "length(filename) <= 255 AND length(file_path) <= 512 AND status IN ('pending', 'processing', 'completed', 'failed')",
    "issues": "page_number >= 1 AND severity IN ('low', 'medium', 'high') AND length(description) > 0 AND (location_hint IS NULL OR length(location_hint) BETWEEN 1 AND 255) AND issue_type IN ("
    + ", ".join(f"'{t}'" for t in ISSUE_TYPES)
    + ")",
}


TABLES = {"documents": DOCUMENTS, "issues": ISSUES, "pages": PAGES}


def create_table_sql(name: str, schema: T.StructType) -> str:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"


#: Versions of the stored tables: number, name, and the tables that each adds.
VERSIONS = ((1, "documents, findings, pages", TABLES), (2, "claims, replies, counts", {"claims": CLAIMS, "replies": REPLIES, "counts": COUNTS}))


def migrate(spark: SparkSession, database: str, to: int = VERSIONS[-1][0]) -> list[tuple[int, bool]]:
    """Bring ``database`` of the catalogue to version ``to``; the steps done, as (version, up).

    Steps are recorded in its table ``schema_version`` when they are done, and done once. A step down keeps its tables under another name, referring ones first, and the
    same step up finds them again; so no data is lost. A step that died half-way is done again, as each statement looks at what there is.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.schema_version (step BIGINT, version INT, name STRING, up BOOLEAN) USING parquet")
    record = spark.table(f"{database}.schema_version").orderBy("step").collect()  # a row for each step ever done
    applied = {version for version in {r.version for r in record} if [r.up for r in record if r.version == version][-1]}
    steps = [(v, True) for v, _, _ in VERSIONS if v <= to and v not in applied] + [(v, False) for v, _, _ in reversed(VERSIONS) if v > to and v in applied]
    has = lambda table: spark.catalog.tableExists(f"{database}.{table}")
    for n, (version, up) in enumerate(steps, len(record)):
        _, name, tables = next(v for v in VERSIONS if v[0] == version)
        for table, schema in tables.items() if up else reversed(tables.items()):
            if up and not has(table):
                spark.sql(f"ALTER TABLE {database}.{table}_kept RENAME TO {database}.{table}" if has(f"{table}_kept") else create_table_sql(f"{database}.{table}", schema))
            elif not up and has(table):
                spark.sql(f"ALTER TABLE {database}.{table} RENAME TO {database}.{table}_kept")
        spark.sql(f"INSERT INTO {database}.schema_version VALUES ({n}, {version}, '{name}', {str(up).lower()})")
    return steps


def checked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as they are; a row that breaks its table's checks, or lacks a value that it must have, fails the write."""
    needed = " AND ".join(f"{f.name} IS NOT NULL" for f in TABLES[name] if not f.nullable)
    good = F.expr(f"{needed} AND coalesce({CHECKS[name]}, true)")
    what = F.concat(F.lit(f"a row of {name} breaks its checks: "), F.coalesce(F.col("id").cast("string"), F.lit("no id")))
    return rows.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(what)))


def looked_up(names: dict[str, str], col: Column, default: Column | None = None) -> Column:
    """``names[col]``, else ``default`` or the value itself: a map literal, not a join."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, col), col if default is None else default)


def type_label(col: Column) -> Column:
    return looked_up(ISSUE_TYPES, col)


def status_label(col: Column) -> Column:
    return looked_up(STATUSES, col, F.lit(STATUSES["pending"]))


def severity_colour(col: Column) -> Column:
    return looked_up(SEVERITY_COLOURS, col, F.lit(SEVERITY_COLOURS["low"]))


def severity_rank(col: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(col == s, F.lit(i)).otherwise(rank)
    return rank
