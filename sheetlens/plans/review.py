"""The whole review: files, pages, text, replies, findings, states."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pages as P
from ..operators.purge import moved, without_keys
from ..operators.replies import allow_repeated_keys, findings, parsed, second_check
from ..operators.store import ReviewStore, latest
from ..schema import ISSUES, Settings
from ..sources.files import pdf_files, pending_documents


def ingest(spark: SparkSession, store: ReviewStore, folder: str, now: str, settings: Settings = Settings()) -> None:
    """New files become pending documents."""
    add(store, pending_documents(pdf_files(spark, folder, settings.max_upload_bytes), now))


def add(store: ReviewStore, rows: DataFrame) -> None:
    """Documents as they are at first."""
    store.append_states(rows.withColumns({"seq": F.lit(0).cast("long"), "deleted": F.lit(False)}))


def analyse(
    spark: SparkSession, store: ReviewStore, work: str, run_id: int, now: str, contents: DataFrame, reader: P.Reader, inspector: P.Inspector,
    splitter: P.Splitter = P.form_feed_pages, ids: DataFrame | None = None, settings: Settings = Settings(), until: str | None = None,
) -> DataFrame:
    """Run the documents of ``ids`` (all, if there are none given) that no other run holds; returns all documents after the run.

    ``contents(file_path, content)`` are their files, as of ``file_contents``. The run claims its documents until ``until`` (by default an hour after ``now``): a run
    that dies leaves claims that lapse, and runs that overlap share the documents. What it finds is written only for documents that it still holds.

    States, each a row of the log: processing; then failed for a file that cannot be split, else processing with the number of pages; then
    completed or failed. A document with a page that failed is failed; findings of its pages before that one stay. Pages are written below ``work`` before they are
    used, and the model's replies to the store, which asks it only what it has not answered before; so outside calls are not repeated.
    """
    allow_repeated_keys(spark)
    docs = store.documents()
    if ids is not None:
        docs = docs.join(ids.select("id").distinct(), "id", "left_semi")
    state = lambda rows, step: rows.withColumns({"seq": F.lit(run_id * 10 + step).cast("long"), "deleted": F.lit(False)})
    until = until or str(datetime.fromisoformat(now) + timedelta(hours=1))

    def kept(rows: DataFrame, name: str, mode: str = "error") -> DataFrame:
        rows.write.mode(mode).option("compression", "zstd").parquet(f"{work}/run={run_id}/{name}")
        return spark.read.parquet(f"{work}/run={run_id}/{name}")

    docs = kept(docs.join(store.claim(docs, run_id, now, until), "id", "left_semi"), "documents")
    store.append_states(state(docs.withColumn("status", F.lit("processing")), 1))

    named = docs.select(F.col("id").alias("document_id"), "file_path")
    split = kept(P.split_pages(contents.join(named, "file_path").select("document_id", "content"), splitter, settings.max_pages), "split")
    gone = named.join(split.select("document_id").distinct(), "document_id", "left_anti").withColumn("content", F.lit(None).cast("binary"))
    split = kept(P.split_pages(gone, splitter, settings.max_pages), "split", "append")
    counted = split.groupBy(F.col("document_id").alias("id")).agg(F.count("page_number").cast("int").alias("pages"), F.max("error").alias("error"))
    failed = F.col("error").isNotNull()
    store.append_states(state(docs.join(counted, "id").withColumns({"status": F.when(failed, "failed").otherwise("processing"), "page_count": F.when(failed, F.col("page_count")).otherwise(F.col("pages"))}).drop("pages"), 2))

    # pages are dealt once by their place, in buckets; from here on only places and replies move, and meet the buckets where images and texts are needed
    pages = split.where("page_number IS NOT NULL").select("document_id", "page_number", "total_pages", "image")
    asked = P.with_prompt(P.read_text(pages, reader)).withColumn("key", P.asked_key(F.col("prompt"), F.col("image")))
    place, parts, name = ["document_id", "page_number"], int(spark.conf.get("spark.sql.shuffle.partitions")), f"pages_{uuid.uuid4().hex}"
    dealt = asked.drop("prompt").repartition(parts, *place).write.format("parquet").bucketBy(parts, *place)
    dealt.option("compression", "zstd").option("path", f"{work}/run={run_id}/pages").saveAsTable(name)
    read = spark.table(name)
    answers = store.ask(P.with_prompt(read), run_id, lambda questions: P.inspect(questions, inspector, settings.max_reply_tokens))
    replies = kept(read.select("key", "document_id", "page_number").join(answers, "key").drop("key"), "replies")

    at = F.struct("page_number", F.coalesce("error", F.when(F.col("state") == "failed", F.lit("TypeError: the findings are no list"))).alias("error"))
    ends = parsed(replies).groupBy("document_id").agg(F.min(F.when(F.col("error").isNotNull() | (F.col("state") == "failed"), at)).alias("failed"))
    ends = kept(ends.select("document_id", F.col("failed.page_number").alias("failed_at"), "failed.error"), "ends")
    before = replies.join(ends.drop("error"), "document_id").where("failed_at IS NULL OR page_number < failed_at").select("document_id", "page_number", "raw")
    issues = second_check(findings(before)).select(
        X.row_id(F.col("document_id"), F.lit(run_id), F.col("page_number"), F.col("pos")).alias("id"), "document_id", "page_number", "issue_type", "severity", "description",
        F.substring("location_hint", 1, 255).alias("location_hint"), F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(run_id).alias("run_id"))
    held = store.held(run_id, now)
    issues = kept(issues.join(held.select(F.col("id").alias("document_id")), "document_id", "left_semi"), "issues")
    texts = read.select("document_id", "page_number", P.stored_text().alias("raw_ocr_text"))
    columns = [f.name for f in ISSUES] + ["run_id"]
    store.append_issues(issues.join(texts, place).select(*columns), counted=issues)
    good = F.col("failed_at").isNull()
    ended = docs.join(counted.where(~failed).select("id", "pages"), "id").join(held, "id", "left_semi").join(ends.withColumnRenamed("document_id", "id"), "id", "left").select(
        "id", "filename", "file_path", F.col("pages").alias("page_count"), F.when(good, "completed").otherwise("failed").alias("status"), "uploaded_at",
        F.when(good, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("analyzed_at")).alias("analyzed_at"), "error")
    store.append_states(state(ended, 3))
    store.release(run_id)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return store.documents()


def delete(store: ReviewStore, ids: DataFrame, seq: int) -> None:
    """Tombstones: the documents and their findings are no longer seen."""
    store.delete(ids, seq)


def purge(store: ReviewStore) -> DataFrame:
    """Deleted documents go for good: their files, then findings, claims and log rows; (source, found, error) of the files.

    The tombstones go last, so a purge that died can be done again. A file that is not there is no error; one that cannot be deleted keeps its
    document's log rows, so that the next purge tries again.
    """
    gone = latest(store.log(), "id", "seq").where("deleted").select("id", F.col("file_path").alias("source"), F.lit(None).cast("string").alias("target"))
    gone.write.mode("overwrite").parquet(f"{store.folder}/_gone")  # the log, which it comes from, is rewritten below
    gone = store.spark.read.parquet(f"{store.folder}/_gone")
    moved(gone).write.mode("overwrite").parquet(f"{store.folder}/_deleted")
    deleted = store.spark.read.parquet(f"{store.folder}/_deleted")
    done = gone.join(deleted.where("error IS NULL"), "source", "left_semi").select("id")
    for path, key in ((store.issues_path, "document_id"), (store.counts_path, "document_id"), (store.claims_path, "id"), (store.log_path, "id")):
        without_keys(store.spark, path, key, done)
    return deleted
