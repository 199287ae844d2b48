"""An append-only log of document states and findings, and the views that stand for updates.

Parquet tables take no UPDATE or DELETE. Each change is a row; the newest row of a document is its
state, a tombstone removes it with its findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CLAIMS, COUNTS, REPLIES, checked
from ..sources.files import file_exists
from .listing import checked_summary, guarded

#: From which state an action may start.
STARTS = {"run": ("pending",), "retry": ("failed",), "rerun": ("completed",)}


class ReviewStore:
    """State log, findings and their counts, claims and the model's replies under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log_path, self.issues_path, self.claims_path, self.replies_path, self.counts_path = (f"{folder}/{x}" for x in ("document_log", "issues", "claims", "replies", "counts"))

    def append_states(self, rows: DataFrame) -> None:
        """``rows``: the document's columns, and ``seq`` that grows with each change, ``deleted``, and ``error`` if there is one. Checked when written."""
        rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
        checked(rows, "documents").write.mode("append").parquet(self.log_path)

    def append_issues(self, rows: DataFrame, counted: DataFrame | None = None) -> None:
        """Findings of a run; those of earlier runs stay, and their counts are added to the counts that are kept. Checked when written.

        ``counted``, which should come from a table, holds the document, severity and type of the same findings; by default ``rows``, which are then computed twice.
        """
        checked(rows, "issues").write.mode("append").option("compression", "zstd").parquet(self.issues_path)
        self.append_counts(checked_summary(rows if counted is None else counted))

    def append_counts(self, counts: DataFrame) -> None:
        """Changes of counts, negative for what is deleted."""
        counts.select("document_id", "kind", "value", "n").write.mode("append").parquet(self.counts_path)

    def counts(self, documents: DataFrame | None = None) -> DataFrame:
        """(document_id, kind, value, n): totals and histograms of the findings that are seen, as ``summary`` gives them, without reading them; only of ``documents(id)``, if they are given."""
        changes = self.appended(self.counts_path, COUNTS)
        changes = changes if documents is None else guarded(changes, documents)
        return changes.groupBy("document_id", "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def delete(self, ids: DataFrame, seq: int) -> None:
        """Tombstones for the documents of ``ids(id)``, and their counts taken back."""
        states = self.documents().join(ids, "id", "left_semi").withColumns({"seq": F.lit(seq).cast("long"), "deleted": F.lit(True)})
        states.write.mode("overwrite").parquet(f"{self.folder}/_deleting")  # the log, which they come from, is written to below
        states = self.spark.read.parquet(f"{self.folder}/_deleting")
        self.counts(states).withColumn("n", -F.col("n")).write.mode("overwrite").parquet(f"{self.folder}/_taken")
        self.append_states(states)
        self.append_counts(self.spark.read.schema(COUNTS).parquet(f"{self.folder}/_taken"))

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.log_path)

    def documents(self) -> DataFrame:
        return latest(self.log(), "id", "seq").where("NOT deleted").drop("deleted", "seq", "error")

    def failures(self) -> DataFrame:
        """(id, filename, error): what made the documents fail that are failed now."""
        return latest(self.log(), "id", "seq").where("NOT deleted AND status = 'failed'").select("id", "filename", "error")

    def issues(self) -> DataFrame:
        gone = latest(self.log(), "id", "seq").where("deleted").select(F.col("id").alias("document_id"))
        return self.spark.read.parquet(self.issues_path).join(gone, "document_id", "left_anti")

    def appended(self, path: str, schema: StructType) -> DataFrame:
        """A table that may not have been written yet."""
        return self.spark.read.schema(schema).parquet(path) if file_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def claims(self) -> DataFrame:
        return self.appended(self.claims_path, CLAIMS)

    def claim(self, docs: DataFrame, run_id: int, now: str, until: str) -> DataFrame:
        """(id) of the ``docs(id)`` that this run may work on now: free ones are claimed until ``until``, and of runs that claim at once one wins each document.

        A document is being processed as long as a live claim is on it; when its run has died, the claim lapses and it is free again. A run's own claims are free to it.
        """
        free = docs.select("id").join(holders(self.claims(), F.lit(now)).select("id", "run_id"), "id", "left").where(F.coalesce(F.col("run_id") == run_id, F.lit(True))).select("id")
        times = {"run_id": F.lit(run_id).cast("long"), "claimed_at": F.lit(now).cast("timestamp_ntz"), "expires_at": F.lit(until).cast("timestamp_ntz"), "released": F.lit(False)}
        free.withColumns(times).write.mode("append").parquet(self.claims_path)
        return self.held(run_id, now)

    def held(self, run_id: int, now: str) -> DataFrame:
        """(id) of the documents whose live claim is this run's."""
        return holders(self.claims(), F.lit(now)).where(F.col("run_id") == run_id).select("id")

    def release(self, run_id: int) -> None:
        """The run is over: its claims end."""
        mine = self.claims().where((F.col("run_id") == run_id) & ~F.col("released"))
        mine.withColumn("released", F.lit(True)).write.mode("append").parquet(self.claims_path)

    def replies(self) -> DataFrame:
        """(key, run_id, raw, error): what the model was asked, by what it was told."""
        return self.appended(self.replies_path, REPLIES)

    def ask(self, questions: DataFrame, run_id: int, answers: Callable[[DataFrame], DataFrame], place: tuple[str, ...] = ("document_id", "page_number")) -> DataFrame:
        """(key, raw, error) of the distinct ``questions(key, place.., prompt, image)``: ``answers`` is asked for those that no earlier run has an answer to.

        Every answer is kept, errors with their text; an error does not count as an answer, so it is asked again. ``place`` names each question: the first of
        equal ones is found by its place alone, then only what is asked is moved.
        """
        known = self.replies().where("error IS NULL").select("key").distinct()
        new = questions.groupBy("key").agg(F.min(F.struct(*place)).alias("_first")).join(known, "key", "left_anti").select("_first.*")
        new = questions.join(new, list(place), "left_semi")
        answers(new).withColumn("run_id", F.lit(run_id).cast("long")).write.mode("append").parquet(self.replies_path)
        return best_replies(self.replies())


def holders(claims: DataFrame, now: Column) -> DataFrame:
    """(id, run_id, claimed_at, expires_at): which run holds each document, one row for each that is held.

    A run's claims of a document are one, from the first to the latest end (a run may claim again to hold on). It is live from then until it is
    released or has expired; of live ones the earliest holds, of equally early ones the smaller run's. Both steps are partial aggregates.
    """
    now = now.cast("timestamp_ntz")
    seen = claims.where(F.col("claimed_at") <= now)
    one = seen.groupBy("id", "run_id").agg(F.min("claimed_at").alias("claimed_at"), F.max("expires_at").alias("expires_at"), F.bool_or("released").alias("released"))
    live = one.where((F.col("expires_at") > now) & ~F.col("released"))
    return live.groupBy("id").agg(F.min(F.struct("claimed_at", "run_id", "expires_at")).alias("c")).select("id", "c.run_id", "c.claimed_at", "c.expires_at")


def best_replies(replies: DataFrame) -> DataFrame:
    """(key, raw, error): of each question the first answer; the latest error, if there is none."""
    answered = F.struct(F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNull(), F.col("run_id")).otherwise(-F.col("run_id")).alias("turn"), "raw", "error")
    return replies.groupBy("key").agg(F.min(answered).alias("r")).select("key", "r.raw", "r.error")


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest row of each key, of equally new ones the largest by content; a maximum that is aggregated before the shuffle."""
    newest = log.groupBy(key).agg(F.max(F.struct(seq, *(c for c in log.columns if c not in (key, seq)))).alias("_row"))
    return newest.select(key, "_row.*")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` replace rows of equal key and add the others."""
    return rows.join(changes, key, "left_anti").unionByName(changes)


def in_places(log: DataFrame, key: str, place: str, deleted: str) -> DataFrame:
    """The current rows of a log of upserts and removals, each with the ``place`` where it first came in since it was last removed.

    A change keeps a row's place and its newest content; a new row's place is its own change's, which is later than all before, so sorted by place descending it stands first
    and no other row moves. ``place`` orders the log and names each change.
    """
    gone = log.where(deleted).groupBy(key).agg(F.max(place).alias("_gone"))
    live = log.where(~F.col(deleted)).join(gone, key, "left").where(F.col("_gone").isNull() | (F.col(place) > F.col("_gone"))).drop("_gone")
    content = [c for c in live.columns if c not in (key, place, deleted)]
    rows = live.groupBy(key).agg(F.min(place).alias("_first"), F.max(F.struct(place, *content)).alias("_row"))
    return rows.select(key, F.col("_first").alias(place), *(F.col(f"_row.{c}").alias(c) for c in content))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def may_start(status: str = "status") -> Column:
    """A document that is being processed may not be started again."""
    return F.col(status) != "processing"


def action(status: str = "status"):
    """What the reviewer can do with a document: run, retry or rerun."""
    out = F.lit(None).cast("string")
    for name, states in STARTS.items():
        out = F.when(F.col(status).isin(*states), name).otherwise(out)
    return out
