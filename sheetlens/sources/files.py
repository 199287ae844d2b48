"""PDF files as a source: metadata first, content only where pages are made."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import MAX_UPLOAD_BYTES


def accepted(files: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files of a listing, or of a stream of files, that may be uploaded, with their ``filename``."""
    return files.withColumn("filename", X.base_name(F.col("path"))).where(X.accepted_by_client(F.col("filename"), F.col("length"), limit))


def pdf_files(spark: SparkSession, folder: str, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Accepted PDF files below ``folder`` (any URI scheme that Hadoop reads): path, filename, length, content.

    Size and name are read from the listing; ``content`` is not loaded unless selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    return accepted(files, limit)


def file_contents(spark: SparkSession, folder: str, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(file_path, content) of all accepted files below ``folder``; documents meet them by a join, so no list of paths is made.

    A file that goes after it was listed is left out, so that only its document fails.
    """
    return pdf_files(spark, folder, limit).select(F.col("path").alias("file_path"), "content")


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or on a single machine below /tmp."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/review-{uuid.uuid4().hex}"


def pending_documents(files: DataFrame, uploaded_at: str) -> DataFrame:
    """The document rows of new files, in state pending; ids follow from path and size."""
    doc_id = X.row_id(F.col("path"), F.col("length"))
    return files.select(
        doc_id.alias("id"), "filename", F.col("path").alias("file_path"), F.lit(None).cast("int").alias("page_count"), F.lit("pending").alias("status"),
        F.lit(uploaded_at).cast("timestamp_ntz").alias("uploaded_at"), F.lit(None).cast("timestamp_ntz").alias("analyzed_at"))


def delete_file(spark: SparkSession, path: str) -> bool:
    """Remove a stored file through Hadoop's file system; whether there was one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False))


def move_or_delete(source: str, target: str | None) -> tuple[bool, str | None]:
    """In a task: move a file, or delete it if there is no target; whether there was one, and what went wrong. Both can be done again."""
    from pyarrow import fs

    try:
        where, path = fs.FileSystem.from_uri(source)
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return False, None
        if target is None:
            where.delete_file(path)
        else:
            where.move(path, fs.FileSystem.from_uri(target)[1])
        return True, None
    except Exception as e:  # whatever a file system raises: the row says it, the other files go on
        return False, f"{type(e).__name__}: {e}"


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the files in a folder, by Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [str(f.getPath()) for f in found if str(f.getPath()).endswith(suffix)]


def delete_tree(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))
