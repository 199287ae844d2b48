"""Physical deletion: data files without the deleted keys, and stored files removed by tasks.

Tombstones hide a document; a purge removes it. Only the data files that hold a deleted key are touched: their names come from
the scan's own metadata, their other rows are written anew beside the table, then the new files move in and the old ones go. A plan
is written before anything is moved, and each of its steps can be done again, so a purge that died is finished by the next one.
Readers that look while files are moved may miss rows of the touched files for that moment, but never see rows twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete_tree, file_exists, list_files, move_or_delete

PLAN = "_swap"


def without_keys(spark: SparkSession, path: str, key: str, gone: DataFrame) -> int:
    """Remove the rows whose ``key`` is in ``gone(key)`` from the Parquet table at ``path``; the number of data files that were touched.

    The names of the touched files are collected, as Spark's driver has the names of all of them anyway.
    """
    finish(spark, path)
    if not file_exists(spark, path):
        return 0
    rows = spark.read.parquet(path)
    keys = gone.select(F.col(gone.columns[0]).alias(key)).distinct()
    old = [r[0] for r in rows.select(key, F.col("_metadata.file_path").alias("_file")).join(keys, key, "left_semi").select("_file").distinct().collect()]
    if not old:
        return 0
    stage = f"{path}/_new-{uuid.uuid4().hex}"
    spark.read.schema(rows.schema).parquet(*old).join(keys, key, "left_anti").select(*rows.columns).write.parquet(stage)
    steps = [(None, f, None) for f in old] + [(stage, f, f"{path}/{f.rsplit('/', 1)[1]}") for f in list_files(spark, stage, ".parquet")]
    spark.createDataFrame(steps, "stage string, source string, target string").write.mode("overwrite").parquet(f"{path}/{PLAN}")
    finish(spark, path)
    return len(old)


def finish(spark: SparkSession, path: str) -> None:
    """Do what a plan says, if there is one: old files go, then the new ones move in."""
    plan = f"{path}/{PLAN}"
    if not file_exists(spark, f"{plan}/_SUCCESS"):
        return
    steps = spark.read.parquet(plan).cache()
    for part in (steps.where("target IS NULL"), steps.where("target IS NOT NULL")):
        failed = moved(part).where("error IS NOT NULL").limit(3).collect()
        if failed:
            raise OSError(f"files of {path} could not be moved: {[(r.source, r.error) for r in failed]}")
    for (stage,) in steps.where("stage IS NOT NULL").select("stage").distinct().collect():
        delete_tree(spark, stage)
    steps.unpersist()
    delete_tree(spark, plan)
    spark.catalog.refreshByPath(path)


def moved(steps: DataFrame) -> DataFrame:
    """(source, found, error) of each of ``steps(source, target)``, done by tasks: a file without target is deleted; one that is not there needs nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [move_or_delete(s, None if pd.isna(t) else t) for s, t in zip(b["source"], b["target"], strict=True)]
            yield pd.DataFrame({"source": b["source"], "found": [f for f, _ in done], "error": [e for _, e in done]})

    return steps.select("source", "target").mapInPandas(run, "source string, found boolean, error string")
