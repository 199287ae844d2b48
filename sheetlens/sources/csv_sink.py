"""A sink of exactly named files: one CSV file for each document, in tasks, visible only when all are written.

A document's file is ``<shard>/<document id>/<name>.csv`` below the folder; the shard is the start of the id's MD5, so no folder gets too many entries and a path
follows from the id. Rows are dealt by shard, so a shard is written by one task, beside the folder's other content and hidden. The commit moves whole shards in, as many as there are, whatever the
number of files; a shard that was there before goes. An abort, or a task that ran twice, leaves nothing visible. The file system must be one that moves folders.

A file of a few hundred bytes in a folder of its own takes two blocks of a disk, so millions of them take far more than their text. A packed export therefore writes the same
files, with the same names, as members of archives ``<shard>/<number>.tar.gz`` of about ``ARCHIVE_BYTES`` of text; ``packed_csv_files`` reads them, as does any tar.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions import text as X
from ..operators.listing import csv_row, csv_text

FORMAT = "named_csv_files"
#: Tasks that write at most, by the first two digits of the MD5.
SHARDS = 256
SHAPE = "shard string, document_id string, name string, csv string"
#: Bytes of files after which an archive is closed and the next one begun, and files that a reader gives on at a time.
ARCHIVE_BYTES, READ_ROWS = 16_000_000, 2_000


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: its folder, and the shards in it."""

    folder: str
    shards: list[str]


class Archives:
    """The archives of one task, one open at a time; rows should come shard by shard."""

    def __init__(self, where, own: str):
        self.where, self.own, self.shard, self.made, self.held = where, own, None, 0, 0

    def add(self, shard: str, name: str, content: bytes) -> None:
        if self.shard is not None and (shard != self.shard or self.held >= ARCHIVE_BYTES):
            self.close()
        if self.shard is None:
            self.shard, self.held, self.buffer = shard, 0, io.BytesIO()
            self.tar = tarfile.open(fileobj=self.buffer, mode="w:gz", compresslevel=4)
        member = tarfile.TarInfo(name)
        member.size = len(content)
        self.tar.addfile(member, io.BytesIO(content))
        self.tar.members.clear()  # they are kept for readers only
        self.held += len(content)

    def close(self) -> None:
        if self.shard is None:
            return
        self.tar.close()
        self.where.create_dir(f"{self.own}/{self.shard}")
        with self.where.open_output_stream(f"{self.own}/{self.shard}/{self.made:05d}.tar.gz", compression=None) as out:
            out.write(self.buffer.getvalue())
        self.made, self.shard = self.made + 1, None


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, packed: bool = False):
        self.folder, self.stage, self.packed = folder.rstrip("/"), f"_stage-{uuid.uuid4().hex}", packed

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.folder)
        own = f"{root}/{self.stage}/{uuid.uuid4().hex}"
        shards, archives = set(), Archives(where, own)
        for shard, document_id, name, text in iterator:
            shards.add(shard)
            if self.packed:
                archives.add(shard, f"{os.path.basename(document_id)}/{name}", text.encode())
                continue
            folder = f"{own}/{shard}/{os.path.basename(document_id)}"
            where.create_dir(folder)
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write(text.encode())
        archives.close()
        return Written(own, sorted(shards))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.folder)
        for m in filter(None, messages):
            for shard in m.shards:
                target = f"{root}/{shard}"
                if where.get_file_info(target).type != fs.FileType.NotFound:
                    where.delete_dir(target)
                where.move(f"{m.folder}/{shard}", target)
        self._clear(where, root)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        self._clear(*fs.FileSystem.from_uri(self.folder))

    def _clear(self, where, root: str) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/{self.stage}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SHAPE

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("packed", "false") == "true")


def write_csv_files(issues: DataFrame, documents: DataFrame, folder: str, packed: bool = False) -> None:
    """The findings of each of ``documents(id, filename)`` that has some, as a CSV file of the name that a reviewer gets.

    Findings and names meet in one grouping, dealt by shard, so a finding is moved once and its line is made where it is written.
    """
    spark = issues.sparkSession
    dealt_by = lambda key: [F.substring(F.md5(key), 1, 2).alias("shard"), key.alias("document_id")]
    name = X.export_name(X.base_name(F.col("filename")))
    names = documents.select(*dealt_by(F.col("id").cast("string")), F.lit(None).cast(issues.select(csv_row().alias("row")).schema["row"].dataType).alias("row"), name.alias("name"))
    rows = issues.select(*dealt_by(F.col("document_id").cast("string")), csv_row().alias("row"), F.lit(None).cast("string").alias("name"))
    both = rows.unionByName(names).repartition(min(SHARDS, dealing(spark)), "shard")
    files = both.groupBy("shard", "document_id").agg(F.collect_list("row").alias("rows"), F.max("name").alias("name")).where("name IS NOT NULL AND size(rows) > 0")
    spark.dataSource.register(NamedFiles)
    files.select("shard", "document_id", "name", csv_text("rows").alias("csv")).sortWithinPartitions("shard", "document_id").write.format(FORMAT).mode("append").option("path", folder).option("packed", str(packed).lower()).save()


def packed_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, csv) of each file of a packed export: its path below ``folder`` and its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                shard, found = path.split("/")[-2], []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
                    for member in tar:
                        found.append((f"{shard}/{member.name}", tar.extractfile(member).read().decode()))
                        tar.members.clear()
                        if len(found) == READ_ROWS:
                            yield pd.DataFrame(found, columns=["file", "csv"])
                            found = []
                yield pd.DataFrame(found, columns=["file", "csv"])

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.gz").load(folder)
    return archives.select("path", "content").mapInPandas(run, "file string, csv string")


def dealing(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
