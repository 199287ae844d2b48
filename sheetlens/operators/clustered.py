"""A clustered copy of the review tables, for lists and lookups that move no rows.

Documents and findings are written in buckets by the document's id, sorted by it, with a Bloom filter on it in each file. A list
with counts, and everything else that brings documents and their findings together, then needs no shuffle; a lookup
reads one bucket of each table, and of that only row groups whose filter knows the id. Rows are dealt by the same hash that names the buckets, so a bucket is one file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import with_issue_count

BUCKETS = 16


def write_clustered(rows: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Table ``name`` of the catalogue, in ``buckets`` by ``key``; ``buckets`` should give files of some hundred MB."""
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").saveAsTable(name)


@dataclass(frozen=True)
class ClusteredStore:
    """Two tables of the catalogue: ``{name}_documents`` by id and ``{name}_issues`` by document_id."""

    spark: SparkSession
    name: str

    @classmethod
    def of(cls, documents: DataFrame, issues: DataFrame, name: str, buckets: int = BUCKETS) -> ClusteredStore:
        write_clustered(documents, f"{name}_documents", "id", buckets)
        write_clustered(issues, f"{name}_issues", "document_id", buckets)
        return cls(documents.sparkSession, name)

    def documents(self) -> DataFrame:
        return self.spark.table(f"{self.name}_documents")

    def issues(self) -> DataFrame:
        return self.spark.table(f"{self.name}_issues")

    def listing(self) -> DataFrame:
        """Documents with the number of their findings, bucket by bucket."""
        return with_issue_count(self.documents(), self.issues())

    def detail(self, document_id) -> DataFrame:
        """One document with the number of its findings: both tables give one bucket."""
        return with_issue_count(self.documents().where(F.col("id") == document_id), self.issues().where(F.col("document_id") == document_id))

    def drop(self) -> None:
        for table in ("documents", "issues"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
