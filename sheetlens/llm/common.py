"""Helpers that the corpus operators share: shared-folder tables, bounded samples, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


#: Folders of our own, by application, where ``spark.checkpoint.dir`` is unset (single-machine use, as in tests).
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or on a single machine one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return path.rstrip("/")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing will read again: what was made of them has been saved itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % F.lit(n), F.lit(-1))


def hash_unit(col: Column | str, seed: int) -> Column:
    """A seeded hash of ``col`` as a double in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, key: list[str], bound: int, seed: int = 7, by: str | None = None) -> DataFrame:
    """About ``bound`` rows (per value of ``by``), chosen by a seeded hash of the columns ``key``.

    The rate is ``bound / rows counted``, so the expected size never exceeds ``bound`` whatever
    the size of the table; all rows are taken where there are fewer. ``by`` is not null. Rows that agree in ``key`` are taken
    together, so callers that collect name enough columns and drop equal rows.
    """
    unit = hash_unit(F.struct(*key), seed)
    if by is None:
        n = rows.count()
        return rows if n <= bound else rows.where(unit < bound / n)
    counts = rows.groupBy(by).count().collect()  # one row a value: a caller collects ``bound`` rows of each anyway
    if not counts:
        return rows
    n = F.try_element_at(F.create_map(*(F.lit(x) for value, n in counts for x in (value, float(n)))), F.col(by))
    return rows.where(unit * n < F.lit(float(bound)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, chars: int = 8_000_000) -> Iterator[dict[str, list]]:
    """Arrow batches as column lists of at most ``rows`` rows, and about ``chars`` bytes unless one row is larger."""
    for batch in batches:
        step = max(1, min(rows, int(chars * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pydict()


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over column lists; ``make`` runs once in each task and returns the function of a slice."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for cols in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(work(cols), schema=arrow)

    return df.mapInArrow(run, schema)


def fold_tasks(df: DataFrame, make: Callable[[], tuple[Callable[[dict[str, list]], None], Callable[[], dict[str, list]]]], schema: str, rows: int = 2000) -> DataFrame:
    """Each task folds its rows into one small table: ``make`` gives (take a slice, result)."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, result = make()
        for cols in slices(batches, rows):
            take(cols)
        yield pa.RecordBatch.from_pydict(result(), schema=arrow)

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int, label_id: str = "doc_id", doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """(text, label) of about ``bound`` distinct labelled texts, written to the shared folder; a text labelled both ways has label 1.

    ``usable`` is a condition on the labels' rows. The ids of the sample are broadcast, which
    ``bound`` keeps small; so texts are not shuffled to meet their labels. Ids that repeat bring more rows, so the
    distinct texts are bounded once more.
    """
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    ids = bounded_sample(known, ["_id"], bound, seed)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = saved(rows.join(F.broadcast(ids), "_id").groupBy("text").agg(F.max("label").alias("label")), "sample")
    return bounded_sample(texts, ["text"], bound, seed)


def kept_rows(df: DataFrame, text: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], least: float | None = None, below: float | None = None, rows: int = 1000) -> DataFrame:
    """Rows of ``df``, all columns unchanged, whose ``score`` by ``make`` is at least ``least`` or below ``below``.

    The rows pass through the scoring tasks themselves, so no join brings scores and rows together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            step = max(1, min(rows, int(8_000_000 * batch.num_rows / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [None if t is None else str(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                scores = work({"doc_id": [None] * len(texts), "text": texts})["score"]
                yield part.filter(pa.array([s >= least if below is None else s < below for s in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)
