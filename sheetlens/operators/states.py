"""The states of a document as a checked machine: which changes are legal, also in histories too long for one task.

A change is a table: for each state that a document may be in, the state that it leads to. A legal change leads to its own state, an illegal one
leaves the document as it is. Tables compose, and composition is associative, so a history can be folded in parts: rows are dealt by ranges of (document, order), chunks of them
become one table each, chunks compose to what a task holds of a document, and these (one for each task at most) to the document. On the way down that gives the state
before each chunk, from where its rows are gone through once more; every row comes out with the state before and after it and whether it was legal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a document that one table is made of at a time.
CHUNK = 512
#: No document yet, then the stored states.
STATES = ("none", "pending", "processing", "completed", "failed")
#: For each state the states that it may be left for. Processing is written again when the pages are counted.
LEGAL = {"none": ("pending",), "pending": ("processing",), "processing": ("processing", "completed", "failed"), "completed": ("processing",), "failed": ("processing",)}


def state_number(status: Column) -> Column:
    """A state's place in ``STATES``; a state that is not known is -1, to which no change is legal."""
    return F.array_position(F.array(*map(F.lit, STATES)), status).cast("int") - 1


def allowed(before: Column, to: Column) -> Column:
    """Whether a change from ``before`` to ``to``, as numbers, is legal."""
    legal = F.array(*(F.array(*(F.lit(b in LEGAL[a]) for b in STATES)) for a in STATES))
    return F.when(to < 0, False).otherwise(F.element_at(F.element_at(legal, before + 1), to + 1))


def after(before: Column, to: Column) -> Column:
    """The state after a change."""
    return F.when(allowed(before, to), to).otherwise(before)


def listed(rows: DataFrame, group: list[str], *member: str) -> DataFrame:
    """(group.., list): the members of each group in order."""
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*member))).alias("list"))


def composed(tables: DataFrame, group: list[str], member: str) -> DataFrame:
    """(group.., table) of the ``tables(group.., member, table)`` of each group, one after the other."""
    same = F.array(*(F.lit(n) for n in range(len(STATES))))
    whole = F.aggregate("list", same, lambda before, m: F.transform(before, lambda s: F.element_at(m["table"], s + 1)))
    return listed(tables, group, member, "table").select(*group, whole.alias("table"))


def starts(tables: DataFrame, group: list[str], member: str, first: DataFrame | None) -> DataFrame:
    """(group.., member, start): the state before each member, from the group's own ``start`` in ``first`` (no document, if there is none)."""
    groups = listed(tables, group, member, "table")
    groups = groups.withColumn("start", F.lit(0)) if first is None else groups.join(first, group)
    begin = F.struct(F.col("start").alias("now"), F.array().cast("array<int>").alias("seen"))
    walk = F.aggregate("list", begin, lambda acc, m: F.struct(F.element_at(m["table"], acc["now"] + 1).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")))
    pairs = F.arrays_zip(F.col(f"list.{member}").alias(member), walk["seen"].alias("start"))
    return groups.select(*group, F.explode(pairs).alias("p")).select(*group, f"p.{member}", "p.start")


def checked_log(log: DataFrame, key: str, order: list[str], status: str, work: str, chunk: int = CHUNK) -> DataFrame:
    """``log(key, order.., status)`` with ``before``, ``after`` and ``legal`` for each row. Tables between the steps are written below ``work``.

    Rows of equal ``order`` stand by their state. Other columns are not kept; ``order`` should name each row.
    """
    spark = log.sparkSession
    base = f"{work}/states-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    rows = log.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), F.coalesce(state_number(F.col(status)), F.lit(-1)).alias("_to"), F.col(status).alias("_status"))
    sorting = ["_key", "_order", "_to", "_status"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sorting).sortWithinPartitions(*sorting)
    place = F.monotonically_increasing_id()  # tasks in their order, rows in theirs
    dealt = kept(dealt.withColumns({"_part": F.shiftright(place, 33), "_chunk": F.floor(place / chunk)}), "dealt")
    # rows to chunks, chunks to the parts that tasks hold, parts to documents; then down again
    chunks = kept(listed(dealt, ["_key", "_part", "_chunk"], "_order", "_to", "_status"), "chunks")
    same = F.array(*(F.lit(n) for n in range(len(STATES))))
    tables = chunks.select("_key", "_part", "_chunk", F.aggregate("list", same, lambda before, row: F.transform(before, lambda s: after(s, row["_to"]))).alias("table"))
    tables = kept(tables, "tables")
    parts = starts(composed(tables, ["_key", "_part"], "_chunk"), ["_key"], "_part", None)
    before = kept(starts(tables, ["_key", "_part"], "_chunk", parts), "starts")

    begin = F.struct(F.col("start").alias("now"), F.array().cast("array<int>").alias("seen"))
    walk = F.aggregate("list", begin, lambda acc, row: F.struct(after(acc["now"], row["_to"]).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")))
    walked = chunks.join(before, ["_key", "_part", "_chunk"]).select("_key", F.explode(F.arrays_zip(F.col("list").alias("row"), walk["seen"].alias("before"))).alias("p")).select("_key", "p.*")
    name = lambda n: F.element_at(F.array(*map(F.lit, STATES)), n + 1)
    to = F.col("row._to")
    return walked.select(
        F.col("_key").alias(key), *(F.col(f"row._order.{c}").alias(c) for c in order), F.col("row._status").alias(status), name(F.col("before")).alias("before"),
        name(after(F.col("before"), to)).alias("after"), allowed(F.col("before"), to).alias("legal"))
