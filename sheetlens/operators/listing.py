"""Answers to a reviewer's questions: lists, details, filters, sorts, summaries, CSV lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import ISSUE_TYPES, SEVERITIES, severity_rank


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("document_id").agg(F.count("id").alias("cnt"))


def with_issue_count(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Documents with the number of their issues, 0 where there are none. One plan, one snapshot."""
    counts = issue_counts(issues).withColumnRenamed("document_id", "id")
    return documents.join(counts, "id", "left").withColumn("issue_count", F.coalesce("cnt", F.lit(0)).cast("long")).drop("cnt")


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("uploaded_at"), "id")


def guarded(issues: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Issues whose document, named by ``key``, is among ``documents``."""
    return issues.join(documents.select(F.col("id").alias(key)), key, "left_semi")


def filtered(issues: DataFrame, severity: str = "all", issue_type: str = "all") -> DataFrame:
    """Both filters must hold; ``all`` filters nothing."""
    for col, value in (("severity", severity), ("issue_type", issue_type)):
        if value != "all":
            issues = issues.where(F.col(col) == value)
    return issues


#: How a list of issues can be sorted, ties by page and id.
SORTS: dict[str, Column] = {"severity": severity_rank, "page": lambda _: F.col("page_number"), "type": lambda _: F.col("issue_type")}


def sorted_position(issues: DataFrame, by: str) -> DataFrame:
    """``pos``: each issue's place, from 1, in its document's list."""
    first = SORTS[by](F.col("severity"))
    return issues.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy(first, "page_number", "id")).cast("long"))


def summary(issues: DataFrame) -> DataFrame:
    """(document_id, kind, value, n): totals, and counts by severity and by type, from one scan."""
    sets = F.expr("stack(3, 'total', '', 'severity', severity, 'type', issue_type) AS (kind, value)")
    return issues.select("document_id", sets).groupBy("document_id", "kind", "value").agg(F.count("*").alias("n"))


def checked_summary(issues: DataFrame) -> DataFrame:
    """``summary`` of findings that the store has checked, so their severities and types are known: one row of numbers for each document is moved."""
    kinds = [("total", "", F.count("*"))]
    kinds += [(kind, v, F.count_if(F.col(col) == v)) for kind, col, values in (("severity", "severity", SEVERITIES), ("type", "issue_type", ISSUE_TYPES)) for v in values]
    counts = issues.groupBy("document_id").agg(*(n.alias(f"n{i}") for i, (_, _, n) in enumerate(kinds)))
    stacked = ", ".join(f"'{kind}', '{v}', n{i}" for i, (kind, v, _) in enumerate(kinds))
    return counts.select("document_id", F.expr(f"stack({len(kinds)}, {stacked}) AS (kind, value, n)")).where("n > 0")


def total(issues: DataFrame) -> DataFrame:
    """One row, also for no issues."""
    return issues.agg(F.count("*").alias("total"))


def zero_filled(issues: DataFrame) -> DataFrame:
    """Counts of all severities per document, in fixed order, 0 where there are none."""
    counts = issues.groupBy("document_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    stacked = ", ".join(f"{i}L, '{s}', `{s}`" for i, s in enumerate(SEVERITIES))
    return counts.select("document_id", F.expr(f"stack({len(SEVERITIES)}, {stacked}) AS (place, severity, n)"))


def type_histogram(issues: DataFrame) -> DataFrame:
    """Counts of the types, most frequent first."""
    counts = issues.groupBy("issue_type").agg(F.count("*").alias("n"))
    return counts.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "issue_type")).cast("long"))  # one row a type


def filtered_of_total(issues: DataFrame, severity: str, issue_type: str) -> DataFrame:
    keep = (F.lit(severity == "all") | (F.col("severity") == severity)) & (F.lit(issue_type == "all") | (F.col("issue_type") == issue_type))
    return issues.groupBy("document_id").agg(F.count_if(keep).alias("shown"), F.count("*").alias("total"))


CSV_COLUMNS = ("id", "page_number", "issue_type", "severity", "description", "location_hint")


def csv_line(*, quoted: tuple[str, ...] = ("description", "location_hint"), of: Callable[[str], Column] = F.col) -> Column:
    return F.concat_ws(",", *(X.quoted(of(c)) if c in quoted else of(c).cast("string") for c in CSV_COLUMNS))


def csv_row() -> Column:
    """What a line is made of: less than the line with what it is sorted by."""
    return F.struct(*CSV_COLUMNS)


def csv_text(rows: str) -> Column:
    """The CSV text of a list of ``csv_row``, in any order: header first, no newline at its end."""
    lines = F.sort_array(F.transform(rows, lambda r: F.struct(r["page_number"].alias("page_number"), r["id"].alias("id"), csv_line(of=r.getField).alias("line"))))
    return F.concat(F.lit(",".join(CSV_COLUMNS) + "\n"), F.array_join(F.transform(lines, lambda r: r["line"]), "\n"))


def csv_files(issues: DataFrame) -> DataFrame:
    """(document_id, csv): a whole CSV text per document."""
    lines = issues.select("document_id", csv_row().alias("row"))
    return lines.groupBy("document_id").agg(F.collect_list("row").alias("rows")).select("document_id", csv_text("rows").alias("csv"))


def card_text() -> Column:
    """What a list card says of its issues."""
    return F.when(F.col("issue_count") > 0, X.plural(F.col("issue_count"), "issue")).when(F.col("status") == "completed", "No issues").otherwise("")


def positions(rows: DataFrame, place: str, cell: Column) -> DataFrame:
    """``rows`` with ``pos``, from 1 by ``place`` descending. ``cell`` follows the same order and parts the rows: cells are counted first, places are found inside them."""
    parted = rows.withColumn("_cell", cell)
    cells = parted.groupBy("_cell").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = cells.select(F.col("_cell").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(F.desc(place)))
    placed = parted.withColumn("_in", inside).join(cells, F.col("_cell").eqNullSafe(F.col("_of")))
    return placed.withColumn("pos", (F.col("_in") + F.col("_before")).cast("long")).drop("_cell", "_of", "_in", "_before")
