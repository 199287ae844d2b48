"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from sheetlens.functions import text as X
from sheetlens.schema import MAX_UPLOAD_BYTES, create_table_sql, DOCUMENTS, ISSUES, status_label, type_label


def one(spark, f, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("\x1c a \x85", "a"), ("  x　", "x"), ("", ""), (" \n\t", ""), ("a b", "a b"), ("​z", "​z")],
)
def test_strip_is_unicode_aware(spark, given, want):
    assert one(spark, X.strip, given) == want == given.strip()


def test_strip_knows_all_white_space(spark):
    space = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert one(spark, X.strip, "".join(space) + "x" + "".join(space)) == "x"


@pytest.mark.parametrize(
    ("given", "want"),
    [("```json\n{}\n```", "{}"), ("```\n{}", "{}"), ("```", ""), ("{}", "{}"), ("```\n```", ""), ("```a\nb\n``` \n", "b"), ("```\nx\n```\ny", "x\n```\ny"), (None, "")],
)
def test_without_fence(spark, given, want):
    assert one(spark, X.without_fence, given) == want


def test_names(spark):
    assert one(spark, X.extension, "A.B.PDF") == "pdf"
    assert one(spark, X.extension, "pdf") == "pdf"
    assert one(spark, X.extension, "x.") == ""
    assert one(spark, X.export_name, "Plan.PDF") == "Plan_issues.csv"
    assert one(spark, X.blob_name, "7", "a/b/c.pdf") == "7_c.pdf"
    assert one(spark, X.blob_name, "7", None) == "7_upload.pdf"


def test_quoting(spark):
    assert one(spark, X.quoted, 'say "hi", ok') == '"say ""hi"", ok"'
    assert one(spark, X.quoted, None) == '""'


def test_size_bound_is_inclusive(spark):
    rows = spark.createDataFrame([("a.pdf", MAX_UPLOAD_BYTES), ("a.pdf", MAX_UPLOAD_BYTES + 1)], "f string, n long")
    got = rows.select(X.accepted_upload(F.lit("application/pdf"), F.col("f"), F.col("n"), MAX_UPLOAD_BYTES)).collect()
    assert [r[0] for r in got] == [True, False]


def test_driver_and_arguments(spark):
    assert one(spark, X.installed_driver, "p+asyncpg://x+asyncpg") == "p+psycopg://x+asyncpg"
    assert one(spark, X.connect_args, "postgresql://eu.pooler.supabase.com:6543") == {"connect_timeout": "10", "sslmode": "require", "prepare_threshold": "none"}
    assert one(spark, X.connect_args, "postgresql://localhost") == {"connect_timeout": "10"}


def test_labels(spark):
    assert one(spark, type_label, "missing_scale") == "Missing Scale"
    assert one(spark, type_label, "odd") == "odd"
    assert one(spark, status_label, "odd") == "Pending"


def test_tables_can_be_created(spark):
    for name, schema in (("t_documents", DOCUMENTS), ("t_issues", ISSUES)):
        spark.sql(create_table_sql(name, schema))
        assert [f.name for f in spark.table(name).schema] == [f.name for f in schema]
        spark.sql(f"DROP TABLE {name}")
