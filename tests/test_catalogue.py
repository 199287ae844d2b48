"""Every query of the catalogue against its SQL, and the plans of some."""

import pytest

from sheetlens.plans import catalogue, review_queries, table_queries  # noqa: F401
from sheetlens.sources.tables import review_issues

from oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(name, spark, sf001, tmp_path):
    check(catalogue.QUERIES[name](spark, sf001), catalogue.ORACLE_SQL[name], sf001, tmp_path)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans_stay_in_the_engine(spark, sf001):
    for name in ("reply_parse", "reply_rejects", "issue_summary", "csv_files", "document_list", "card_text"):
        assert "Python" not in plan(catalogue.QUERIES[name](spark, sf001)), name


def test_pushdown_and_pruning(spark, sf001):
    text = plan(catalogue.issues_for_document(spark, sf001))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,42)" in text
    text = plan(review_issues(spark, sf001).groupBy("severity").count())
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]


def test_guarded_lines_move_without_their_texts(spark, sf001):
    """The semi-join with the documents stands below the join with the parts, whose texts a shuffle would carry."""
    df = catalogue.issues_guarded(spark, sf001)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner") < text.index("Join LeftSemi")
    assert df.columns == review_issues(spark, sf001).columns
