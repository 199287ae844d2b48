"""Clustered tables, the state machine, kept counts, places in a list: their plans and hard cases."""

import random

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import states as S
from sheetlens.operators.clustered import ClusteredStore
from sheetlens.operators.listing import positions, summary
from sheetlens.operators.store import ReviewStore, in_places
from sheetlens.plans import review_queries as Q
from sheetlens.sources.tables import review_documents, review_issues


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clustered_lists_move_no_rows(spark, sf001):
    store = ClusteredStore.of(review_documents(spark, sf001), review_issues(spark, sf001), "clustered_test", buckets=8)
    listing = store.listing()
    text = plan(listing)
    assert "Exchange" not in text and "SortMergeJoin" in text or "BroadcastHashJoin" in text and "ENSURE_REQUIREMENTS" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(store.listing())
        assert "Exchange" not in text and "Bucketed: true" in text
        assert listing.count() == review_documents(spark, sf001).count()
        text = plan(store.detail(42))
        assert "Exchange" not in text and text.count("SelectedBucketsCount: 1 out of 8") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (row,) = store.detail(42).collect()
    assert row.issue_count == review_issues(spark, sf001).where("document_id = 42").count()
    assert store.detail(-5).count() == 0
    # a bucket is one file, and its footer has the filter
    files = {r[0] for r in store.issues().select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 8
    store.drop()
    assert not spark.catalog.tableExists("clustered_test_issues")


def walked(rows):
    """The machine by a loop."""
    state, out = {}, []
    for key, n, status in sorted(rows, key=lambda r: (r[0], r[1])):
        before = state.get(key, "none")
        legal = status in S.LEGAL[before]
        state[key] = status if legal else before
        out.append((key, n, status, before, state[key], legal))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_long_histories(spark, tmp_path, chunk):
    """One document has most rows, over many tasks and chunks; states that nobody knows, and null, are never legal."""
    rng = random.Random(chunk)
    kinds = [*S.STATES, "archived", None]
    rows = [("long", i, rng.choice(kinds)) for i in range(700)] + [(f"d{i % 20}", i, rng.choice(kinds)) for i in range(200)] + [("once", 0, "pending"), ("late", 0, "completed")]
    log = spark.createDataFrame(rows, "doc string, n int, status string").repartition(5)
    got = S.checked_log(log, "doc", ["n"], "status", f"file://{tmp_path}", chunk=chunk)
    assert sorted((tuple(r) for r in got.collect()), key=str) == walked(rows)
    assert S.checked_log(log.limit(0), "doc", ["n"], "status", f"file://{tmp_path}").count() == 0


def test_counts_are_read_without_the_findings(spark, sf001):
    store = Q.reviewed(spark, sf001)
    files = store.counts().inputFiles()
    assert files and all("/store/counts/" in f for f in files)
    assert sorted(map(tuple, store.counts().collect())) == sorted(map(tuple, summary(store.issues()).select("document_id", "kind", "value", "n").collect()))


def test_counts_before_anything(spark, tmp_path):
    assert ReviewStore(spark, f"file://{tmp_path}/none").counts().count() == 0


def test_places_by_a_list(spark):
    """A log of changes against the list that they are made on one by one."""
    rng = random.Random(5)
    log, shown = [], []
    for n in range(300):
        key, gone = rng.randrange(40), rng.random() < 0.2
        log.append((key, n, f"v{n}", gone))
        at = next((i for i, (k, _) in enumerate(shown) if k == key), None)
        if gone:
            shown = [x for x in shown if x[0] != key]
        elif at is None:
            shown.insert(0, (key, f"v{n}"))
        else:
            shown[at] = (key, f"v{n}")
    df = spark.createDataFrame(log, "id int, n int, value string, deleted boolean").select("id", F.struct("n").alias("place"), "value", "deleted")
    rows = positions(in_places(df, "id", "place", "deleted"), "place", F.floor(F.col("place.n") / 50))
    assert [(r.id, r.value) for r in rows.orderBy("pos").collect()] == shown
    assert sorted(r.pos for r in rows.collect()) == list(range(1, len(shown) + 1))


def test_few_rows_of_counts_move(spark, tmp_path):
    """A finding adds to one row of its document, not to three; what a deletion takes back is counted for the deleted documents alone."""
    from sheetlens.operators.listing import checked_summary

    found = spark.range(60).selectExpr("cast(id % 3 AS string) AS document_id", "element_at(array('low', 'high'), cast(id % 2 AS int) + 1) AS severity", "'missing_tag' AS issue_type")
    assert sorted(map(tuple, checked_summary(found).collect())) == sorted(map(tuple, summary(found).select("document_id", "kind", "value", "n").collect()))
    assert "stack" not in checked_summary(found)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.append_counts(checked_summary(found))
    some = spark.createDataFrame([("1",)], "id string")
    counts = store.counts(some)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, store.counts().where("document_id = '1'").select(*counts.columns).collect()))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
