import brute
import corpus_pipeline as CP
import duckdb
import edge_rows
import test_packing

from sheetlens.llm.common import crc_mod, documents, saved
from sheetlens.llm.mixing import oracle
from sheetlens.llm.quality import fit_quality
from sheetlens.llm.toxicity import fit_toxicity


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_and_run_equal_brute_force(spark, sf001, tmp_path):
    """Each stage's rows from plain loops or SQL over what the stage before kept; the last are those of ``run``."""
    docs, stages = documents(spark, sf001), dict(CP.STAGES)
    labels = CP.labels_of(spark, sf001)

    rows = docs.collect()
    scores = brute.toxicity_scores(*fit_toxicity(docs, labels, crc_mod("doc_id", 4) != 2).fitted, [r.text for r in rows])
    docs = saved(stages["toxicity"](spark, docs, sf001), "toxicity")
    assert ids(docs) == sorted(r.doc_id for r, s in zip(rows, scores) if s < CP.TOXIC_FROM)
    assert len(rows) > docs.count() > 0.8 * len(rows)

    rows = docs.collect()
    scores = brute.quality_scores(fit_quality(docs, labels, crc_mod("doc_id", 5) != 0).space, [r.text for r in rows])
    docs = saved(stages["quality"](spark, docs, sf001), "quality")
    assert ids(docs) == sorted(r.doc_id for r, s in zip(rows, scores) if s >= CP.GOOD_FROM)
    assert docs.count() < len(rows)

    rows = docs.collect()
    docs = saved(stages["near_dedup"](spark, docs, sf001), "near")
    assert ids(docs) == sorted(set(brute.classes([(r.doc_id, r.text) for r in rows]).values()))
    assert docs.count() < len(rows)

    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle(CP.MIX_FRACTION, 1)})").fetchall())
    docs = saved(stages["mixing"](spark, docs, sf001), "mixing")
    assert ids(docs) == want
    assert docs.columns == documents(spark, sf001).columns

    packed = CP.run(spark, sf001).collect()
    used, least = test_packing.check(packed, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least + 3


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names; a table without rows."""
    labels = [(4, 1, 0), (6, 1, 0), (7, None, None), (8, 1, 0), (9, 1, 0), (None, 1, 1), (4, 0, 0), (11, 0, 1), (1, 0, 1)]
    edge_rows.labels(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    names = set(edge_rows.documents(spark).columns)
    for rows in (edge_rows.ROWS, []):
        docs = edge_rows.documents(spark, rows)
        for name, stage in CP.STAGES:
            out = saved(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert set(out.columns) == names
                assert out.exceptAll(docs).count() == 0
            assert out.count() > 0 if rows else out.count() == 0
    docs = edge_rows.documents(spark)
    kept = CP.without_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 6, 8, 10, 11]
    assert {r.doc_id for r in CP.packed(spark, docs, str(tmp_path)).collect()} == {r[0] for r in edge_rows.ROWS}


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is CP.run
    assert [name for name, _ in CP.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
