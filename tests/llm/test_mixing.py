import sys

import duckdb
import edge_rows

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm.mixing import mix, oracle, tree  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, op2_mix_sources  # noqa: E402


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op2_mix_sources(spark, sf01), ORACLE_SQL["op2_mix_sources"], sf01, tmp_path) > 0


def test_edges(spark, tmp_path):
    docs = edge_rows.documents(spark)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    for fraction, epochs in ((0.5, 2), (1.0, 1), (5.0, 2), (0.0, 1), (1e-9, 1)):
        got = sorted(map(str, (tuple(r) for r in mix(docs, *tree(), fraction=fraction, epochs=epochs).select("doc_id", "domain", "lang", "source", "tokens", "epoch").collect())))
        want = sorted(map(str, con.execute(f"SELECT doc_id, domain, lang, source, tokens, epoch FROM ({oracle(fraction, epochs)})").fetchall()))
        assert got == want, fraction
    assert mix(edge_rows.documents(spark, []), *tree(), fraction=0.5).count() == 0


def test_no_python_in_the_plan(spark, sf001):
    assert "Python" not in op2_mix_sources(spark, sf001)._jdf.queryExecution().toString()
