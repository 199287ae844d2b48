"""Hold a query's rows against DuckDB's for the query's SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def check(df, sql: str, sf_dir: str, tmp_path) -> int:
    out = os.path.join(str(tmp_path), "rows")
    df.write.parquet(out)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    con.execute(f"CREATE TABLE want AS {sql}")
    kinds = {t: sorted(tuple(r[:2]) for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in ("got", "want")}
    assert kinds["got"] == kinds["want"]
    cols = ", ".join(f'"{c}"' for c, _ in kinds["want"])
    n = con.execute("SELECT count(*) FROM want").fetchall()[0][0]
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
    return n
