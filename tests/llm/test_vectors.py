import sys

import edge_rows
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm import embedding_dedup as E  # noqa: E402
from sheetlens.llm import topk_search as T  # noqa: E402
from sheetlens.llm.embedding_dedup import linked_vectors  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from sheetlens.llm.topk_search import product, top_k  # noqa: E402


@pytest.mark.parametrize("name", ["op4_embedding_dedup", "op7_topk_search"])
def test_queries_equal_their_sql(spark, sf1, tmp_path, name):
    """On all vectors of the largest table, so every link and every rank of brute force is found."""
    assert check(QUERIES[name](spark, sf1), ORACLE_SQL[name], sf1, tmp_path) > 0


def vectors(spark):
    """Clusters of near copies around the threshold, exact copies, and odd rows."""
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for c in range(12):
        base = rng.normal(size=24)
        for k in range(10):
            v = base + rng.normal(size=24) * 0.02 * k
            rows.append((n, v.tolist(), c % 3))
            n += 1
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)]
    n += 30
    odd = [None, [], [0.0] * 24, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [float("inf")] * 24, [1.0, 2.0], [1e300] * 24]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    n += len(odd)
    rows += [(n, rows[0][1], None), (n + 1, [x * 3 for x in rows[0][1]], rows[0][2]), (n + 1, rows[0][1], rows[0][2])]
    return rows, spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, label int, node long, code string")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_links_and_components(spark):
    rows, df = vectors(spark)
    unit = [np.array(v) / np.linalg.norm(np.array(v) / np.max(np.abs(v))) / np.max(np.abs(v)) if usable(v) and any(v) and lab is not None else None for _, v, lab in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(rows))]
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    want = sorted((rows[i][0], len(links[i]), least[comp[i]]) for i in range(len(rows)))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in linked_vectors(df).collect())
    assert got == want
    assert linked_vectors(df.limit(0)).count() == 0


def brute_links(x, labels):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])).sum(1) - 1


@pytest.mark.parametrize(("dims", "dense"), [(64, 1024), (64, 1), (64, 10**9), (16, 1024), (3, 1024)])
def test_a_group_of_half_of_the_rows(spark, dims, dense):
    """Half of the vectors are near copies of one; dense buckets, sparse ones and vectors of few dimensions lose no link."""
    rng = np.random.default_rng(dims)
    base = rng.normal(size=dims)
    x = np.concatenate([base + rng.normal(size=(400, dims)) * 0.08 * np.linalg.norm(base) / dims**0.5, rng.normal(size=(400, dims))])
    labels = np.arange(800) % 2
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in linked_vectors(df, dense=dense).collect()}
    want = brute_links(x, labels)
    found, there = sum(got.values()), int(want.sum())
    assert all(got[i] <= want[i] for i in got)
    assert found >= 0.99 * there


@pytest.mark.parametrize("clusters", [3, 6, 12])
def test_few_directions_lose_no_link(spark, clusters):
    """Where all vectors stand in a few groups, every link is still found."""
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 64))
    x = centres[np.arange(600) % clusters] + rng.normal(size=(600, 64)) * 0.09
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = brute_links(x, np.ones(600))
    assert 0 < want.sum() < 600 * 600
    got = {r.vec_id: r.n_links for r in linked_vectors(df).collect()}
    assert [got[i] for i in range(600)] == want.tolist()


def test_sets_are_added_until_few_are_missed():
    rng = np.random.default_rng(2)
    assert len(E.learn_sets(rng.normal(size=(3000, 64)), 0.98)) <= 2
    assert len(E.learn_sets(rng.normal(size=(3000, 64)), 0.9)) > 2


def test_few_dimensions_do_not_meet_all(spark):
    rng = np.random.default_rng(0)
    coded = E.encode(E.unit_rows(rng.normal(size=(1500, 16))), E.learn_codes(rng.normal(size=(1500, 16))))
    parts = E.masks(E.TABLES)
    for first, width in parts:
        part = (coded.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)
        assert np.unique(part, return_counts=True)[1].max() <= 150


def test_top_k(spark):
    rows, df = vectors(spark)
    whole = lambda x: min(max(int(np.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256, -(2**63)), 2**63 - 1)
    rows = [(i, [whole(x) for x in v]) for i, v, _ in rows if usable(v)]
    assert max(abs(x) for _, v in rows for x in v) == 2**63 - 1
    rows.append((5000, [0] * 24))
    df = df.unionByName(spark.createDataFrame([(5000, [0.0] * 24, 1, 9, "x")], df.schema))
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), j) for j, y in rows if j != q)[:5]
            want += [(q, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df, F.lit(False)).count() == 0


def test_top_k_skips_blocks(spark, monkeypatch):
    """Clustered vectors in many small blocks, groups and chunks: the same rows, and most blocks are not scored."""
    for name, v in (("BLOCK", 20), ("GROUP", 8), ("CHUNK", 16), ("SALTED", 2)):
        monkeypatch.setattr(T, name, v)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(30, 16)), 50, axis=0) * 3 + rng.normal(size=(1500, 16)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scored, plain = [], T.saved
    monkeypatch.setattr(T, "saved", lambda d, label: scored.append((label, plain(d, label))) or scored[-1][1])
    n = {}
    monkeypatch.setattr(T, "discard", lambda *tables: n.update({label: d.count() for label, d in scored if label in ("first", "again", "blocks")}))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect())
    q = np.floor(256 * x)
    want = []
    for i in range(0, 1500, 10):
        s = q @ q[i]
        best = sorted((j for j in range(1500) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k, j, int(s[j])) for k, j in enumerate(best, 1)]
    assert got == sorted(want)
    assert n["first"] + n["again"] < 0.35 * 150 * n["blocks"]


def test_large_products_are_exact():
    a = np.array([[2.0**40, 1.0]])
    assert int(product(a, np.array([[2.0**20, 1.0]]))[0, 0]) == 2**60 + 1
