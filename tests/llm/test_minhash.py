import edge_rows
import numpy as np
import pytest

from brute import classes as brute

from sheetlens.llm import minhash_dedup as M
from sheetlens.llm.common import documents
from sheetlens.llm.components import connected_components


def test_classes_equal_brute_force(spark, sf001):
    docs = documents(spark, sf001)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(docs).collect()}
    assert got == want
    kept = M.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_no_planted_pair_is_lost(spark, sf01):
    """All documents of the table and planted near copies, by all pairs; texts without ids among them."""
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in documents(spark, sf01).where("n_chars < 4000").collect()]
    long = [(i, t) for i, t in rows if t and 60 <= len(t.split()) <= 400][:120]
    for n, (i, t) in enumerate(long):
        words = t.split()
        for k in range(n % 4):  # words changed at one place, a line repeated, or both
            at = rng.integers(0, len(words) - 3)
            words[at : at + 2] = [f"new{n}x{k}"]
        rows.append((100_000 + n, " ".join(words + words[:8] * (n % 3))))
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(want[100_000 + n] < 100_000 for n in range(len(long))) >= 60
    plain = spark.createDataFrame([(None if i >= 100_000 else i, t) for i, t in rows], "doc_id long, text string")
    classes = {r.class_id for r in M.near_duplicate_classes(plain).collect()}
    assert classes >= {c for c in want.values() if c < 100_000}
    lonely = [n for n in range(len(long)) if want[100_000 + n] >= 100_000]
    assert M.one_of_each_class(plain).where("doc_id IS NULL").count() == len({want[100_000 + n] for n in lonely})


def test_blocks_of_one_key_find_what_all_pairs_find(spark, monkeypatch):
    """A chain of texts that all share keys, in tiny blocks."""
    monkeypatch.setattr(M, "BLOCK", 3)
    rng, rows = np.random.default_rng(5), []
    words = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    for i in range(40):
        at = rng.integers(0, 195)
        words[at : at + 2] = [f"n{i}", f"m{i}"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in M.near_duplicate_classes(docs).collect()} == brute(rows)


def test_texts_with_a_much_repeated_line(spark):
    rng, rows = np.random.default_rng(3), []
    for pair in range(20):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 220)]
        text, line = " ".join(words[:200]), " ".join(words[200:])
        rows += [(2 * pair, text), (2 * pair + 1, " ".join([text, *[line] * (10 if pair % 2 else 30)]))]
    want = brute(rows)
    assert {want[2 * p + 1] for p in range(20)} == {2 * p for p in range(20)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in M.near_duplicate_classes(docs).collect()} == want


def test_edges(spark):
    got = sorted(((r.doc_id or 0), r.class_id or 0) for r in M.near_duplicate_classes(edge_rows.documents(spark)).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8), (10, 10), (11, 11)]
    docs = edge_rows.documents(spark, [(1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1)])
    assert [r.doc_id for r in M.one_of_each_class(docs).orderBy("doc_id").collect()] == [1]
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j k l"), (2, "x y z x y"), (2, "x y z x y"), (3, "x y z x y"), (4, None), (4, None), (None, ""), (None, ""), (5, "g h i j k l")]
    docs = edge_rows.documents(spark, [(*r, "en", "s", 1) for r in rows])
    kept = sorted(((r.doc_id or 0), r.text or "") for r in M.one_of_each_class(docs).collect())
    assert kept == [(0, ""), (0, ""), (0, "a b c d e f"), (2, "g h i j k l"), (2, "x y z x y"), (4, "")]
    assert M.near_duplicate_classes(edge_rows.documents(spark, [])).count() == 0


def test_probability_jaccard_against_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 12, 9)).astype(np.uint64) for _ in range(2))
        ca, cb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
        x, y = dict(zip(a.tolist(), ca.tolist())), dict(zip(b.tolist(), cb.tolist()))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert M.similarity(a, ca, b, cb)[0] == pytest.approx(want)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = np.concatenate((base[:260], rng.integers(0, 2**63, 40).astype(np.uint64)))
    sets = []
    for shift in range(40):
        for s in (base, other):
            v = np.sort(s + np.uint64(shift * 7919))
            sets.append((v, np.ones(len(v), int)))
    r = M.registers(sets)
    share = np.mean(r[0::2] == r[1::2])
    assert abs(share - 260 / 340) < 0.03


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}
