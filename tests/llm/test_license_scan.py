import re

import edge_rows

import sys

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm import license_scan as S  # noqa: E402
from sheetlens.llm.common import documents  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, op10_license_scan  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for p, label in S.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places(spark, sf01):
    text = {r.doc_id: r.text for r in documents(spark, sf01).collect()}
    rows = op10_license_scan(spark, sf01).collect()
    assert len(rows) == len(text)
    assert any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert any("gpl-3" in r.labels for r in rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "UNDER the MIT-License, under the mit license"), (4, "cc by nc by nc cc by-nc"), (5, "É underé the mit license"),
        (6, "apache license version 2" * 3), (6, "Apache License, Version 2.0"), (None, "under the mit license"), (7, "mit " * 50_000 + "under the mit license"),
        (8, "this work is licensed under the gnu general public license version 3"), (9, "the gnu general public"),
    ]
    df = edge_rows.documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = {(r.doc_id, r.n_words): r for r in S.scan_licenses(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, k, first, last, labels = brute(t)
        r = got[i, n]
        assert (len(r.starts), min(r.starts, default=None), max(r.starts, default=None), ",".join(r.base_labels)) == (k, first, last, labels)
        assert 0 <= r.score <= 1
    assert got[8, 12].labels == ["gpl-3"]
    assert got[9, 4].labels == []
    assert S.scan_licenses(edge_rows.documents(spark, [])).count() == 0


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op10_license_scan(spark, sf01), ORACLE_SQL["op10_license_scan"], sf01, tmp_path) > 0


def index(**parameters):
    words = {w for _, t, _ in S.TEMPLATES for w in t.encode().split()} | {w for p in S.PHRASES for w in p.encode().split()}
    return S.RareTokenIndex(dict.fromkeys(words, 1.0) | {b"the": 0.1, b"of": 0.1, b"and": 0.1, b"in": 0.1, b"use": 0.2}, **parameters)


def test_starts_are_intersected():
    """A key phrase whose template's rarer words stand elsewhere in the file is no notice; without the intersection it would be one."""
    scattered = "permitted modification without binary forms following redistribution and use in source and binary forms".encode().split()
    notice = S.TEMPLATES[1][1].encode().split()
    assert index().scan(notice)[2] == {"bsd"}
    assert index().scan(scattered)[2] == set()
    assert index(agree=1).scan(scattered)[2] == {"bsd"}
    assert index().scan("see the mozilla public license for more".encode().split())[2] == set()
    assert index(agree=1).scan("see the mozilla public license for more".encode().split())[2] == {"mpl-2"}


def test_the_number_of_rare_words_matters():
    """With few looked-up words, rare words that stand elsewhere hide a notice that lacks its end."""
    words = "permitted modification without redistribution and use in source and binary forms with or".encode().split()
    assert index(rare=4).scan(words)[2] == set()
    assert index(rare=8).scan(words)[2] == {"bsd"}
