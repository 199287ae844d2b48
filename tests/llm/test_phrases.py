"""Collocations against SQL and a loop; the hash, the filters, the shards."""

import re
import sys
from collections import Counter, defaultdict

import edge_rows
import numpy as np

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm import phrases as P  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, op11_phrase_mining  # noqa: E402


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op11_phrase_mining(spark, sf01), ORACLE_SQL["op11_phrase_mining"], sf01, tmp_path) > 100


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        found = []
        for p, a in good.items():
            score, c = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c) for c in range(1, len(p)))
            if 100 * held[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:c]], counts[p[c:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in P.collocations(df, **kw).collect())


ROWS = edge_rows.ROWS + [
    (20, "New York, new york! NEW\tYORK  new york\r\nnew york\x0bcity of new york city of new york", None, "s", 1),
    (21, "a a a a a a. b a a b . . a a", "und", "s", 1),
    (22, "É é É é É é x x   y   y é É", "fr", "s", 1),
    (23, "\x1c x\x1c x \x00 \x00 \x00 .x. x\x85x x\x85x", "fr", "s", 1),
] + [(30 + i, "the quick brown fox jumps. over the quick brown dog; the slow brown fox", "en", "s", 1) for i in range(40)]


def test_odd_rows(spark):
    df = edge_rows.documents(spark, ROWS)
    for least, top in ((2, 2000), (30, 2000), (3, 5)):
        assert found(df, least=least, top=top) == brute(ROWS, least, top)
    assert found(edge_rows.documents(spark, [])) == []
    assert found(edge_rows.documents(spark, [(1, None, None, None, 0)])) == []


def test_shards_and_trees(spark, monkeypatch):
    """Many shards, many chunks and more tasks than a group sums give the same rows."""
    monkeypatch.setattr(P, "CHUNK", 8)
    monkeypatch.setattr(P, "FAN", 2)
    rows = ROWS[13:20]
    df = edge_rows.documents(spark, rows).repartition(7)
    assert found(df, least=2, keys=30) == brute(rows, 2)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        h = P.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        assert (h.slots(rng.integers(0, 2**64, 5000, np.uint64)) == -1).all()


def test_another_seed_is_tried_when_keys_are_shared(spark, monkeypatch):
    plain, seeds = P.counted_candidates, []

    def shared_at_first(table, usual, least, keys, seed):
        seeds.append(seed)
        if seed == 0:
            raise P.SharedKey
        return plain(table, usual, least, keys, seed)

    monkeypatch.setattr(P, "counted_candidates", shared_at_first)
    rows = ROWS[13:20]
    assert found(edge_rows.documents(spark, rows), least=2) == brute(rows, 2)
    assert seeds == [0, 1]


def test_different_second_hashes_are_noticed():
    a = np.array([[5, P.UNSEEN, P.UNSEEN, 7, P.TWO], [5, 6, P.UNSEEN, 8, 4]], np.int32)
    assert P.one_second(a).tolist() == [5, 6, P.UNSEEN, P.TWO, P.TWO]


def test_full_filters_lose_nothing(spark, monkeypatch):
    """A filter whose bits are all set lets everything through: more candidates, the same rows."""
    monkeypatch.setattr(P.Filter, "of", classmethod(lambda cls, rows: cls(np.full(P.FILTER_BITS // 64, ~np.uint64(0)))))
    rows = ROWS[-10:] + ROWS[13:17]
    assert found(edge_rows.documents(spark, rows), least=3) == brute(rows, 3)


def test_long_texts_are_cut_at_piece_ends():
    text = b"ab cd, ef gh. " * 1000
    parts = list(P.stretches(text, 100))
    assert len(parts) > 50
    assert [t for t in P.tokens(parts) if t != P.GAP] == [t for t in P.tokens([text]) if t != P.GAP]
    assert list(P.stretches(b"x" * 1000, 10)) == [b"x" * 1000]
