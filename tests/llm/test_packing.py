import zlib

import edge_rows
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetlens.llm import packing as P
from sheetlens.llm.common import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    """The file's tokenizer as it is."""
    return Tokenizer.from_file(PATH)


def check(rows, docs, capacity=1024):
    """Every piece is right, sequences are gapless, and there are hardly more than the tokens need."""
    t = tokenizer()
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_pack(spark, sf01):
    docs = documents(spark, sf01)
    used, least = check(P.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least + 3  # no more than by any packing, but for a few


def test_edges(spark):
    check(P.pack(edge_rows.documents(spark), PATH).collect(), [r[:2] for r in edge_rows.ROWS])
    marked = [(1, "a <|endoftext|> b<|endoftext|>", None, None, 0), (2, "<|endoftext|>" * 1100, None, None, 0), (3, "plain text", None, None, 0), (4, "<|endoftext", None, None, 0)]
    check(P.pack(edge_rows.documents(spark, marked), PATH).collect(), [r[:2] for r in marked])
    equal = [(None, "the same text", None, None, 0)] * 300 + [(7, None, None, None, 0)] * 300
    assert check(P.pack(edge_rows.documents(spark, equal), PATH, cell=10).collect(), [r[:2] for r in equal]) == (2, 2)
    assert P.pack(edge_rows.documents(spark, []), PATH).count() == 0


def test_words_after_spaces_are_tokens_of_their_own():
    w, t = P.WordIds(PATH), tokenizer()
    texts = ["", " ", "  ", "a  b", " a", "a ", "x\n y", "x \n y", "it 's", "a\tb \t c", "<|endoftext|> a <|endoftext|>", "日本 語", "a 　b", "a   b c", "a   b", "don't we'll", "1 22 333", "a \x1c b"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
def test_plan_holds_every_item_once(histogram):
    plan = P.reduce_and_fit(dict(histogram), 30)
    got: dict = {}
    for n, items in plan:
        assert n > 0
        assert sum(items) <= 30
        for s in items:
            got[s] = got.get(s, 0) + n
    assert got == histogram
    least = max(-(-sum(s * n for s, n in histogram.items()) // 30), sum(n for s, n in histogram.items() if s > 15))
    assert sum(n for n, _ in plan) <= max(least, 1.25 * least + 1)


def best_possible(items, capacity):
    items = sorted(items, reverse=True)

    def fits(i, rooms):
        if i == len(items):
            return True
        seen = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in seen:
                seen.add(room)
                if fits(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]]):
                    return True
        return False

    n = -(-sum(items) // capacity)
    while not fits(0, [capacity] * n):
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(4, 20), min_size=1, max_size=8))
def test_reduction_fixes_only_what_an_optimum_has(items):
    """What the reduction fixed leaves an instance whose optimum completes the whole's."""
    histogram = {s: items.count(s) for s in set(items)}
    calls = []
    fit, P.best_fit = P.best_fit, lambda h, c: calls.append(dict(h)) or []
    try:
        fixed = P.reduce_and_fit(dict(histogram), 20)
    finally:
        P.best_fit = fit
    rest = [s for s, n in calls[0].items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + (best_possible(rest, 20) if rest else 0) >= best_possible(items, 20)
    if not rest:
        assert sum(n for n, _ in fixed) == best_possible(items, 20)


def test_long_runs_of_white_space(spark):
    """Runs on which the pattern's own engine runs out of stack, alone and between words, against the file's tokenizer; some long runs also through the query's path."""
    ids, slow = P.WordIds(PATH), tokenizer()
    for ch in " \n\t\u3000":
        for n in (P.WordIds.RUN - 1, P.WordIds.RUN, P.WordIds.RUN + 1, 2_000_000):
            for text in (ch * n, f"a{ch * n}b", f"x y{ch * n}", f"{ch * n}'s", f"a b{ch * n}\x1c{ch * n}\u00e9 c"):
                if n < 10_000 or text == ch * n:
                    assert ids.encode([text])[0] == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    assert len(ids.encode([text])[0]) > 0
    docs = [(1, f"a{ch * 1_500_000}b") for ch in " \n"] + [(2, "plain")]
    rows = P.pack(edge_rows.documents(spark, [(i, t, "en", "s", 1) for i, t in docs]), PATH, capacity=1024).collect()
    check(rows, docs)
