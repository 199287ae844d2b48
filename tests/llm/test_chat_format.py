import sys
from collections import Counter, defaultdict
from itertools import product

import edge_rows
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402

from sheetlens.llm import chat_format as C  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, inner_line, op6_chat_formatting, transcripts  # noqa: E402


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op6_chat_formatting(spark, sf01), ORACLE_SQL["op6_chat_formatting"], sf01, tmp_path) > 0


def plain_reader(lines):
    """Turns by the markers of roles alone."""
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        m, text = C.read_line(line)
        if m < len(C.ROLES) or not out:
            out.append((C.ROLES[m] if m < len(C.ROLES) else "user", [text if m < len(C.ROLES) else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(kept).strip("\n")) for role, kept in out]


def test_turns_are_recovered_from_noisy_transcripts(spark, sf01):
    """The model recovers far more turns, role and whole text, than the markers alone give."""
    turns = spark.read.parquet(f"{sf01}/conversations.parquet")
    want = Counter((r.conv_id, r.role, r.t.strip("\n")) for r in turns.withColumn("t", F.concat("text", inner_line())).collect())
    got = Counter((r.conv_id, r.role, r.text) for r in op6_chat_formatting(spark, sf01).collect())
    lines = defaultdict(list)
    for r in transcripts(turns).orderBy("conv_id", "part").collect():
        lines[r.conv_id] += C.lines_of([r.text])
    plain = Counter((k, *t) for k, x in lines.items() for t in plain_reader(x))
    n = sum(want.values())
    assert sum((want & got).values()) >= 0.87 * n
    assert sum((want & plain).values()) <= 0.75 * n


def test_chunks_find_the_path_of_the_whole(spark, sf001, monkeypatch):
    """One long transcript, decoded in many chunks, with a small and a deep tree, and at once; a row is a turn throughout."""
    turns = spark.read.parquet(f"{sf001}/conversations.parquet")
    counts = C.learn(turns, "conv_id", "turn", "role", "text")
    lines = [r.text for r in transcripts(turns).orderBy("conv_id", "part").collect()] * 3
    want = [(i, C.ROLES[role], kept.strip("\n")) for i, (_, role, kept) in enumerate(C.turns_of(C.Model(counts), C.lines_of(lines)))]
    parts = spark.createDataFrame([("k", i * 5, x) for i, x in enumerate(lines)], "conv_id string, part long, text string")
    for fan in (C.FAN, 3):
        monkeypatch.setattr(C, "FAN", fan)
        assert sorted((r.turn, r.role, r.text) for r in C.format_chats(parts, counts).collect()) == want


def test_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    model = C.Model({"start": np.array([0.2, 0.5, 0.3]), "step": rng.dirichlet(np.ones(3), 3), "sizes": np.ones((2, 3, 9)) / 9, "stay": np.array([0.3, 0.5, 0.7])})
    for _ in range(10):
        e = rng.normal(size=(5, C.S)) * 2
        score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:])) + sum(e[i, s] for i, s in enumerate(p))  # noqa: E731, B023
        best = max(product(range(C.S), repeat=5), key=score)
        assert tuple(model.path(e)) == best


def test_transfer_is_viterbi():
    rng = np.random.default_rng(0)
    model = C.Model({"start": np.ones(3) / 3, "step": np.ones((3, 3)) / 3, "sizes": np.ones((2, 3, 9)) / 9, "stay": np.full(3, 0.6)})
    e = rng.normal(size=(9, C.S))
    whole = model.transfer(e)[1]
    parted = (model.transfer(e[:4])[1][:, None] + model.transfer(e[4:])[0]).max(0)
    assert np.allclose(whole, parted)


def test_edges(spark):
    counts = C.learn(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    rows = [(1, 0, "User: hi"), (1, 1, None), (1, 1, ""), (1, 2, "Bot: yo\nmore"), (1, 2, "Bot: yo\nmore"), (None, 0, "no marker"), (None, 0, "no marker"), (2, 0, None), (3, 5, "System: " + "x " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, part long, text string, role string")
    got = [(r.conv_id, r.turn, r.role, r.text[:8]) for r in C.format_chats(df, counts).collect()]
    assert sorted(g for g in got if g[0]) == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\nmore"), (1, 2, "assistant", "yo\nmore"), (3, 0, "system", "x x x x ")]
    assert [(g[1], g[3]) for g in got if g[0] is None] == [(0, "no marke")] * 2
    assert C.format_chats(df.where(F.lit(False)), counts).count() == 0


def test_many_rows_of_one_number(spark):
    turns = [(1, None, "user", "early"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, None, "user", "only"), (None, None, "user", "no id")]
    counts = C.learn(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    rows = [(1, None, "User: early"), (1, 0, "User: hi"), (1, 1, "Bot: yo"), (2, None, "Bot: only"), (None, None, "User: no id"), (4, None, None)]
    rows += [(3, None, "User: same")] * 150 + [(3, None, f"Bot: answer {i}") for i in range(150)] + [(3, 0, "User: end")]
    rows += [(5, 0, "User: first")] + [(5, 1, f"Bot: {i}") for i in range(120)] + [(5, 2, "User: last")]
    every = []
    for most in (10, 100, 10**6):
        got = C.format_chats(spark.createDataFrame(rows, "conv_id long, part long, text string"), counts, most=most).collect()
        assert [(r.turn, r.role, r.text) for r in sorted(got, key=lambda r: r.turn) if r.conv_id == 1] == [(0, "user", "early"), (1, "user", "hi"), (2, "assistant", "yo")]
        assert sorted((r.conv_id or 0, r.turn, r.role, r.text) for r in got if r.conv_id in (None, 2, 4)) == [(0, 0, "user", "no id"), (2, 0, "assistant", "only")]
        for conv, n, end in ((3, 301, "end"), (5, 122, "last")):
            many = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.turn)
            assert [r.turn for r in many] == list(range(n))
            assert many[-1].text == end
        assert sum(r.text == "same" for r in got) == 150
        every.append(sorted(tuple(r) for r in got if r.conv_id))
    assert every[0] == every[1] == every[2]  # the size of chunks changes no turn


def test_markers():
    for line, role in (("User: a", 1), ("### Assistant\n", 2), ("[Human] x", 1), ("<|system|> y", 0), ("**Q:** z", 1), ("Dave: hm", C.OTHER), ("plain text", C.NONE), ("", C.NONE)):
        assert C.read_line(line.strip("\n"))[0] == role, line
