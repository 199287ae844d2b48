import time
from itertools import product

import brute
import edge_rows
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetlens.llm import language_id as L
from sheetlens.llm import quality as Q
from sheetlens.llm import toxicity as T
from sheetlens.llm.common import crc_mod, documents
from sheetlens.llm.queries import op5_toxicity, op8_language_id, op9_quality_classifier


def label_rows(spark, sf_dir, label):
    return {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_toxicity_of_held_out_rows(spark, sf01):
    y = label_rows(spark, sf01, "toxic")
    rows = [r for r in op5_toxicity(spark, sf01).collect()]
    assert len(rows) == documents(spark, sf01).count()
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.9 * len(held)
    assert sum(r.predicted for r in held if not y[r.doc_id]) <= 0.05 * len(held)


def test_quality_of_held_out_rows(spark, sf01):
    y = label_rows(spark, sf01, "quality")
    held = [r for r in op9_quality_classifier(spark, sf01).collect() if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_votes_by_a_loop_over_the_neighbours(spark, sf001):
    """The scores of all documents from a plain loop in double precision over the labelled vectors."""
    docs, labels = documents(spark, sf001), spark.read.parquet(f"{sf001}/labels.parquet")
    make = Q.fit_quality(docs, labels, crc_mod("doc_id", 5) != 0)
    rows = docs.collect()
    got = make()({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows]})["score"]
    want = brute.quality_scores(make.space, [r.text for r in rows])
    assert sum(abs(a - b) > 1e-3 for a, b in zip(got, want)) <= 0.01 * len(rows)  # cosines that differ in the last place by single precision


def test_shapes_are_whole():
    assert Q.shape_of("a-b" * 30) == "~" + "a-" * 30 + "a"
    assert Q.shape_of("ABC123..x") == "~A0.a"


def test_language_of_held_out_rows(spark, sf01):
    y = {r.doc_id: r.lang for r in documents(spark, sf01).collect()}
    held = [r for r in op8_language_id(spark, sf01).collect() if r.held_out]
    assert sum(r.lang_pred == y[r.doc_id] for r in held) >= 0.98 * len(held)


@pytest.fixture(scope="module")
def restorer(spark):
    text = "you are an idiot and a stupid clown said the loser of all this trash " * 5
    return T.Restorer(T.character_model(spark.createDataFrame([(text,), (None,), ("",)], "text string")))


@pytest.mark.parametrize(
    ("token", "words"),
    [
        ("1d10t", ["idiot"]),
        ("id!ot,", ["idiot"]),
        ("stup1d", ["stupid"]),
        ("idiooooot", ["idiot"]),
        ("t.r.a.s.h", ["trash"]),
        ("cl0wn", ["clown"]),
        ("Idiot.", ["idiot"]),
        ("stupid###", ["stupid"]),
        ("12345", []),
        ("...", []),
    ],
)
def test_restored_words(restorer, token, words):
    assert restorer.words(token) == words


def path_cost(restorer, options, outs):
    """A path's cost by the lattice's options and the model; None where a space follows no letter."""
    a, b, cost = 0, 0, 0.0
    for (out, extra) in outs:
        cost += extra
        if out:
            k = T.letter_class(out)
            if out == " " and not b:
                return None
            cost -= restorer.model[a][b][k]
            a, b = b, k
    return cost - restorer.model[a][b][0]


@pytest.mark.parametrize("token", ["1d10t", "i!!t", "f*l", "lo00ser", "a.b", "s7up1d", "@$$", "i d1 o", "**", "t®x", "sss$", "é1é"])
def test_both_decoders_find_the_best_of_all_paths(restorer, token):
    options = [restorer.options(token, i) for i in range(len(token))]
    costs: dict = {}
    for outs in product(*options):
        cost, word = path_cost(restorer, options, outs), "".join(o for o, _ in outs)
        if cost is not None:
            costs[word] = min(cost, costs.get(word, np.inf))
    best = min(costs.values())
    assert costs[restorer.decode_small(token)] == pytest.approx(best)
    assert costs[restorer.decode_large(token)] == pytest.approx(best)


def test_long_tokens(restorer, monkeypatch):
    """Long lattices are whole, quick, and the same in pieces; surplus signs of a run change nothing."""
    began = time.monotonic()
    assert restorer.words("idiot" + "*" * 100_000 + "clown") in (["idiot", "clown"], ["idiotclown"])
    assert time.monotonic() - began < 5
    text = "1d10t.cl0wn*$tup1d" * 40
    whole = restorer.decode_large(text)
    monkeypatch.setattr(T.Restorer, "SETTLE", 50)
    assert restorer.decode_large(text) == whole
    for n in (20, 40, 60):
        assert restorer.decode_large("cl" + "*" * n + "wn") == restorer.decode_large("cl" + "*" * 200 + "wn")
        assert restorer.decode_large("lo" + "0" * n + "ser") == restorer.decode_large(restorer.shortened("lo" + "0" * n + "ser"))
    assert restorer.words("a" + "1b2*c3" * 5000)


def test_spaced_letters(restorer):
    assert T.spaced("the i d i o t said".split()) == ["i d i o t"]
    assert restorer.decode("i d i o t").replace(" ", "") == "idiot"


def test_tokens_of_signs_alone_are_decoded():
    table, counts = T.class_table(), np.ones((27, 27, 27))
    for word in ("ass", "the", "a", "is", "glass"):
        c = [0, 0, *(int(table[ord(x)]) for x in word), 0]
        for a, b, k in zip(c, c[1:], c[2:]):
            counts[a, b, k] += 50
    restorer = T.Restorer(np.log(counts / counts.sum(2, keepdims=True)))
    assert restorer.words("@$$") == restorer.words('"@$$."') == ["ass"]
    assert restorer.words("$") == restorer.words("...") == restorer.words("2262") == []


@pytest.fixture(scope="module")
def split_words(spark):
    """Scores by rules on a table where 'idiot', 'stupid', 'scum' and 'fool' are toxic, of texts that hide them."""
    plain = "some people say that you are not on time and it was a good day in the old town"
    docs = [(i, f"{plain} {bad} {plain} {i}") for i, bad in enumerate(["idiot", "stupid", "scum", "fool"] * 12)]
    docs += [(100 + i, f"{plain} {good} {plain} {i}") for i, good in enumerate(["table", "garden", "river", "the end"] * 12)]
    labels = [(i, int(i < 100)) for i, _ in docs]
    hidden = ["you i d i o t.", '"i d i o t', "i d i o t!", "'i d i o t'", "the s c u m, they", "you st up id.", '("st up id")', "s-c u-m", "f o ol", "you st up id"]
    docs += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, plain), (2001, "it is on me to do it as it was"), (2002, "12 345 67 8 9 10 11")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = T.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
    return hidden, {r.doc_id: r for r in rows}


def test_words_in_pieces_at_ends_of_sentences_and_in_quotes(split_words):
    hidden, rows = split_words
    assert [t for i, t in enumerate(hidden) if rows[1000 + i].score < 0.3] == []
    assert all(rows[i].score < 0.3 and not rows[i].rules for i in (2000, 2001, 2002))


def test_copies_of_a_long_toxic_text_do_not_push_out_other_rules(spark):
    letters = "bcdfghklmnprstvz"
    long = " ".join(f"{a}a{b}e{c}o{a}i" for a in letters[:11] for b in letters for c in letters[:10])  # 1,760 words
    plain = "it was a good day in the old town"
    docs = [(i, long) for i in range(30)]
    docs += [(100 + i, f"{plain} {'idiot' if i % 2 else 'garden'} {i}") for i in range(24)] + [(900, "what an idiot he was")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100 or i % 2)) for i, _ in docs if i < 900], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in T.score_toxicity(df, labels, F.lit(True)).collect()}
    assert rows[900].score >= 0.3
    assert rows[900].rules


def test_edges(spark):
    docs, labels = edge_rows.documents(spark), edge_rows.labels(spark)
    n = len(edge_rows.ROWS)
    for got in (T.score_toxicity(docs, labels, F.lit(True)), Q.score_quality(docs, labels, F.lit(True)), L.identify_language(docs, F.lit(True))):
        rows = got.collect()
        assert len(rows) == n
        assert all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 11}
    none, empty = edge_rows.labels(spark, []), edge_rows.documents(spark, [])
    assert {r.score for r in T.score_toxicity(docs, none, F.lit(True)).collect()} == {0.0}
    assert {r.score for r in Q.score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    assert {r.lang_pred for r in L.identify_language(docs, crc_mod("doc_id", 5) > 9).collect()} == {"und"}
    assert T.score_toxicity(empty, labels, F.lit(True)).count() == 0
    assert Q.score_quality(empty, labels, F.lit(True)).count() == 0
    assert L.identify_language(empty, F.lit(True)).count() == 0


def slow_phrases(symbols, train):
    """Greedy longest matches of substrings of ``train``, one character at a time."""
    train = "".join(map(chr, train))
    phrases, now = 1, ""
    for c in map(chr, symbols):
        if c != "\0" and now + c in train:
            now += c
        else:
            phrases += 1
            now = c if c != "\0" and c in train else ""
    return phrases


def test_phrases_by_the_slow_parse():
    """Whole texts, many times as long as a stream, and texts whose streams never meet."""
    rng = np.random.default_rng(6)
    samples = {"x": "abcabd abx", "y": "zzz yy", "z": " ".join("".join(rng.choice(list("abcdxyz"), 6)) for _ in range(60))}
    parser = L.CrossParser({k: [v] for k, v in samples.items()})
    texts = ["abcabdab", "zzzz", "ab cd ab", "Q", "abx " * 2900, "z" * 9000, "ab" * 5001, " ".join("".join(rng.choice(list("abcdxyz\U00010330"), 5)) for _ in range(2500)), samples["z"] * 30]
    bits, lettered = parser.entropies(texts)
    assert lettered.all()
    for row, text in zip(bits, texts):
        s = parser._squeezed(parser.symbol[L.folded(text)]).tolist()
        for k, lang in enumerate(parser.langs):
            train = parser._squeezed(parser.symbol[L.folded(samples[lang])]).tolist()
            assert row[k] == pytest.approx(slow_phrases(s, train) * parser.cost[k] / len(s)), (lang, text[:20])


def test_letters_beyond_the_basic_plane(spark):
    rows = [(1, "\U00010330\U00010331\U00010332 \U00010330", "got"), (2, "plain words", "en"), (3, "\U00010332\U00010331", None), (4, "\U00020000", None), (5, "\U0001f600 12", None)]
    got = {r.doc_id: r.lang_pred for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert got[3] == "got"
    assert got[4] in ("got", "en")
    assert got[5] == "und"


def test_languages_of_long_texts_alone_are_learned(spark):
    """A language whose texts are all longer than the bound gives stretches of them; many languages share the bound and none is lost."""
    en = ["the cat sat on the mat and the dog ran to the house", "this is the way that we go there", "with the other words of the", "and then they went home"]
    de = [" ".join(["der hund und die katze sind nicht im haus", "ich gehe mit dem kind durch die stadt"][i % 2] for i in range(1200)) for _ in range(4)]
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(10 + i, t, "de") for i, t in enumerate(de)] + [(20, "der hund ist nicht im haus", None), (21, "the dog went to the house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (40_000, 500):
        got = {r.doc_id: r.lang_pred for r in L.identify_language(df, F.lit(True), chars_per_language=size).collect()}
        assert [got[i] for i in (10, 11, 12, 13, 20, 21)] == ["de"] * 5 + ["en"]
    samples = L.training_texts(df, "lang", "text", "doc_id", 60, 40_000, chars_in_all=600)
    assert {k: sum(map(len, v)) for k, v in samples.items()} == {"de": 300, "en": sum(map(len, en))}


def test_large_alphabets_take_little_memory():
    rng = np.random.default_rng(1)
    samples = {k: ["".join(chr(c) for c in rng.integers(first, first + 3000, 20_000))] for k, first in (("x", 0x4E00), ("y", 0x6000))}
    parser = L.CrossParser(samples)
    assert parser.width > 5000
    assert parser.entries.nbytes + parser.base.nbytes < 20e6
    bits, _ = parser.entropies([samples["x"][0][100:400], samples["y"][0][5:50]])
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1
