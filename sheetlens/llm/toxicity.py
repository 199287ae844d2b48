"""Toxicity by noisy-channel deobfuscation.

A token that hides something (digits or signs among letters, a letter three times or more) and a run
of two or more tokens of at most ``FRAGMENT`` characters, not counting signs around them, become a
lattice: each character is itself, a letter it may stand for, or nothing, and each space may be
nothing. Viterbi decodes the lattice under a character trigram model whose counts come from all
documents. Long or starred lattices are decoded by matrix steps over all pairs of letters, and a run of one sign counts only as often as a
best path can use it, so a token's cost is in proportion to its length; nothing of it is cut. Restored words, and words that hide nothing, are matched against rules. A token of signs alone,
some of them no digits, is read as a word if the model finds the word likelier than letters by chance
(digits alone are a number). When texts are scored, each part of a run that spells a rule is decoded by itself, so words beside it
do not matter. Pieces of more than ``FRAGMENT`` characters are not joined.

Rules are learned from labelled texts: a rule is a word, or the first letters of a word, that
stands in toxic texts and hardly ever in others. They are chosen greedily, each to cover the most
toxic texts that the rules before it leave (a text is left until ``COVERS`` rules cover it), so words
that only keep company with true rules are hardly taken. A text's score is ``1 - product(1 - p)`` over the rules it holds, with p the smoothed
share of toxic texts; without any it is the share among the sample's texts without any.

``sample`` bounds the labelled rows that the rules are fitted on, and so the candidates for rules; each distinct
text of the sample counts once. The character counts and the scores cover all rows.

Defined results: null and empty texts get the score of a text without rules. Without labelled
rows every score is 0. Rows are scored one by one: repeated rows get equal scores, and other
columns are not read. A row labelled both ways counts as toxic.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce
from heapq import heapify, heappop, heappush
from operator import or_

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_tasks, labelled_sample, map_rows

#: Letters that a sign may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PREFIXES = (4, 5, 6, 7)
#: A toxic text asks for rules until so many cover it, so that a word is learned that seldom stands alone.
COVERS = 4
#: Tokens of at most so many characters may be pieces of one word.
FRAGMENT = 3
EDGE = " .,;:?\"'()[]{}«»“”‘’…-_*#%&=<>/\\~^`"
TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
#: Signs around a word that stand for no letter.
SIGNS = EDGE.replace("(", "")


def letter_class(c: str) -> int:
    """1-26 for a letter without its accent, 0 for anything else."""
    at = LETTERS.find(unicodedata.normalize("NFKD", c)[0])
    return at + 1


_CLASS = None


def class_table() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        _CLASS = np.zeros(0x10000, np.int32)
        for c in range(0x250):
            _CLASS[c] = letter_class(chr(c).lower()) if chr(c).isalpha() else 0
    return _CLASS


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(third | first two) over 27 classes, from the trigram counts of all documents."""

    def make():
        table, counts = class_table(), np.zeros(27**3, np.int64)

        def take(cols):
            texts = [t for t in cols["text"] if t]
            if not texts:
                return
            c = table[np.minimum(np.frombuffer(("\0\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
            grams = (c[:-2] * 27 + c[1:-1]) * 27 + c[2:]
            last = 1 + np.cumsum([len(t) + 2 for t in texts[:-1]]) - 2  # a text's last letter and the two spaces after it are no trigram
            counts[:] += np.bincount(grams, minlength=27**3)
            if len(last):
                counts[:] -= np.bincount(grams[last.astype(int)], minlength=27**3)

        def result():
            at = np.flatnonzero(counts)
            return {"gram": at.tolist(), "n": counts[at].tolist()}

        return take, result

    rows = fold_tasks(docs.select(F.col(text).cast("string").alias("text")), make, "gram int, n long")
    counts = np.zeros(27**3)
    for gram, n in rows.groupBy("gram").agg(F.sum("n")).collect():  # at most 27^3 rows
        counts[gram] = n
    counts = counts.reshape(27, 27, 27)
    two = counts.sum(0)
    backed = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
    return np.log((counts + 20 * backed[None]) / (counts.sum(2, keepdims=True) + 20))


class Restorer:
    """Token -> restored words, remembered for each distinct token."""

    #: Lattices of up to so many characters with up to one star are decoded state by state, others by matrix steps.
    SMALL = 32
    #: After so many steps the paths of all states are traced back to the point that they share.
    SETTLE = 4096

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.cost = -np.asarray(model)
        self.useful: dict[str, int] = {}

    def words(self, token: str) -> list[str]:
        token = token.lower()
        if token.isalpha() and not self.repeats(token):
            return [token]
        core = token.strip(EDGE)
        if core.isalpha() and not self.repeats(core):
            return [core]
        core = token.strip(SIGNS)
        if not any(c.isalpha() for c in core):
            signs = [c for c in core if c in LEET]
            if len(signs) < 2 or all(c.isdigit() for c in signs):
                return []
            return [w for w in self.decode(core, True).split() if self.likely(w)]
        return self.decode(core).split()

    def likely(self, word: str) -> bool:
        """Whether the model finds a word likelier than letters by chance."""
        a, b, cost = 0, 0, 0.0
        for k in (*map(letter_class, word), 0):
            cost -= self.model[a][b][k]
            a, b = b, k
        return cost < (len(word) + 1) * np.log(27)

    @staticmethod
    def repeats(token: str) -> bool:
        return TRIPLE.search(token) is not None

    def options(self, text: str, i: int, signs: bool = False) -> list[tuple[str, float]]:
        """What the character at ``i`` may be, with costs: '' is nothing, ' ' a word's end. With ``signs``, each sign is a letter."""
        c = text[i]
        if c.isalpha():
            run = i >= 1 and text[i - 1] == c and (i >= 2 and text[i - 2] == c or text[i + 1 : i + 2] == c)
            return [(c, 0.0), ("", 0.3)] if run else [(c, 0.0)]
        found = [(x, 1.0) for x in LEET.get(c, "")]
        if signs and found:
            return found
        if c == "*":
            found += [(x, 3.0) for x in LETTERS]
        if c.isspace():
            return [("", 0.0), (" ", 0.0)]
        return [*found, ("", 1.5 if found else 0.2), (" ", 3.0)]

    def decode(self, text: str, signs: bool = False) -> str:
        """The best path of the character lattice, by Viterbi over the last two letters."""
        if len(text) <= self.SMALL and text.count("*") < 2:
            return self.decode_small(text, signs)
        return self.decode_large(self.shortened(text), signs)

    def decode_small(self, text: str, signs: bool = False) -> str:
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(text)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self.options(text, i, signs)
            for (a, b), (cost, path) in best.items():
                for out, extra in options:
                    if not out:
                        key, total, way = (a, b), cost + extra, path
                    else:
                        k = letter_class(out)
                        if out == " " and not b:
                            continue
                        key, total, way = (b, k), cost + extra - self.model[a][b][k], (out, path)
                    if key not in new or total < new[key][0]:
                        new[key] = (total, way)
            best = new
        path = min(((cost - self.model[a][b][0], way) for (a, b), (cost, way) in best.items()), key=lambda x: x[0])[1]
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def shortened(self, text: str) -> str:
        """The text without those signs of a run of one sign that no best path uses: each is nothing, at the same cost for all paths."""
        return re.sub(r"([^\w\s]|\d)\1{15,}", lambda m: m.group()[: max(16, self.most_used(m.group(1)))], text)

    def most_used(self, sign: str) -> int:
        """How many letters a best path can take from a run of a sign: beyond, three that lead to the same state are cheaper."""
        if sign not in self.useful:
            options = dict(self.options(sign, 0))
            nothing = options.pop("")
            low = min(extra - nothing + self.cost[:, :, letter_class(out)].min() for out, extra in options.items())
            high = max(extra - nothing + self.cost[:, :, letter_class(out)].max() for out, extra in options.items())
            self.useful[sign] = int(3 * high / low) + 1 if low > 0 else 1 << 62
        return self.useful[sign]

    def decode_large(self, text: str, signs: bool = False) -> str:
        best = np.full((27, 27), np.inf)
        best[0, 0] = 0.0
        back: list[np.ndarray] = []  # by new state: the letter before its two, or -1 where the character is nothing
        outs: list[dict[int, str]] = []
        done: list[str] = []

        def trace(a: int, b: int, upto: int) -> list[str]:
            found = []
            for i in range(upto - 1, -1, -1):
                if (before := int(back[i][a, b])) >= 0:
                    found.append(outs[i][b])
                    a, b = before, a
            return found[::-1]

        for i in range(len(text)):
            options = [(letter_class(out), out, extra) for out, extra in self.options(text, i, signs) if out]
            nothing = [extra for out, extra in self.options(text, i, signs) if not out]
            k = [c for c, _, _ in options]
            ways = best[:, :, None] + self.cost[:, :, k] + np.array([extra for _, _, extra in options])
            for j, (_, out, _) in enumerate(options):
                if out == " ":
                    ways[:, 0, j] = np.inf
            new, source = np.full((27, 27), np.inf), np.full((27, 27), -1, np.int8)
            new[:, k], source[:, k] = ways.min(0), ways.argmin(0)
            if nothing:
                kept = best + nothing[0]
                source[kept <= new] = -1
                new = np.minimum(new, kept)
            best = new
            back.append(source)
            outs.append({c: out for c, out, _ in options})
            if len(back) >= self.SETTLE and len(back) % self.SETTLE == 0:
                a, b = np.nonzero(np.isfinite(best))
                for at in range(len(back) - 1, -1, -1):
                    before = back[at][a, b].astype(np.int64)
                    a, b = np.where(before >= 0, before, a), np.where(before >= 0, a, b)
                    if (a == a[0]).all() and (b == b[0]).all():
                        done += trace(int(a[0]), int(b[0]), at)
                        back, outs = back[at:], outs[at:]
                        break
        a, b = divmod(int((best + self.cost[:, :, 0]).argmin()), 27)
        return "".join(done + trace(a, b, len(back)))


def features(words: list[str]) -> set[str]:
    """Each word, and ``first letters`` + ``*`` of longer words."""
    return {f for w in words for f in (w, *(w[:k] + "*" for k in PREFIXES if len(w) > k))}


class Memo(dict):
    """A dict that computes what it lacks, emptied when it has grown large."""

    def __init__(self, make, limit: int = 100_000):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def piece_of(token: str) -> tuple[str, int]:
    """A token in lower case without the signs around it that are no letters, and its size without any signs around it."""
    token = token.lower()
    piece = token.strip(SIGNS) or ("*" if token == "*" else "")
    return piece, len(piece.strip(EDGE + "!")) or min(len(piece), 1)


#: The pieces of tokens met before.
PIECES = Memo(piece_of)


def spaced(tokens: list[str], longest: int = 1) -> list[str]:
    """Runs of two or more pieces of at most ``longest`` characters, not counting signs around them, with spaces between."""
    runs, at = [], 0
    small = [i for i, w in enumerate(tokens) if PIECES[w][1] <= longest]
    while at < len(small):
        end = at + 1
        while end < len(small) and small[end] == small[end - 1] + 1:
            end += 1
        if end - at >= 2:
            run = [p for p, _ in map(PIECES.__getitem__, tokens[small[at] : small[end - 1] + 1]) if p]
            if len(run) >= 2:
                runs.append(" ".join(run))
        at = end
    return runs


def runs_of(tokens: list[str]) -> set[str]:
    """Runs of pieces of at most ``FRAGMENT`` characters, and the runs of single characters in them."""
    wide = spaced(tokens, FRAGMENT)
    return {*wide, *(run for w in wide for run in spaced(w.split()))}


def hides(run: str) -> bool:
    """Whether a run has more to restore than its spaces."""
    return not run.replace(" ", "").isalpha() or Restorer.repeats(run)


def spelled(run: str, stems: re.Pattern, names: frozenset[str] | set[str]) -> set[str]:
    """Parts of a run that spell a rule from the beginning of a piece: up to the end of a piece, or beyond for first letters.

    ``stems`` finds a rule's letters at any place; a rule never begins with another.
    """
    tokens = run.split()
    pieces = [p if p.isalpha() else "\0" for p in (w.strip(EDGE + "!") for w in tokens)]
    starts, at = {}, 0
    ends = []
    for i, piece in enumerate(pieces):
        starts[at] = i
        at += len(piece)
        ends.append(at)
    found = set()
    for m in stems.finditer("".join(pieces)):
        first, stem = starts.get(m.start()), m.group(1)
        if first is None:
            continue
        last = first
        while ends[last] < m.start() + len(stem):
            last += 1
        lasts = {last} if stem in names and ends[last] == m.start() + len(stem) else set()
        if stem + "*" in names:  # one letter more at least
            last += ends[last] == m.start() + len(stem)
            lasts |= {k for k in (last, last + 1, last + 2, len(tokens) - 1) if k < len(tokens)}
        found |= {" ".join(tokens[first : k + 1]) for k in lasts if k > first}
    return found


def may_join(token: str) -> int:
    """1 for a token that can be a piece of a word in pieces and has more to restore than spaces, else 0."""
    piece, size = piece_of(token)
    return int(size <= FRAGMENT and piece != "" and (not piece.isalpha() or Restorer.repeats(piece)))


#: White space and the signs around pieces, so that the letters of pieces in a row stand together without them.
BETWEEN = re.compile("[\\s" + re.escape(EDGE + "!") + "]+")


def feature_memos(model: np.ndarray) -> tuple[Memo, Memo]:
    """The features of tokens, and of runs of pieces."""
    restorer = Restorer(model)
    return Memo(lambda w: frozenset(features(restorer.words(w))), 20_000), Memo(lambda run: frozenset(features(restorer.decode(run).split())), 20_000)


def text_features(memo: Memo, runs: Memo, text: str) -> set[str]:
    tokens = text.split()
    found = set().union(*map(memo.__getitem__, set(tokens)))
    return found.union(*map(runs.__getitem__, runs_of(tokens)))


def learn_rules(sample: DataFrame, model: np.ndarray, least: int = 3, purity: float = 0.7) -> tuple[dict[str, float], float]:
    """Rules with their share of toxic texts, and the share among texts that no rule covers; ``sample`` are distinct texts."""
    def make():
        memos = feature_memos(model)

        def count(cols):
            counts = Counter()
            for t, y in zip(cols["text"], cols["label"], strict=True):
                counts.update((f, y) for f in text_features(*memos, t))
            return {"feature": [f for f, _ in counts], "label": [y for _, y in counts], "n": list(counts.values())}

        return count

    counted = map_rows(sample, make, "feature string, label int, n long", rows=500).groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    # a gain below ``least`` at the start never rises
    pure = (F.col("bad") >= purity * F.col("n")) & (F.col("bad") - 2 * (F.col("n") - F.col("bad")) >= least)
    top = counted.where(pure).orderBy(F.desc("bad"), F.length("feature"), "feature").collect()  # words of at least ``least`` rows of the sample
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    names = [r["feature"] for r in top]
    number = {f: i for i, f in enumerate(names)}
    clean = {r["feature"]: r["n"] - r["bad"] for r in top}

    def make_rows():
        memos = feature_memos(model)
        return lambda cols: {"held": [sorted(number[f] for f in text_features(*memos, t) & number.keys()) for t in cols["text"]]}

    rows = [r[0] for r in map_rows(sample.where("label = 1"), make_rows, "held array<int>").collect()]  # at most the sample's toxic rows
    covers: list[set[int]] = [set() for _ in names]
    for i, held in enumerate(rows):
        for f in held:
            covers[f].add(i)
    prior = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    need, rules = dict.fromkeys(range(len(rows)), COVERS), {}
    stems: list[str] = []
    # gains only fall, so the first candidate whose gain is still what it was is the best
    queue = [(2 * clean[name] - len(covers[f]), f) for f, name in enumerate(names)]
    heapify(queue)
    while queue:
        was, best = heappop(queue)
        stem = names[best].rstrip("*")
        # words and prefixes of one family say the same
        if any(s.startswith(stem) or stem.startswith(s) for s in stems):
            continue
        gain = sum(i in need for i in covers[best]) - 2 * clean[names[best]]
        if gain < least:
            continue
        if gain < -was:
            heappush(queue, (-gain, best))
            continue
        bad = len(covers[best])
        rules[names[best]] = (bad + prior) / (bad + clean[names[best]] + 1)
        stems.append(stem)
        for i in covers[best] & need.keys():
            need[i] -= 1
            if not need[i]:
                del need[i]
    held = {i for f, name in enumerate(names) if name in rules for i in covers[f]}
    rest = len(rows) - len(held)
    return rules, rest / max(1, sum(total.values()) - len(held))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 16_000):
    """A task's scorer: called once in each task, it gives the function from ``text`` to ``score`` and ``rules``.

    ``usable`` says of a row of ``labels`` whether its label may be learned from.
    """
    model = character_model(docs, text)
    rules, rest = learn_rules(labelled_sample(docs, labels, label, usable, sample, doc_id=doc_id, text=text), model)
    names = sorted(rules)
    bit = {f: 1 << i for i, f in enumerate(names)}
    stems = re.compile("(?=(" + "|".join(sorted({re.escape(f.rstrip("*")) for f in names})) + "))") if names else None

    spelt = ahocorasick.Automaton()
    for f in names:
        spelt.add_word(f.rstrip("*"), 1)
    spelt.make_automaton()

    def make():
        restorer = Restorer(model)
        bits = lambda words: reduce(or_, (bit.get(f, 0) for f in features(words)), 0)
        heads = {f.rstrip("*")[:3] for f in names}

        def look(token: str) -> int:
            """Rules of a token; the lowest bit is no rule, but says that runs with it are to be looked at."""
            core = token.lower()
            if not core.isalpha():
                core = core.strip(EDGE)
            if not core.isalpha() or TRIPLE.search(core):
                return bits(restorer.words(token)) << 1 | may_join(token)
            held = bits([core]) << 1 if core[:3] in heads else 0
            return held if len(core) > FRAGMENT else held | may_join(token)

        memo = Memo(look)

        def joined(run: str) -> int:
            parts = spelled(run, stems, bit.keys())
            if hides(run):
                parts.add(run)
            return reduce(or_, (bits(restorer.decode(part).split()) for part in parts), 0)

        runs = Memo(joined, 50_000)

        def found(mask: int) -> tuple[float, list[str]]:
            held = [f for f in names if mask & bit[f]]
            return (1 - float(np.prod([1 - rules[f] for f in held])) if held else rest), held

        outcome = Memo(found)

        def score(cols):
            out = {"doc_id": cols["doc_id"], "score": [], "rules": []}
            for t in cols["text"]:
                tokens = (t or "").split()
                seen = reduce(or_, set(map(memo.__getitem__, tokens)), 0)
                mask = seen >> 1
                # no run of pieces spells a rule unless its letters stand together in the text, and none is decoded unless a piece hides something
                if names and (seen & 1 or next(spelt.iter(BETWEEN.sub("", t.lower())), None) if t else False):
                    for run in runs_of(tokens):
                        mask |= runs[run]
                value, held = outcome[mask]
                out["score"].append(value)
                out["rules"].append(held)
            return out

        return score

    make.fitted = model, rules, rest
    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 16_000) -> DataFrame:
    """doc_id, score (0 to 1) and the rules found in every whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, fit_toxicity(docs, labels, usable, doc_id, text, label, sample), f"doc_id {kind}, score double, rules array<string>")
