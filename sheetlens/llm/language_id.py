"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text recognises every substring of that text.
A document is parsed greedily into the longest matches that the automaton allows: from the root,
follow characters until none fits, count a phrase, begin anew. Text in the automaton's language
falls into few long phrases. The count, multiplied by log2 of the sample's length (the cost of
naming a phrase) and divided by the number of characters, is the cross-parsing entropy; the
language with the least wins. The score is ``1 - least / second least``.

The transitions of all automata share one array: a state's are stored at its own base plus the symbol, where no other state's are, each with the state it
belongs to. So the array has about as many entries as there are transitions, however many characters the languages have. Thousands of texts advance through it
together, a character a step. So that a long text needs no more steps than others, it is parsed in several places
side by side: its streams begin every ``CHUNK`` characters and run ``OVER`` characters into the next one's. From the first character after which two
streams are in the same state of the automaton they are one and the same parse, so there the later stream takes over, and the phrases are those of
the whole text's parse. Where two streams do not meet, one stream parses the whole text.

Training texts are a sample: for each language at most ``chars_per_language`` characters, of about
``docs_per_language`` rows, chosen by a seeded hash; of a text that does not fit, a stretch is taken. Where a column holds so many languages that they would
have more than ``chars_in_all`` characters together, each has its share of these, ``LEAST_CHARS`` at least, so that every language is learned.
These parameters bound the automata and what is broadcast. Everything else reads all rows.

Defined results: a null text, or one without letters, gives ``und`` and score 0, as does every
text when no labelled text is left to learn from. With one language learned, that one wins with score 1.
Equal entropies go to the language that sorts first. Rows are handled one by one: repeated rows get
equal results, and other columns are not read. Characters that no training text holds end a
phrase in every language.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, map_rows

CHUNK = 2048
OVER = 256
STREAMS = 4096
#: What a language gets at least, however many there are.
LEAST_CHARS = 200
#: Symbols: a letter that no training text holds, and anything that is no letter.
UNKNOWN, OUTSIDE = 0, 1
_LETTER = None


def letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (online construction)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p != -1:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(s) == q:
                    step[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def packed(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, entries): the transition of state q by symbol s is entry base[q] + s, as q in the upper and its target in the lower 32 bits; -1 where there is none."""
    base, used, at = np.zeros(len(rows), np.int64), bytearray(2 * width + 2 * sum(map(len, rows))), width
    entries: dict[int, int] = {}
    for q in sorted(range(len(rows)), key=lambda q: -len(rows[q])):
        symbols = sorted(rows[q])
        if not symbols:
            continue
        place, tries = at, 0
        while True:
            place = used.find(0, place)
            if place < 0 or place + width >= len(used):
                used += bytes(len(used))
                place = used.find(0, at)
            start = place - symbols[0]
            if all(not used[start + s] for s in symbols):
                break
            place, tries = place + 1, tries + 1
        if tries > 50:  # what lies before is nearly full
            at = place
        elif len(symbols) == 1:
            at = place + 1
        base[q] = start
        for s in symbols:
            used[start + s] = 1
            entries[start + s] = q << 32 | rows[q][s]
    out = np.full(max(entries, default=0) + 2 * width + 1, -1, np.int64)
    out[np.fromiter(entries, np.int64, len(entries))] = np.fromiter(entries.values(), np.int64, len(entries))
    return base, out


class CrossParser:
    """The automata of all languages in one table; parses many texts at a time."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        points = {lang: [folded(t) for t in samples[lang]] for lang in self.langs}
        letter = self.letter = letters()
        seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *(p for ps in points.values() for p in ps)]))
        seen = seen[letter[seen]]
        #: symbol of each code point: those above, then the letters seen
        self.symbol = np.where(letter, UNKNOWN, OUTSIDE).astype(np.int32)
        self.symbol[seen] = np.arange(2, 2 + len(seen))
        self.width = 2 + len(seen)
        rows, self.roots, self.cost = [], [], []
        for lang in self.langs:
            # an unknown letter stands between texts, so that no match runs from one to the next
            symbols = [s for p in points[lang] for s in [*self._squeezed(self.symbol[p]).tolist(), UNKNOWN]]
            automaton = suffix_automaton(symbols)
            at = len(rows)
            rows += [{c: to + at for c, to in out.items() if c != UNKNOWN} for out in automaton]
            self.roots.append(at)
            self.cost.append(math.log2(2 + len(symbols)))
        self.base, self.entries = packed(rows, self.width)

    @staticmethod
    def _squeezed(symbols: np.ndarray) -> np.ndarray:
        """Runs of non-letters become one."""
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != OUTSIDE) | (symbols[:-1] != OUTSIDE)
        return symbols[keep]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) bits a character, and which texts hold a letter."""
        n, k = len(texts), len(self.langs)
        points = [folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        lettered = np.array([bool(self.letter[p].any()) for p in points], bool)
        if not k:
            return np.zeros((n, 0)), lettered
        whole = {i: self._squeezed(self.symbol[p]) for i, p in enumerate(points) if lettered[i]}
        length = np.array([len(whole.get(i, ())) for i in range(n)])
        streams, owner = [], []
        for i, s in whole.items():
            for at in range(0, len(s), CHUNK):
                streams.append(s[at : at + CHUNK + OVER])
                owner.append(i)
        phrases = np.zeros((k, n), np.int64)
        follows = [c + 1 < len(owner) and owner[c + 1] == owner[c] for c in range(len(owner))]
        counted, seen = self._parsed(streams, [f or c > 0 and follows[c - 1] for c, f in enumerate(follows)])
        apart = set()
        for c, i in enumerate(owner):
            phrases[:, i] += counted[c]
            if follows[c]:
                # what both streams saw of the stretch that they share; the later one counts after the first state in common
                (mine, ends), (later, began) = seen[c][1], seen[c + 1][0]
                m = min(mine.shape[1], later.shape[1])
                same = mine[:, :m] == later[:, :m]
                if not same.any(1).all():
                    apart.add(i)
                at = same.argmax(1)
                phrases[:, i] -= [int(e[x + 1 :].sum() + b[: x + 1].sum()) for e, b, x in zip(ends, began, at, strict=True)]
                phrases[:, i] -= 1  # the phrase that the later stream begins with
        if apart:
            whole_counts = self._parsed([whole[i] for i in sorted(apart)], [False] * len(apart))[0]
            for i, found in zip(sorted(apart), whole_counts, strict=True):
                phrases[:, i] = found
        return phrases.T * np.array(self.cost) / np.maximum(length, 1)[:, None], lettered

    def _parsed(self, streams: list[np.ndarray], marked: list[bool]) -> tuple[list[np.ndarray], list]:
        """Phrases of each stream by language, and for marked streams what ``_advance`` saw at their beginning and end."""
        counted: list = [None] * len(streams)
        seen: list = [None] * len(streams)
        order = sorted(range(len(streams)), key=lambda c: -len(streams[c]))
        for at in range(0, len(order), STREAMS):
            part = order[at : at + STREAMS]
            found, head, tail = self._advance([streams[c] for c in part], sum(marked[c] for c in part) > 0)
            for j, c in enumerate(part):
                counted[c] = found[:, j]
                if marked[c]:
                    size = len(streams[c])
                    seen[c] = [tuple(x[:, : max(0, min(OVER, size - first)), j] for x in place) for place, first in ((head, 0), (tail, CHUNK))]
        return counted, seen

    def _advance(self, streams: list[np.ndarray], marked: bool) -> tuple[np.ndarray, tuple | None, tuple | None]:
        """Phrases of each stream (longest first) in each language; if ``marked``, also the states and the phrases' ends in the first ``OVER`` steps and in those after ``CHUNK``."""
        k, n = len(self.langs), len(streams)
        sizes = np.array([len(c) for c in streams])
        grid = np.zeros((n, int(sizes[0])), np.int32)
        for i, c in enumerate(streams):
            grid[i, : len(c)] = c
        grid = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-sizes, -np.arange(len(grid)), "left")  # streams longer than each step
        root = np.array(self.roots, np.int32)
        again = self.entries[self.base[root][:, None] + np.arange(self.width)]  # (languages, symbols): where the root leads
        again = np.where(again >> 32 == root[:, None], again & 0xFFFFFFFF, root[:, None]).astype(np.int32)
        state = np.repeat(root[:, None], n, 1)
        count = np.ones((k, n), np.int64)
        head, tail = ((np.zeros((k, OVER, n), np.int32), np.zeros((k, OVER, n), bool)) if marked else None for _ in range(2))
        for step, m in enumerate(live):
            if m < state.shape[1]:
                state = np.ascontiguousarray(state[:, :m])
            s = grid[step, :m]
            to = self.entries.take(self.base.take(state) + s)
            ends = (to >> 32) != state
            to = (to & 0xFFFFFFFF).astype(np.int32)
            count[:, :m] += ends
            np.copyto(to, again.take(s, 1), where=ends)
            state = to
            if marked and (step < OVER or CHUNK <= step < CHUNK + OVER):
                states, flags = head if step < OVER else tail
                states[:, step % CHUNK, :m], flags[:, step % CHUNK, :m] = state, ends
        return count, head, tail


_PARSERS: dict[str, CrossParser] = {}


def training_texts(rows: DataFrame, lang: str, text: str, key: str, docs_per_language: int, chars_per_language: int, chars_in_all: int = 2_000_000) -> dict[str, list[str]]:
    """Distinct texts by language, in the order of their ids' hash, up to the bound; of a text that does not fit, a stretch."""
    known = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.col(key).cast("string").alias("k"))
    counts = known.groupBy("l").count().collect()  # one row a language: each is learned
    if not counts:
        return {}
    most = min(chars_per_language, max(LEAST_CHARS, chars_in_all // len(counts)))
    n = F.try_element_at(F.create_map(*(F.lit(x) for value, n in counts for x in (value, float(n)))), F.col("l"))
    start = F.pmod(F.xxhash64("k"), F.greatest(F.length("t") - most, F.lit(0)) + 1) + 1
    picked = known.where(hash_unit(F.struct("k", "t"), 8) * n < F.lit(float(docs_per_language))).withColumn("t", F.substring("t", start, F.lit(most)))
    out: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in sorted(picked.groupBy("l", "t").agg(F.min(F.xxhash64("k")).alias("h")).collect(), key=lambda r: (r[0], r.h, r.t)):
        left = room.setdefault(r[0], most)
        if left:
            out.setdefault(r[0], []).append(r.t[:left])
            room[r[0]] -= len(r.t[:left])
    return out


def identify_language(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 60, chars_per_language: int = 40_000
) -> DataFrame:
    """doc_id, lang_pred, score and the bits a character of every text; labels come from rows where ``learn_from`` holds."""
    samples = training_texts(docs.where(learn_from), lang, text, doc_id, docs_per_language, chars_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    name = hashlib.md5(repr(sorted(samples.items())).encode()).hexdigest()

    def make():
        if name not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[name] = CrossParser(shared.value)
        parser = _PARSERS[name]

        def predict(cols):
            bits, lettered = parser.entropies(cols["text"])
            out = {"doc_id": cols["doc_id"], "lang_pred": [], "score": [], "bits": []}
            for b, ok in zip(bits.tolist(), lettered.tolist(), strict=True):
                if not ok or not b:
                    pred, score, least = "und", 0.0, None
                else:
                    least, pred = min(zip(b, parser.langs, strict=True))
                    others = sorted(b)[1:]
                    score = 1 - least / others[0] if others and others[0] > 0 else 1.0
                for key, v in (("lang_pred", pred), ("score", score), ("bits", least)):
                    out[key].append(v)
            return out

        return predict

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, lang_pred string, score double, bits double")
