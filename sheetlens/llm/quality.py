"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its frequent words, the shapes of its words (letters, capitals, digits and
signs) and how often a word repeats the one before it. Term counts are damped, weighted by an
inverse document frequency counted over all documents, and projected by a singular value
decomposition of the labelled sample. The labelled vectors are broadcast; each block of documents
is multiplied with all of them, which gives exact cosines. The ``neighbours`` nearest (and all
tied with the last) vote with their label, weighted by a power of the similarity.

``sample`` bounds the labelled texts (each distinct one counts once), ``terms`` the vocabulary and ``dimensions`` the vectors, so
what is broadcast does not grow with the corpus. A term stands in at least ``least_texts`` texts of the sample.

Defined results: a text without terms (null, empty) gets the share of label 1 in the sample; with no
labelled rows every score is 0.5. Rows are scored one by one: repeated rows get equal scores, and
other columns are not read. A row labelled both ways counts as label 1.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_tasks, labelled_sample, map_rows

REPEAT = "=again"


def shape_of(word: str) -> str:
    """``~`` and the word with runs of letters as a (A if all are capitals), digits as 0, other signs once."""
    core, end = (word, "") if word.isalpha() else (word[:-1], word[-1:])
    if core.isalpha() and not end.isalnum():  # most words need no pattern
        return ("~A" if core.isupper() and len(core) > 1 else "~a") + end
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "a", word)
    return "~" + re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", s))


class Terms:
    """Counts of known terms; each distinct word is looked at once."""

    LIMIT = 200_000

    def __init__(self, names: list[str]):
        self.number = {t: i for i, t in enumerate(names)}
        self.width = len(names) + 1  # the last column takes what is not known
        self.seen: dict[str, tuple[int, int, int]] = {}

    def _look(self, word: str) -> int:
        """Number of the word's term and its shape's term, in one integer."""
        if len(self.seen) >= self.LIMIT:
            self.seen.clear()
        last = self.width - 1
        code = self.number.get(word.lower(), last) * self.width + self.number.get(shape_of(word), last)
        self.seen[word] = code
        return code

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        again = self.number.get(REPEAT, self.width - 1)
        seen, look = self.seen, self._look
        for i, t in enumerate(texts):
            words = (t or "").split()
            if not words:
                continue
            code = np.array([seen[w] if w in seen else look(w) for w in words])
            out[i] = np.bincount(code // self.width, minlength=self.width) + np.bincount(code % self.width, minlength=self.width)
            out[i, again] += sum(map(str.__eq__, words, words[1:]))
        return out[:, :-1]


def vocabulary(sample: DataFrame, terms: int, least_texts: int) -> list[str]:
    """The terms that stand in most texts of the sample: a third shapes, the rest words."""

    def make():
        words: Counter = Counter()

        def take(cols):
            for t in cols["text"]:
                w = set(t.split())
                words.update({x.lower() for x in w})
                words.update({shape_of(x) for x in w})

        return take, lambda: {"term": list(words), "n": list(words.values())}

    counted = fold_tasks(sample, make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_texts)
    top = lambda shapes, k: [r[0] for r in counted.where(F.col("term").startswith("~") == F.lit(shapes)).orderBy(F.desc("n"), "term").limit(k).collect()]
    return [REPEAT, *top(True, terms // 3), *top(False, terms - terms // 3)]


def document_frequency(docs: DataFrame, names: list[str], text: str) -> tuple[np.ndarray, int]:
    """Of all documents, how many hold each term."""

    def make():
        terms, total = Terms(names), np.zeros(len(names) + 1, np.int64)

        def take(cols):
            total[:-1] += (terms.counts(cols["text"]) > 0).sum(0)
            total[-1] += len(cols["text"])

        return take, lambda: {"term": list(range(len(total))), "n": total.tolist()}

    got = dict(fold_tasks(docs.select(F.col(text).cast("string").alias("text")), make, "term int, n long", rows=500).groupBy("term").agg(F.sum("n")).collect())
    return np.array([got.get(i, 0) for i in range(len(names))]), got.get(len(names), 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(counts) * idf)


def fit_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = 6000, terms: int = 900, dimensions: int = 48, neighbours: int = 15, power: int = 8, least_texts: int = 3,
):
    """A task's scorer: called once in each task, it gives the function from ``text`` to ``score``.

    ``usable`` says of a row of ``labels`` whether its label may be learned from.
    """
    known = labelled_sample(docs, labels, label, usable, sample, doc_id=doc_id, text=text)
    names = vocabulary(known, terms, least_texts)
    df, n = document_frequency(docs, names, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1

    def make_sample():
        t = Terms(names)

        def rows(cols):
            x = t.counts(cols["text"])
            return {"label": cols["label"], "term": [np.flatnonzero(r).tolist() for r in x], "n": [r[r > 0].tolist() for r in x]}

        return rows

    got = map_rows(known, make_sample, "label int, term array<int>, n array<float>", rows=500).collect()  # at most the sample
    x = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        x[i, r.term] = r.n
    y = np.array([r.label for r in got], np.float32)
    x = weighted(x, idf)
    _, basis = np.linalg.eigh(x.T.astype(float) @ x)
    basis = np.ascontiguousarray(basis[:, ::-1][:, :dimensions], dtype=np.float32)
    base = float(y.mean()) if len(y) else 0.5
    k = min(neighbours, len(y))
    shared = docs.sparkSession.sparkContext.broadcast((names, idf, basis, unit(x @ basis), y))  # bounded by the parameters

    def make():
        names, idf, basis, vectors, y = shared.value
        t = Terms(names)

        def score(cols):
            p = np.full(len(cols["text"]), base)
            v = weighted(t.counts(cols["text"]), idf) @ basis
            some = np.flatnonzero(np.linalg.norm(v, axis=1) > 1e-9)
            if k and len(some):
                cos = np.round(unit(v[some]) @ vectors.T, 5)
                nearest = np.partition(cos, len(y) - k, axis=1)[:, len(y) - k : len(y) - k + 1]
                w = np.where(cos >= nearest, np.maximum(cos, 1e-3) ** power, 0)
                p[some] = (w @ y) / w.sum(1)
            return {"doc_id": cols["doc_id"], "score": np.clip(p, 0, 1).tolist()}

        return score

    make.space = names, idf, basis, got
    return make


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **parameters) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; ``parameters`` are those of ``fit_quality``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, fit_quality(docs, labels, usable, doc_id, text, label, **parameters), f"doc_id {kind}, score double", rows=500)
