"""Licence scans by a positional rare-token index.

Templates are short licence notices. Every template word has postings ``(template, position)``.
The words of the templates get an inverse document frequency counted over all documents. In a file, its licence
words are looked up by falling IDF until each template has met the ``rare`` highest of the words that it shares with the
file (all, if they are fewer). Each occurrence of a looked-up word puts its template at a start, ``occurrence - position``.
These starts are intersected: one is accepted if at least ``agree`` of the template's looked-up words put it there (all words of a
template that has fewer), so a notice's words that stand scattered, or a short mention, name no licence. An accepted start
gives its label if the template's mandatory key phrase stands at its place, word by word. The score is the largest
share of a labelled template's words that stand at their places.

Phrases whose every place counts are found beside this, exactly: each is anchored at its rarest word, and every occurrence of a
phrase holds that word. They give the base labels.

Defined results: null and empty texts have no words, no places, empty labels and score 0. Base labels give a score of
at least 0.5. Rows are scored one by one, so repeated rows, ties and other columns change nothing; an empty table
gives an empty result. A word that no document holds gets the highest IDF; equal IDFs are taken in the order of the words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Phrases whose every place counts, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, opening words of the licence's notice, mandatory key phrase.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Of the licence words that a file shares with a template, so many with the highest IDF are looked up,
RARE = 6
#: and so many of them must agree on a start.
AGREE = 5

#: UTF-8 bytes: A-Z to lower case, 0-9 and a-z and all bytes of other characters kept, the rest to spaces
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z only."""
    return (text or b"").translate(FOLD).split()


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word stands; summed per task, then per word."""

    def make():
        def count(cols):
            found: Counter = Counter()
            for t in cols["text"]:
                found.update(vocabulary.intersection(words_of(t)))
            found[b""] = len(cols["text"])
            return {"word": list(found), "n": list(found.values())}

        return count

    rows = map_rows(docs.select(F.col(text).cast("string").cast("binary").alias("text")), make, "word binary, n long")
    got = {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}  # one row for each template word
    return got, got.pop(b"", 0)


class RareTokenIndex:
    """Postings of licence words with their IDF; finds phrases and notices in a list of words."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, phrases=PHRASES, rare: int = RARE, agree: int = AGREE):
        self.templates = [(label, t.encode().split(), k.encode().split()) for label, t, k in templates]
        self.rare = rare
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.rank = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.anchors = defaultdict(list)  # a phrase's rarest word -> (phrase number, its position there)
        for n, (p, _) in enumerate(self.phrases):
            at = min(range(len(p)), key=lambda i: self.rank[p[i]])
            self.anchors[p[at]].append((n, at))
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # word -> template -> positions
        for n, (_, t, _) in enumerate(self.templates):
            for at, w in enumerate(t):
                self.postings[w][n].append(at)
        self.least = [min(agree, len(set(t))) for _, t, _ in self.templates]
        self.first = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for _, t, k in self.templates]
        self.vocabulary = frozenset(self.postings) | frozenset(self.anchors)

    def base(self, words: list[bytes], where: dict[bytes, list[int]]) -> tuple[list[int], set[str]]:
        """Starts of all phrases, and their labels."""
        starts, labels = [], set()
        for w in where.keys() & self.anchors.keys():
            for n, at in self.anchors[w]:
                phrase, label = self.phrases[n]
                hits = [i - at for i in where[w] if i >= at and words[i - at : i - at + len(phrase)] == phrase]
                starts += hits
                if hits:
                    labels.add(label)
        return starts, labels

    def accepted(self, where: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(template, start) on which enough of the file's rarest words of the template agree."""
        met: dict[int, int] = defaultdict(int)
        votes: dict[int, Counter] = defaultdict(Counter)
        for w in sorted(where, key=self.rank.__getitem__):
            for n, positions in self.postings[w].items() if w in self.postings else ():
                if met[n] < self.rare:
                    met[n] += 1
                    votes[n].update({i - at for at in positions for i in where[w]})
        return [(n, start) for n, counted in votes.items() if met[n] >= self.least[n] for start, k in counted.items() if k >= self.least[n]]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of all phrases, base labels, all labels, and the best share of a notice that stands in its place."""
        held = self.vocabulary.intersection(words)
        if not held:
            return [], set(), set(), 0.0
        where = defaultdict(list)
        for i, w in enumerate(words):
            if w in held:
                where[w].append(i)
        starts, base = self.base(words, where)
        labels, score = set(base), 0.0
        for n, start in self.accepted(where):
            label, template, key = self.templates[n]
            at = start + self.first[n]
            if at >= 0 and words[at : at + len(key)] == key:
                aligned = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template))
                labels.add(label)
                score = max(score, aligned / len(template))
        return starts, base, labels, max(score, 0.5) if base else score


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, rare: int = RARE, agree: int = AGREE) -> DataFrame:
    """One row per document: word count, the starts of all phrases, base labels, labels and score."""
    vocabulary = {w for _, t, _ in templates for w in t.encode().split()} | {w for p in phrases for w in p.encode().split()}
    df, n = document_frequency(docs, vocabulary, text)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}

    def make():
        index = RareTokenIndex(idf, templates, phrases, rare, agree)

        def scan(cols):
            out = {"doc_id": cols["doc_id"], "n_words": [], "starts": [], "base_labels": [], "labels": [], "score": []}
            for t in cols["text"]:
                words = words_of(t)
                starts, base, labels, score = index.scan(words)
                for k, v in (("n_words", len(words)), ("starts", sorted(starts)), ("base_labels", sorted(base)), ("labels", sorted(labels)), ("score", score)):
                    out[k].append(v)
            return out

        return scan

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, n_words long, starts array<long>, base_labels array<string>, labels array<string>, score double")


def oracle(rare: int = RARE, agree: int = AGREE) -> str:
    """The digest of ``scan_licenses`` as DuckDB SQL: postings, votes and agreement as joins and groups."""
    lists = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)
    first = lambda t, k: next(i for i in range(len(t)) if t[i : i + len(k)] == k)
    templates = [(n, label, t, k, first(t.split(), k.split())) for n, (label, t, k) in enumerate(TEMPLATES)]
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT label, string_split(p, ' ') AS p FROM (VALUES {lists(PHRASES.items())}) v(p, label)),
templates AS (SELECT n, label, string_split(t, ' ') AS t, string_split(k, ' ') AS k, first FROM (VALUES {lists(templates)}) v(n, label, t, k, first)),
posts AS (SELECT n, unnest(t) AS word, unnest(range(len(t))) AS pos FROM templates),
size AS (SELECT n, count(*) AS len, least({agree}, count(DISTINCT word)) AS least FROM posts GROUP BY n),
known AS (SELECT word FROM posts UNION SELECT unnest(p) FROM phrases),
places AS (SELECT r, word, i FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts) SEMI JOIN known USING (word)),
held AS (SELECT DISTINCT r, word FROM places),
rank AS (SELECT word, row_number() OVER (ORDER BY coalesce(n, 0), word) AS place FROM known LEFT JOIN (SELECT word, count(*) AS n FROM held GROUP BY 1) USING (word)),
base AS (SELECT r, label, i FROM places JOIN texts USING (r) JOIN phrases ON places.word = p[1] AND w[i + 1 : i + len(p)] = p),
looked AS (SELECT r, n, word, count(*) OVER (PARTITION BY r, n) AS met FROM held JOIN (SELECT DISTINCT n, word FROM posts) USING (word) JOIN rank USING (word)
  QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY place) <= {rare}),
votes AS (SELECT r, n, i - pos AS start FROM looked JOIN places USING (r, word) JOIN posts USING (n, word) JOIN size USING (n)
  GROUP BY 1, 2, 3, least HAVING count(DISTINCT word) >= least),
found AS (SELECT r, n, label, start FROM votes JOIN templates USING (n) JOIN texts USING (r) WHERE start + first >= 0 AND w[start + first + 1 : start + first + len(k)] = k),
aligned AS (SELECT r, n, start, count(*) AS k FROM found JOIN posts USING (n) JOIN places USING (r, word) WHERE i = start + pos GROUP BY 1, 2, 3),
scores AS (SELECT r, max(k / len) AS score FROM aligned JOIN size USING (n) GROUP BY r),
based AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(based.labels, '') AS base_labels,
  coalesce(labelled.labels, '') AS labels, greatest(coalesce(score, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM texts LEFT JOIN based USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scores USING (r)"""
