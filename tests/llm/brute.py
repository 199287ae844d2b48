"""Plain loops that the operators are held against."""

import itertools

import numpy as np

from sheetlens.llm import minhash_dedup as M
from sheetlens.llm import quality as Q
from sheetlens.llm import toxicity as T


def classes(rows) -> dict:
    """Near-duplicate classes by comparing all pairs: id -> smallest id of the class."""
    sets = {i: M.shingles(M.words_of(t)) for i, t in rows if M.words_of(t)}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if max(M.similarity(*sets[a], *sets[b])) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def quality_scores(space, texts: list) -> list[float]:
    """Votes of the nearest labelled texts in double precision, one text at a time."""
    names, idf, basis, known = space
    number = {t: i for i, t in enumerate(names)}

    def vector(counts):
        x = np.sqrt(counts) * idf.astype(float)
        v = (x / max(np.linalg.norm(x), 1e-12)) @ basis.astype(float)
        return v / max(np.linalg.norm(v), 1e-12), np.linalg.norm(v) > 1e-9

    def counted(text):
        x, words = np.zeros(len(names)), (text or "").split()
        for w in words:
            for t in (w.lower(), Q.shape_of(w)):
                if t in number:
                    x[number[t]] += 1
        x[number[Q.REPEAT]] += sum(a == b for a, b in zip(words, words[1:]))
        return x

    voters = []
    for r in known:
        x = np.zeros(len(names))
        x[r.term] = r.n
        voters.append((vector(x)[0], r.label))
    out = []
    for t in texts:
        v, some = vector(counted(t))
        near = sorted(((round(float(v @ u), 5), y) for u, y in voters), reverse=True)
        near = [(c, y) for c, y in near if c >= near[min(15, len(near)) - 1][0]]
        out.append(sum(max(c, 1e-3) ** 8 * y for c, y in near) / sum(max(c, 1e-3) ** 8 for c, _ in near) if some else sum(y for _, y in voters) / len(voters))
    return out


def toxicity_scores(model, rules: dict, rest: float, texts: list) -> list[float]:
    """Every token, and every stretch of short pieces, decoded by itself and matched with the rules."""
    restorer, out = T.Restorer(model), []
    for t in texts:
        tokens = (t or "").split()
        found = set().union(*(T.features(restorer.words(w)) for w in tokens)) if tokens else set()
        for run in T.runs_of(tokens):
            pieces = run.split()
            if T.hides(run):
                found |= T.features(restorer.decode(run).split())
            for i in range(len(pieces)):
                for j in range(i + 1, len(pieces)):
                    letters = "".join(p.strip(T.EDGE + "!") for p in pieces[i : j + 1])
                    stems = [f for f in rules if letters.startswith(f.rstrip("*")) and (f.endswith("*") or f == letters)]
                    short = [f for f in stems if len("".join(p.strip(T.EDGE + "!") for p in pieces[i:j])) < len(f.rstrip("*")) + 1]
                    if short:
                        found |= T.features(restorer.decode(" ".join(pieces[i : j + 1])).split())
        held = [f for f in rules if f in found]
        out.append(1 - float(np.prod([1 - rules[f] for f in held])) if held else rest)
    return out
