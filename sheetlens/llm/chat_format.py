"""Chat formatting: a hidden Markov model recovers the speakers' turns of a transcript by Viterbi.

States are a role that begins a turn on this line, or goes on with it. A line's features are its
speaker marker (of a role, of an unknown speaker, none) and the size of its text. Sizes, by role and by whether the
line is a turn's first, the order of roles and the number of lines are counted on labelled turns; how often markers mislead is a
fixed prior. The most probable path gives the turns; markers are taken off and each turn is rendered in one canonical form.

A transcript may come in parts (a long one is never gathered in one task). Parts are put together to
chunks of ``PARTS`` part numbers, and where more than ``most`` rows share a chunk, to cells of it. A transcript of several
chunks is decoded in three steps: each chunk gives its max-plus transfer matrix (best score from each state before it to each state at
its end); the matrices, a few numbers each, are multiplied up a tree of at most ``FAN`` neighbours a node, and from its top down the best
path's states at all borders are fixed; then each chunk is decoded between its borders. That is the same path
that Viterbi over the whole transcript finds.

Defined results: a row is a turn, also where it runs through several chunks, so a turn's text must fit a row. A null or empty part adds no
line; a transcript without lines gives no turn. The first line always begins a turn. Parts of equal number (repeated rows) stand in the
order of a hash of their text; where more than ``most`` rows share a chunk, cells of ``PARTS`` rows are ranges of that order. Parts
without number stand before all others, as if of one number. Labelled turns without number or transcript id have no known turn before them.
Ties of paths go to the state listed first. A row without transcript id is a transcript of its own.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, saved

ROLES = ("system", "user", "assistant")
#: Names that mark a role's line, in lower case.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "client", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "response"),
}
ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in MARKERS[role]}
HEADER = re.compile(r"^\s*(?:#{1,4}\s*([A-Za-z]{1,15})\s*:?|<\|([A-Za-z]{1,15})\|>|\[([A-Za-z]{1,15})\]:?|\*\*([A-Za-z]{1,15})\*\*:?|\*\*([A-Za-z]{1,15}):\*\*|([A-Za-z]{1,15})\s*:)(?:[ \t]+(.*)|)$", re.DOTALL)
OTHER, NONE = len(ROLES), len(ROLES) + 1
SIZES = (1, 20, 40, 80, 120, 180, 260, 400)
PARTS = 64
MOST = 1024
#: A node of the tree of matrices has at most so many chunks (cells) below it.
FAN = 4096
#: The number that stands for none: a multiple of PARTS below all others.
UNNUMBERED = -(1 << 60)
S = 2 * len(ROLES)  # begin states, then inside states

#: P(marker | state): a beginning mostly shows its own marker, an inner line hardly ever one.
BEGIN = {"own": 0.80, "another role's": 0.02, "unknown": 0.08, "none": 0.08}
INSIDE = {"a role's": 0.005, "unknown": 0.025, "none": 0.96}


def read_line(line: str) -> tuple[int, str]:
    """(marker's role, OTHER or NONE; text without the marker)."""
    m = HEADER.match(line)
    if not m:
        return NONE, line
    name = next(g for g in m.groups()[:6] if g).lower()
    return ROLE_OF.get(name, OTHER), m.group(7) or ""


def size_class(text: str) -> int:
    return sum(len(text) >= s for s in SIZES)


def learn(turns: DataFrame, key: str, order: str, role: str, text: str) -> dict[str, np.ndarray]:
    """Counts over all labelled turns: which role follows which, and the sizes of lines by role and place."""
    rows = turns.where(F.col(role).isin(*ROLES)).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(role).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    known = F.col("k").isNotNull() & F.col("o").isNotNull()
    placed = rows.where(known).select("k", "o", "r").distinct()  # at most three rows a number
    follow = placed.withColumn("before", F.lag("r").over(Window.partitionBy("k", F.floor(F.col("o") / PARTS)).orderBy("o", "r"))).groupBy("before", "r").count().collect()
    start, step = np.ones(3), np.ones((3, 3))
    for before, r, n in follow:
        if before is None:
            start[ROLES.index(r)] += n
        else:
            step[ROLES.index(before), ROLES.index(r)] += n
    line = rows.select("r", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    size = sum(((F.length("line") >= s).cast("int") for s in SIZES[1:]), (F.length("line") >= SIZES[0]).cast("int"))
    sizes = np.ones((2, 3, len(SIZES) + 1))
    for r, inner, s, n in line.groupBy("r", (F.col("at") > 0).cast("int").alias("inner"), size.alias("s")).count().collect():
        sizes[inner, ROLES.index(r), s] += n
    first, inner = sizes.sum(2)
    return {"start": start / start.sum(), "step": step / step.sum(1, keepdims=True), "sizes": sizes / sizes.sum(2, keepdims=True), "stay": np.clip(inner / (first + inner), 0.05, 0.95)}


class Model:
    """Log probabilities of the hidden Markov model."""

    def __init__(self, counts: dict[str, np.ndarray]):
        n = len(ROLES)
        self.start = np.full(S, -np.inf)
        self.start[:n] = np.log(counts["start"])
        move = np.full((S, S), -np.inf)
        for a in range(n):
            for state in (a, n + a):
                move[state, n + a] = np.log(counts["stay"][a])
                move[state, :n] = np.log(1 - counts["stay"][a]) + np.log(counts["step"][a])
        self.move = move
        marker = np.zeros((S, n + 2))
        for r in range(n):
            marker[r, :n], marker[r, r], marker[r, OTHER], marker[r, NONE] = BEGIN["another role's"], BEGIN["own"], BEGIN["unknown"], BEGIN["none"]
            marker[n + r, :n], marker[n + r, OTHER], marker[n + r, NONE] = INSIDE["a role's"], INSIDE["unknown"], INSIDE["none"]
        self.emit = np.log(marker)[:, :, None] + np.log(np.concatenate(list(counts["sizes"])))[:, None, :]

    def observe(self, lines: list[str]) -> np.ndarray:
        seen = [read_line(x) for x in lines]
        return self.emit[:, [m for m, _ in seen], [size_class(t) for _, t in seen]].T

    def transfer(self, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score at the end by state: from each state before the lines, and if a transcript begins with them."""
        inner, first = self.move + emitted[0], self.start + emitted[0]
        for e in emitted[1:]:
            inner, first = (inner[:, :, None] + self.move[None]).max(1) + e, (first[:, None] + self.move).max(0) + e
        return inner, first

    def path(self, emitted: np.ndarray, before: int | None = None, end: int | None = None) -> list[int]:
        score, back = (self.start if before is None else self.move[before]) + emitted[0], []
        for e in emitted[1:]:
            ways = score[:, None] + self.move
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        return traced(back, int(score.argmax()) if end is None else end)


def traced(back: list[np.ndarray], end: int) -> list[int]:
    states = [end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def lines_of(texts: list[str]) -> list[str]:
    return [line for t in texts if t for line in t.split("\n")]


def turns_of(model: Model, lines: list[str], before: int | None = None, end: int | None = None) -> list[tuple[bool, int, str]]:
    """(whether the turn begins here, role, text with its lines): the turns, or their pieces, in these lines."""
    found: list[tuple[bool, int, list[str]]] = []
    for line, state in zip(lines, model.path(model.observe(lines), before, end) if lines else [], strict=True):
        if state < len(ROLES) or not found:
            found.append((state < len(ROLES), state % len(ROLES), []))
        found[-1][2].append(read_line(line)[1] if state < len(ROLES) else line)
    return [(begins, role, "\n".join(kept)) for begins, role, kept in found]


def in_chunks(rows: DataFrame, most: int) -> DataFrame:
    """(key, chunk, cell, parts) of ``rows(key, part, text)``: texts in order, by their chunk and cell."""
    chunk = F.floor(F.coalesce("part", F.lit(UNNUMBERED)) / PARTS) * PARTS
    rows = rows.withColumn("chunk", chunk.cast("long"))
    big = saved(rows.groupBy("key", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", "chunk"), "big")
    h = F.xxhash64("text").alias("h")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", h, "text"))), lambda x: x["text"]).alias("parts")
    if big.isEmpty():
        return rows.groupBy("key", "chunk", F.lit(0).cast("long").alias("cell")).agg(parts)
    usual = rows.join(big, ["key", "chunk"], "left_anti").groupBy("key", "chunk", F.lit(0).cast("long").alias("cell")).agg(parts)
    # a number that many rows share: equal texts are counted, and cells are ranges of the same order; places are summed by the first bits of the hash, then inside them
    number = F.coalesce("part", F.lit(UNNUMBERED)).alias("chunk")
    texts = saved(rows.join(big, ["key", "chunk"], "left_semi").groupBy("key", number, "text", h).agg(F.count("*").alias("n")).withColumn("bits", F.shiftright("h", 48)), "texts")
    upto = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy("key", "chunk", *order[:-1]).orderBy(*order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = texts.groupBy("key", "chunk", "bits").agg(F.sum("n").alias("n")).select("key", "chunk", "bits", upto(["bits"]).alias("base"))
    place = texts.withColumn("inner", upto("bits", ["h", "text"])).join(base, ["key", "chunk", "bits"]).withColumn("place", F.col("base") + F.col("inner"))
    dealt = place.withColumn("cell", F.explode(F.sequence(F.floor(F.col("place") / PARTS), F.floor((F.col("place") + F.col("n") - 1) / PARTS))))
    held = F.least(F.col("place") + F.col("n"), (F.col("cell") + 1) * PARTS) - F.greatest(F.col("place"), F.col("cell") * PARTS)
    copies = dealt.select("key", "chunk", "cell", "h", "text", F.array_repeat("text", held.cast("int")).alias("copies"))
    return usual.unionByName(copies.groupBy("key", "chunk", "cell").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("h", "text", "copies"))), lambda x: x["copies"])).alias("parts")))


def tree_levels(most: int) -> list[tuple[Column, Column]]:
    """(chunk, cell) of the parents, level by level; one level is enough if no transcript has more than ``FAN`` chunks."""
    chunk, cell, none = F.col("chunk"), F.col("cell"), F.lit(0).cast("long")
    top = [(none, none)]
    return top if most <= FAN else [(chunk, F.floor(cell / FAN)), (chunk, none), (F.floor(chunk / (FAN * PARTS)), none), *top]


def border_states(matrices: DataFrame, levels: list[tuple[Column, Column]], kind: str) -> DataFrame:
    """(key, chunk, cell, before, end): the best path's states before and at the end of each chunk of ``matrices(key, chunk, cell, inner, first)``."""
    up, entry = [], F.struct("chunk", "cell", "inner", "first")

    def chain(rows: list[dict], before: int | None, end: int | None) -> list[int]:
        score, back = np.array(rows[0]["first"]) if before is None else np.array(rows[0]["inner"]).reshape(S, S)[before], []
        for r in rows[1:]:
            ways = score[:, None] + np.array(r["inner"]).reshape(S, S)
            back.append(ways.argmax(0))
            score = ways.max(0)
        return traced(back, int(score.argmax()) if end is None else end)

    def make_products():
        def products(cols):
            out = {**cols, "inner": [], "first": []}
            for rows in cols["chain"]:
                inner, first = np.array(rows[0]["inner"]).reshape(S, S), np.array(rows[0]["first"])
                for r in rows[1:]:
                    m = np.array(r["inner"]).reshape(S, S)
                    inner, first = (inner[:, :, None] + m[None]).max(1), (first[:, None] + m).max(0)
                out["inner"].append(inner.ravel().tolist())
                out["first"].append(first.tolist())
            return out

        return products

    def make_down():
        def down(cols):
            out = {"key": [], "chunk": [], "cell": [], "before": [], "end": []}
            for k, rows, before, end in zip(cols["key"], cols["chain"], cols["before"], cols["end"], strict=True):
                states = chain(rows, before, end)
                for r, b, e in zip(rows, [before, *states[:-1]], states, strict=True):
                    for name, v in zip(out, (k, r["chunk"], r["cell"], b, e), strict=True):
                        out[name].append(v)
            return out

        return down

    chains = f"key {kind}, chunk long, cell long, chain array<struct<chunk:long,cell:long,inner:array<double>,first:array<double>>>"
    for chunk, cell in levels:
        grouped = matrices.groupBy("key", chunk.alias("up_chunk"), cell.alias("up_cell")).agg(F.sort_array(F.collect_list(entry)).alias("chain")).withColumnsRenamed({"up_chunk": "chunk", "up_cell": "cell"})
        matrices = saved(map_rows(grouped, make_products, f"{chains}, inner array<double>, first array<double>", rows=50), "matrices")
        up.append(matrices)
    nothing = F.lit(None).cast("int")
    states = up[-1].select("key", "chain", nothing.alias("before"), nothing.alias("end"))
    for below in [*up[-2::-1], None]:
        states = saved(map_rows(states, make_down, f"key {kind}, chunk long, cell long, before int, end int", rows=50), "borders")
        if below is not None:
            states = below.select("key", "chunk", "cell", "chain").join(states, ["key", "chunk", "cell"]).select("key", "chain", "before", "end")
    discard(*up)
    return states


def running_base(counted: DataFrame, levels: list[tuple[Column, Column]]) -> DataFrame:
    """(key, chunk, cell, base): the sum of ``n`` of all chunks of a transcript before this one, summed up the same tree."""
    tables = [counted]
    for chunk, cell in levels[:-1]:
        tables.append(saved(tables[-1].groupBy("key", chunk.alias("up_chunk"), cell.alias("up_cell")).agg(F.sum("n").alias("n")).withColumnsRenamed({"up_chunk": "chunk", "up_cell": "cell"}), "sums"))
    base = None
    for table, (chunk, cell) in zip(reversed(tables), reversed(levels), strict=True):
        place = Window.partitionBy("key", "up_chunk", "up_cell").orderBy("chunk", "cell").rowsBetween(Window.unboundedPreceding, -1)
        rows = table.withColumns({"up_chunk": chunk, "up_cell": cell}).withColumn("base", F.coalesce(F.sum("n").over(place), F.lit(0)))
        if base is not None:
            above = base.select("key", F.col("chunk").alias("up_chunk"), F.col("cell").alias("up_cell"), F.col("base").alias("above"))
            rows = rows.join(above, ["key", "up_chunk", "up_cell"]).withColumn("base", F.col("base") + F.col("above"))
        base = rows.select("key", "chunk", "cell", "base")
    return saved(base, "base")


def format_chats(parts: DataFrame, counts: dict[str, np.ndarray], key: str = "conv_id", order: str = "part", text: str = "text", most: int = MOST) -> DataFrame:
    """(key, turn, role, text, rendered): one row per turn, numbered from 0 in its transcript.

    ``rendered`` of all rows of a transcript, in the order of ``turn``, is its canonical form.
    """
    kind = parts.schema[key].dataType.simpleString()
    rows = parts.select(F.col(key).alias("key"), F.col(order).cast("long").alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = saved(in_chunks(rows.where("key IS NOT NULL"), most), "chunks")
    several = saved(chunks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    longest = several.agg(F.max("n")).first()[0]

    def pieces(cols: dict[str, list]) -> Iterator[tuple]:
        """The columns of a chunk, its number in ``cols``, and its turns."""
        model = Model(counts)
        for i, texts in enumerate(cols["parts"]):
            before, end = (cols[c][i] if c in cols else None for c in ("before", "end"))
            yield i, turns_of(model, lines_of(texts), before, end)

    def make_turns():
        def whole(cols):
            out = {"key": [], "turn": [], "role": [], "text": []}
            for i, found in pieces(cols):
                for at, (_, role, kept) in enumerate(found):
                    for name, v in zip(out, (cols["key"][i], at, ROLES[role], kept), strict=True):
                        out[name].append(v)
            return out

        return whole

    turn = f"key {kind}, turn long, role string, text string"
    alone = rows.where("key IS NULL").select("key", F.array("text").alias("parts"))
    single = chunks.select("key", "parts")
    if longest:
        single = single.join(several.select("key"), "key", "left_anti")
    found = map_rows(single.unionByName(alone), make_turns, turn, rows=500)
    if longest:
        found = found.unionByName(several_chunks(chunks.join(several.select("key"), "key", "left_semi"), counts, tree_levels(longest), kind, pieces))
    shown = F.btrim("text", F.lit("\n"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), shown, F.lit("\n"))
    return found.select(F.col("key").alias(key), "turn", "role", shown.alias("text"), rendered.alias("rendered"))


def several_chunks(chunks: DataFrame, counts: dict[str, np.ndarray], levels: list[tuple[Column, Column]], kind: str, pieces) -> DataFrame:
    """(key, turn, role, text) of the transcripts that have several chunks."""

    def make_transfer():
        model = Model(counts)

        def transfer(cols):
            out = {k: cols[k] for k in ("key", "chunk", "cell")} | {"inner": [], "first": []}
            for texts in cols["parts"]:
                lines = lines_of(texts)
                inner, first = model.transfer(model.observe(lines)) if lines else (None, None)
                out["inner"].append(lines and inner.ravel().tolist() or None)
                out["first"].append(lines and first.tolist() or None)
            return out

        return transfer

    def make_pieces():
        def cut(cols):
            out = {"key": [], "chunk": [], "cell": [], "at": [], "begins": [], "last": [], "role": [], "text": []}
            for i, found in pieces(cols):
                for at, (begins, role, kept) in enumerate(found):
                    for name, v in zip(out, (cols["key"][i], cols["chunk"][i], cols["cell"][i], at, begins, at == len(found) - 1, ROLES[role], kept), strict=True):
                        out[name].append(v)
            return out

        return cut

    place = ["key", "chunk", "cell"]
    matrices = saved(map_rows(chunks, make_transfer, f"key {kind}, chunk long, cell long, inner array<double>, first array<double>", rows=500).where("first IS NOT NULL"), "transfer")
    borders = border_states(matrices, levels, kind)
    cut = saved(map_rows(chunks.join(borders, place), make_pieces, f"key {kind}, chunk long, cell long, at int, begins boolean, last boolean, role string, text string", rows=500), "pieces")
    base = running_base(saved(cut.groupBy(*place).agg(F.count_if("begins").alias("n")), "begins"), levels)
    in_chunk = F.sum(F.col("begins").cast("long")).over(Window.partitionBy(*place).orderBy("at"))
    numbered = saved(cut.withColumn("in_chunk", in_chunk).join(base, place).withColumn("turn", F.col("base") + F.col("in_chunk") - 1), "numbered")
    # only a chunk's first and last pieces can belong to a turn that runs through several chunks
    edge = F.col("last") | ~F.col("begins")
    joined = numbered.where(edge).groupBy("key", "turn").agg(F.min(F.struct("chunk", "cell", "at", "role")).alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "cell", "at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    discard(matrices, cut, base)
    return numbered.where(~edge).select("key", "turn", "role", "text").unionByName(joined.select("key", "turn", "first.role", "text"))
