"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification.

Each distinct shingle of five words arrives in a Poisson process whose rate is its count in the
text; each arrival falls on one of ``REGISTERS`` registers, and a register keeps the shingle that
reached it first. The share of equal registers estimates the probability Jaccard similarity of
two texts. A shingle's process ends as soon as its time is past the latest first arrival of all
registers, so long texts stop after a few arrivals a shingle.

A text in which a shingle repeats has a second set of registers, with rate 1 for each distinct shingle; their share
of equal ones estimates the plain Jaccard similarity. For other texts both sets are the same.

Registers, of both sets, are grouped into ``BANDS`` bands of ``ROWS``; at similarity 0.8 a pair shares a band with
probability 0.998. Candidates are verified exactly: two texts are linked if their probability
Jaccard similarity, or the Jaccard similarity of their sets of shingles, is at least the threshold.

Candidates are not all pairs of a bucket. First every text of a bucket meets the bucket's smallest and largest node.
Of the components that this gives, a bucket's largest needs no more pairs in itself; every text outside
it meets all texts of the bucket that are in other components, by blocks of registers, and only pairs whose
registers agree enough become rows. So no candidate pair between different components is left out, and
a bucket of near copies does not become a row for each pair.

Equal texts (the same words in the same order) are one node from the start.

Defined results: null texts and texts without words are classes of their own. A text of one to four
words is one shingle. Repeated rows, also of one id, fall into one class; rows of one id with different texts are compared
as different texts. A row without id takes part like others; its class is named by the smallest id of its members (null if all
ids of the class are null). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import discard, map_rows, saved, unused_name
from .components import connected_components

WIDTH = 5
BANDS, ROWS = 22, 6
BLOCK = 256
LOWEST = 512
REGISTERS = BANDS * ROWS
WORD = re.compile(r"\w+")
U = np.uint64
GOLDEN, MIX1, MIX2, BASE = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class WordHash(dict):
    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHash()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the text's shingles, and their counts."""
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.fromiter(map(HASHES.__getitem__, words), U, len(words))
    width = min(WIDTH, len(words))
    s = np.full(len(h) - width + 1, U(width))
    for i in range(width):
        s = s * BASE + h[i : len(s) + i]
        s ^= s >> U(29)
    return np.unique(mixed(s), return_counts=True)


def text_key(words: list[str]) -> bytes | None:
    return hashlib.md5(" ".join(words).encode()).digest() if words else None


def registers(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts x REGISTERS) signature of non-empty weighted sets."""
    n = len(sets)
    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, U)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    item = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, U)
    rate = np.concatenate([c for _, c in sets]).astype(float) if sets else np.zeros(0)
    time, k = np.zeros(len(item)), 0
    while len(item):
        steps = int(np.clip(200_000 // len(item), 1, 64))
        draw = mixed(item[:, None] + GOLDEN * np.arange(k + 1, k + 1 + steps, dtype=U))
        gap = -np.log(((draw >> U(11)).astype(float) + 0.5) / 2**53) / rate[:, None]
        when = time[:, None] + np.cumsum(gap, 1)
        slot = doc[:, None] * REGISTERS + (mixed(draw + GOLDEN) % U(REGISTERS)).astype(np.int64)
        better = when < first[slot]
        t, r, e = when[better], slot[better], np.broadcast_to(item[:, None], when.shape)[better]
        order = np.argsort(-t, kind="stable")  # of repeated slots, the last assigned one stays: the earliest
        first[r[order]], winner[r[order]] = t[order], e[order]
        k += steps
        time = when[:, -1]
        docs, back = np.unique(doc, return_inverse=True)
        end = first.reshape(n, REGISTERS)[docs].max(1)
        go = time < end[back]
        doc, item, rate, time = doc[go], item[go], rate[go], time[go]
    return winner.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U) + U(1), parts.shape[:2])
    for i in range(ROWS):
        key = mixed(key * BASE + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of two weighted sets, and Jaccard of the sets."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / (len(a) + len(b) - len(both)) if len(a) + len(b) else 0.0
    if not len(both):
        return 0.0, 0.0
    if len(a) == ca.sum() and len(b) == cb.sum():
        return plain, plain
    # sum over common d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)
    xs, ys = ca[i].astype(float), cb[j].astype(float)
    only_a, only_b = ca.sum() - xs.sum(), cb.sum() - ys.sum()
    order = np.argsort(xs / ys)
    x, y = xs[order], ys[order]
    # for d, items e with x_e / y_e >= x_d / y_d take x, the others y
    take_x = np.concatenate((np.cumsum(x[::-1])[::-1], [0]))
    take_y = np.concatenate(([0], np.cumsum(y)))
    at = np.arange(len(x))
    total = (take_x[at] + only_a) / x + (take_y[at] + only_b) / y
    return float((1 / total).sum()), plain


def equal_registers(a: np.ndarray, plain_a: np.ndarray, b: np.ndarray, plain_b: np.ndarray) -> np.ndarray:
    """Equal registers of texts, by counts or by distinct shingles, whichever are more."""
    return np.maximum((a == b).sum(-1), (plain_a == plain_b).sum(-1))


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key of the text's words (null without words), band keys, and 16 bits of each register.

    ``plain`` are the registers of the distinct shingles, null where no shingle repeats.
    """

    def make():
        def sketch(cols):
            words = [words_of(t) for t in cols["text"]]
            keys = [text_key(w) for w in words]
            some = [i for i, w in enumerate(words) if w]
            bands: list = [None] * len(words)
            short: list = [None] * len(words)
            plain: list = [None] * len(words)
            if some:
                sets = [shingles(words[i]) for i in some]
                signature = registers(sets)
                for i, b, s in zip(some, band_keys(signature), (signature >> U(48)).astype("<u2"), strict=True):
                    bands[i], short[i] = b.tolist(), s.tobytes()
                repeat = [(i, items) for i, (items, counts) in zip(some, sets, strict=True) if (counts > 1).any()]
                if repeat:
                    signature = registers([(items, np.ones(len(items), np.int64)) for _, items in repeat])
                    for (i, _), b, s in zip(repeat, band_keys(signature), (signature >> U(48)).astype("<u2"), strict=True):
                        bands[i], plain[i] = sorted({*bands[i], *b.tolist()}), s.tobytes()
            return {"doc_id": cols["doc_id"], "text_key": keys, "bands": bands, "registers": short, "plain": plain}

        return sketch

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, text_key binary, bands array<long>, registers binary, plain binary", rows=500)


def shingle_sets(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, items, counts, lowest, low_counts) of ``nodes(node, rep, text_key)``: their texts' shingles, read from ``docs`` once.

    ``lowest`` are the first 32 bits of the ``LOWEST`` smallest items, ``low_counts`` their counts, null where no
    shingle repeats. The nodes grow with the corpus, so they are never broadcast here.
    """

    def make():
        def sets(cols):
            out = {"node": [], "items": [], "counts": [], "lowest": [], "low_counts": []}
            for node, key, t in zip(cols["node"], cols["text_key"], cols["text"], strict=True):
                words = words_of(t)
                if text_key(words) == key:  # else another row of the same id
                    items, counts = shingles(words)
                    low = counts[:LOWEST].astype("<u4").tobytes() if (counts > 1).any() else None
                    for k, v in zip(out, (node, items.tobytes(), counts.astype("<u4").tobytes(), (items[:LOWEST] >> U(32)).astype("<u4").tobytes(), low), strict=True):
                        out[k].append(v)
            return out

        return sets

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    rows = texts.join(nodes.hint("merge"), "rep").select("node", "text_key", "text")
    unnamed = nodes.where("rep IS NULL").select("node", "text_key")
    if not unnamed.isEmpty():  # texts of which no row has an id are found by their words
        rows = rows.unionByName(with_text_key(texts.where("rep IS NULL"), "text", "text_key").join(unnamed, "text_key").dropDuplicates(["node"]).select("node", "text_key", "text"))
    found = saved(map_rows(rows, make, "node long, items binary, counts binary, lowest binary, low_counts binary", rows=500), "shingles")
    if found.groupBy("node").count().where("count > 1").isEmpty():
        return found
    once = saved(found.dropDuplicates(["node"]), "shingles")  # rows that repeat an id and a text
    discard(found)
    return once


def with_text_key(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the key of their text's words as the last column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(words_of(None if t is None else str(t))) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.append_column(name, pa.array(keys, pa.binary()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, BinaryType())]))


def least_equal(threshold: float) -> int:
    """Equal registers of a pair that is worth an exact comparison: five standard errors below the threshold."""
    return int(np.floor(REGISTERS * (threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5)))


def sided(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows(a, b)`` with the columns of ``other(node, ..)`` for both."""
    for s in "ab":
        rows = rows.join(other.withColumnsRenamed({c: s if c == "node" else f"{c}_{s}" for c in other.columns}), s)
    return rows


def likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose registers agree enough."""
    least = least_equal(threshold)

    def make_likely():
        def likely(cols):
            sides = []
            for s in "ab":
                counted = cols[f"registers_{s}"]
                for entries in (counted, [p or r for p, r in zip(cols[f"plain_{s}"], counted, strict=True)]):
                    sides.append(np.frombuffer(b"".join(entries), "<u2").reshape(-1, REGISTERS))
            keep = np.flatnonzero(equal_registers(*sides) >= least).tolist()
            return {k: [cols[k][i] for i in keep] for k in ("a", "b")}

        return likely

    return map_rows(sided(pairs, nodes.select("node", "registers", "plain")), make_likely, "a long, b long", rows=5000)


def lowest_share(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, estimated from their smallest hashes."""
    union = np.union1d(a, b)[:LOWEST]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def likely_across(members: DataFrame, threshold: float) -> DataFrame:
    """Of ``members(key, node, root, top, blocks, few_blocks, registers, plain, lowest, low_counts)``, likely pairs (a, b) of one key and different roots.

    ``blocks`` of a key's members and ``few_blocks`` of those outside its ``top`` component have about ``BLOCK`` each. Blocks of a key's members outside its ``top`` component meet blocks of all its members, each two blocks in a task of their own
    choice, so a large key is spread over all tasks. A task compares the registers of two blocks, then the smallest hashes, which
    for most texts are all. So no row for each pair is made.
    """
    least = least_equal(threshold)
    near = threshold - 4 * (threshold * (1 - threshold) / LOWEST) ** 0.5
    entries = F.collect_list(F.struct("node", "root", "registers", "plain", "lowest", "low_counts"))
    every = saved(members.groupBy("key", F.pmod(F.xxhash64("node"), "blocks").alias("block")).agg(entries.alias("all")), "all")  # BLOCK members, more or less
    few = saved(members.where("root <> top").groupBy("key", "top", "blocks", F.pmod(F.xxhash64(F.lit(1), "node"), "few_blocks").alias("few_block")).agg(entries.alias("few")), "few")
    meet = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(every, ["key", "block"])

    def make():
        def arrays(rows):
            lows = [np.frombuffer(r["lowest"], "<u4") for r in rows]
            sets = [(x, np.frombuffer(c, "<u4").astype(np.int64) if c else np.ones(len(x), np.int64), c is not None) for x, c in zip(lows, (r["low_counts"] for r in rows), strict=True)]
            counted, plain = (np.frombuffer(b"".join(x), "<u2").reshape(-1, REGISTERS) for x in ([r["registers"] for r in rows], [r["plain"] or r["registers"] for r in rows]))
            return (np.array([r["node"] for r in rows]), np.array([r["root"] for r in rows]), counted, plain, sets)

        def passes(a, b) -> bool:
            if len(a[0]) < LOWEST and len(b[0]) < LOWEST:
                return max(similarity(*a[:2], *b[:2])) >= threshold - 1e-3
            return a[2] or b[2] or lowest_share(a[0], b[0]) >= near

        def compare(cols):
            out = {"a": [], "b": []}
            for few, every, top in zip(cols["few"], cols["all"], cols["top"], strict=True):
                a, root_a, sig_a, plain_a, low_a = arrays(few)
                b, root_b, sig_b, plain_b, low_b = arrays(every)
                for i in range(len(a)):
                    want = np.flatnonzero((root_b != root_a[i]) & ((root_b == top) | (b > a[i])))
                    hits = [j for j in want[equal_registers(sig_a[i], plain_a[i], sig_b[want], plain_b[want]) >= least] if passes(low_a[i], low_b[j])]
                    out["a"] += np.minimum(b[hits], a[i]).tolist()
                    out["b"] += np.maximum(b[hits], a[i]).tolist()
            return out

        return compare

    found = saved(map_rows(meet.select("few", "all", "top"), make, "a long, b long", rows=16).distinct(), "across")
    discard(every, few)
    return found


def verified(likely: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose texts are similar enough by their shingles."""

    def make_compare():
        def compare(cols):
            near = []
            for a, ca, b, cb in zip(cols["items_a"], cols["counts_a"], cols["items_b"], cols["counts_b"], strict=True):
                ca, cb = (np.frombuffer(c, "<u4").astype(np.int64) for c in (ca, cb))
                near.append(max(similarity(np.frombuffer(a, U), ca, np.frombuffer(b, U), cb)) >= threshold - 1e-12)
            keep = [i for i, ok in enumerate(near) if ok]
            return {k: [cols[k][i] for i in keep] for k in ("a", "b")}

        return compare

    return saved(map_rows(sided(saved(likely, "likely"), sets), make_compare, "a long, b long", rows=200), "near")


def classed_rows(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(doc_id, text_key, root, class_id) of every row; texts without words have neither key nor root."""
    known = saved(sketches(docs, doc_id, text), "sketches")
    worded = known.where(F.col("text_key").isNotNull())
    nodes = worded.groupBy("text_key").agg(F.max("doc_id").alias("rep"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("plain").alias("plain"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    heads = saved(members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1"), "heads")
    shared = saved(members.join(heads, "key").select("key", "node", "low", "high"), "shared")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = saved(ordered(shared.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))), "pairs")
    sets = shingle_sets(saved(nodes.select("node", "rep", "text_key").join(shared.select("node").distinct(), "node"), "used"), docs, doc_id, text)
    links = verified(likely_pairs(pairs, nodes, threshold), sets, threshold)
    roots = saved(connected_components(links), "roots")

    # buckets that still hold several components
    placed = saved(shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed_keys = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
    blocks, few_blocks = (F.ceil(n / BLOCK) for n in (F.col("n"), F.col("n") - F.col("top.n")))
    mixed_keys = saved(mixed_keys.select("key", F.col("top.root").alias("top"), blocks.alias("blocks"), few_blocks.alias("few_blocks")), "mixed")
    rest = saved(placed.join(mixed_keys, "key").join(nodes.select("node", "registers", "plain"), "node").join(sets.select("node", "lowest", "low_counts"), "node"), "rest")
    more = likely_across(rest, threshold).join(pairs, ["a", "b"], "left_anti")
    found = verified(more, sets, threshold)
    roots = saved(connected_components(links.unionByName(found)), "roots")

    placed_nodes = saved(nodes.select("node", "text_key", "least").join(roots, "node", "left").select("text_key", "least", F.coalesce("root", "node").alias("root")), "placed")
    least = saved(placed_nodes.groupBy("root").agg(F.min("least").alias("class_id")), "least")
    classes = saved(placed_nodes.join(least, "root").select("text_key", "root", "class_id"), "classes")
    discard(nodes, heads, shared, pairs, sets, links, placed, mixed_keys, rest, found, placed_nodes, least)
    out = worded.select("doc_id", "text_key").join(classes, "text_key")
    alone = known.where(F.col("text_key").isNull()).select("doc_id", "text_key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"))
    return out.select("doc_id", "text_key", "root", "class_id").unionByName(alone)


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the smallest doc_id of the row's near-duplicate class."""
    return classed_rows(docs, doc_id, text, threshold).select("doc_id", "class_id")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class, in the columns of ``docs``: of its rows with the smallest id (of those without id if none has one) one of the smallest text key.

    Rows without words are classes of their own and stay, but for repetitions of an id.
    """
    rows = saved(classed_rows(docs, doc_id, text, threshold), "rows")
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = saved(rows.where("root IS NOT NULL").groupBy("root").agg(F.min(member).alias("first")).select("root", "first.doc_id", "first.text_key"), "first")
    is_first = rows.join(first.select(F.col("root").alias("r"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")), F.col("root") == F.col("r"), "left")
    is_first = is_first.select("doc_id", (F.col("root").isNull() | (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))).alias("first"))
    name, key = unused_name(docs, "class_doc"), unused_name(docs, "class_key")
    state = is_first.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    state = saved(state.where("NOT first OR n > 1").withColumnRenamed("doc_id", name), "state")
    here = F.col(doc_id).cast("long") == F.col(name)
    once = docs.where(F.col(doc_id).isNotNull()).join(state.select(name), here, "left_anti")
    twice, unnamed = state.where("first").select(name), docs.where(F.col(doc_id).isNull())
    none_twice, none_unnamed = twice.isEmpty(), rows.where("doc_id IS NULL").isEmpty()
    if none_twice and none_unnamed:  # the usual case: no id is repeated or missing, so the texts need not be moved again
        return once
    several = unnamed if none_twice else unnamed.unionByName(docs.join(twice, here, "left_semi"))
    several = saved(with_text_key(several, text, key), "several")
    won = first.select(F.col("doc_id").alias(name), F.col("text_key").alias(unused_name(docs, "won_key")))
    won_key = won.columns[1]
    worded = several.where(F.col(key).isNotNull()).join(won, F.col(doc_id).cast("long").eqNullSafe(F.col(name)) & (F.col(key) == F.col(won_key)), "left_semi").dropDuplicates([doc_id, key])
    silent = several.where(F.col(key).isNull())
    kept = worded.unionByName(silent.where(F.col(doc_id).isNull())).unionByName(silent.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
    return once.unionByName(kept.drop(key))
