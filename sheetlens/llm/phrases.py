"""Phrase collocations, counted in the slots of a minimal perfect hash.

A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A phrase is two to ``LONGEST``
words that stand together in a piece. Everything is counted for each language.

Texts are coded once: a slice of texts of one language becomes its distinct words and an array of their codes, and all counting reads these arrays.

Candidates: a phrase can only be frequent if all its parts are, so it is looked at only where its two longest parts passed.
Words are counted. Pairs of frequent words, and then longer phrases of pairs that passed, are counted by a 64-bit hash, the key: no
phrase has more occurrences than its key, so keys below ``least`` rule phrases out, and none wrongly. What passed is kept as bits of a filter of
fixed size, which may let phrases through but loses none. The keys that pass are the candidates.

Counting: a minimal perfect hash gives each candidate's key, and each frequent word's, a slot. Keys are placed level by level: those alone at
their place of a level get its bit, the others go on to the next; a slot is the number of bits before a key's own. Each slot stores its key, so that phrases
that are no candidates fall out. A task counts its slices into one array of slots by ``bincount``; the arrays are
summed chunk by chunk in a tree, ``FAN`` at a time. Beside the counts stands a second hash of what was counted in a slot: were two to differ,
two phrases would share a key, and everything is done again with another seed. The first slice that holds a slot is named there too, and gives the phrase's words.
A candidate's own count, and those of both sides of each cut, are then read by slot. Where there are more keys than
``KEYS``, they are dealt into shards by hash, and the slices are counted once for each shard; so what is broadcast is bounded whatever the
data (``KEYS`` keys and counts, and the filters), and only the number of passes grows.

Scores are computed with integers of any size. A phrase that a longer candidate holds nearly always is dropped: if a longer one
does, one longer by a single word does too, so only those are joined. The best of each language are first taken inside salted parts.

Defined results: null texts have no words; a null language is ``und``, together with a language of that name. Each row counts, also rows that
repeat. An empty table, or a language without candidates, gives no rows. Very long texts are cut at piece ends for counting, so no phrase is lost. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, slices

LONGEST = 4
#: Bits of a filter.
FILTER_BITS = 1 << 25
#: Keys of one minimal perfect hash: what is broadcast is below 32 bytes a key.
KEYS = 1 << 21
#: Slots of a chunk, and so many chunks are summed in one group.
CHUNK, FAN = 4096, 32
SALTS = 16
#: So many seeds are tried until no two phrases share a key.
SEEDS = 5

#: UTF-8 bytes: A-Z to lower case, tab to space, ends of pieces to newline
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
#: Stands between pieces: no word holds it, as its byte ends a piece.
GAP = b"."
ODD = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all pieces, ``GAP`` between pieces and texts."""
    return b"\n".join(texts).translate(FOLD).replace(b"\n", b" . ").split()


def stretches(text: bytes, size: int = 4_000_000) -> Iterator[bytes]:
    """A text, cut at ends of pieces where it is much longer than ``size``."""
    if len(text) <= 2 * size:
        yield text
        return
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b"\n", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def hashed(words: list[bytes], seed: int = 0) -> np.ndarray:
    """Two 64-bit hashes of each word, shape (2, n)."""
    digests = map(xxhash.xxh3_128_digest, words) if seed == 0 else (xxhash.xxh3_128_digest(w, seed) for w in words)
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T.copy()


def onward(lanes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are longer by a word."""
    lanes = (lanes ^ words) * ODD
    return lanes ^ (lanes >> np.uint64(29))


def start_of(lang: str, seed: int = 0) -> np.ndarray:
    return onward(np.zeros((2, 1), np.uint64), hashed([lang.encode()], seed))


class Filter:
    """Bits of two places for each key."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(col) -> tuple:
        return col.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftright(col, 15).bitwiseAND(F.lit(FILTER_BITS - 1))

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """The filter of ``keys(key)``; its words are put together by an aggregate, at most FILTER_BITS / 64 rows."""
        bits = keys.select(F.explode(F.array(*cls.places(F.shiftrightunsigned("key", 24)))).alias("p"))
        words = bits.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out = np.zeros(FILTER_BITS // 64, np.int64)
        out[words["w"].to_numpy()] = words["b"].to_numpy()
        return cls(out.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        b, found = (keys >> np.uint64(24)).astype(np.int64), True
        for p in (b & (FILTER_BITS - 1), (b >> 15) & (FILTER_BITS - 1)):
            found = found & ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return found


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys, which it stores by slot."""

    LOAD = 1.5

    def __init__(self, keys: np.ndarray):
        self.levels, base, rest = [], 0, keys
        while len(rest):
            size = max(64, int(len(rest) * self.LOAD))
            at = self.at(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(np.append(alone, np.zeros(-size % 64, bool)), bitorder="little").view(np.uint64)
            ends = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.levels.append((size, bits, base + ends - np.bitwise_count(bits)))
            base += int(ends[-1])
            rest = rest[~alone[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self.slots(keys, check=False)] = keys

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys ^ np.uint64(0x2545F4914F6CDD1D * level % 2**64)) * ODD[0, 0]
        x = (x ^ (x >> np.uint64(32))) * ODD[1, 0]
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray, check: bool = True) -> np.ndarray:
        """The slot of each key; -1 for a key that is not stored."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (size, bits, before) in enumerate(self.levels):
            at = self.at(keys[rest], n, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            out[rest[hit]] = (before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))[hit]
            rest = rest[~hit]
        if check and len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


def coded(texts: DataFrame) -> DataFrame:
    """(slice, lang, words, codes) of ``texts(lang, text)``: the distinct words of some texts of one language, and their places from 1 for each token; 0 stands between pieces."""
    arrow = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary())])

    def row(lang: str, some: list[bytes]) -> pa.RecordBatch:
        found = tokens(some)
        names = list(set(found) - {GAP})
        code = dict(zip(names, range(1, len(names) + 1), strict=True))
        code[GAP] = 0
        codes = np.fromiter(map(code.__getitem__, found), np.int32, len(found))
        return pa.RecordBatch.from_pydict({"lang": [lang], "words": [b" ".join(names)], "codes": [codes.tobytes()]}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, rows=5000, chars=8_000_000):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(cols["lang"], cols["text"], strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                for part in [some] if len(some) > 1 else ([x] for x in stretches(some[0])):
                    yield row(lang, part)

    return texts.mapInArrow(run, "lang string, words binary, codes binary").withColumn("slice", F.monotonically_increasing_id())


class Slice:
    """A slice as it is read again: codes, words, their hashes, and whether they may be frequent."""

    def __init__(self, lang: str, words: bytes, codes: bytes, seed: int = 0, frequent: Filter | None = None):
        self.codes = np.frombuffer(codes, np.int32)
        self.names = [GAP, *(words.split(b" ") if words else [])]
        self.raw = hashed(self.names, seed)
        self.first = onward(start_of(lang, seed), self.raw)
        self.alive = np.ones(len(self.names), bool) if frequent is None else frequent.has(self.first[0])
        self.alive[0] = False

    def climb(self, upto: int, filters: dict[int, Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) of the phrases whose parts passed; ``filters`` by length, none where a length has none."""
        at = np.flatnonzero(self.alive[self.codes])
        lanes = self.first[:, self.codes[at]]
        for k in range(2, upto + 1):
            both = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, lanes = at[both], lanes[:, both]
            lanes = onward(lanes, self.raw[:, self.codes[at + k - 1]])
            if k in filters:
                keep = filters[k].has(lanes[0])
                at, lanes = at[keep], lanes[:, keep]
            yield k, at, lanes


#: A task's work: ``take(row)`` gives batches for a slice, ``result()`` those after the last one.
Work = tuple[Callable[[dict], Iterator[dict]], Callable[[], Iterator[dict]]]


def over_slices(table: DataFrame, schema: str, arrow: pa.Schema, make: Callable[[], Work]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, result = make()
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                yield from (pa.RecordBatch.from_pydict(x, schema=arrow) for x in take(row))
        yield from (pa.RecordBatch.from_pydict(x, schema=arrow) for x in result())

    return table.mapInArrow(run, schema)


def word_counts(table: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def make() -> Work:
        def take(row: dict) -> Iterator[dict]:
            n = np.bincount(np.frombuffer(row["codes"], np.int32), minlength=1)[1:]
            if len(n):
                yield {"lang": [row["lang"]] * len(n), "word": row["words"].split(b" "), "n": n}

        return take, lambda: iter(())

    arrow = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    return over_slices(table, "lang string, word binary, n long", arrow, make).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Sums:
    """How often each key was added; ``full`` when it is time to put them out."""

    def __init__(self, most: int = 4_000_000):
        self.keys, self.n, self.waiting, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], most

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) > 1_000_000:
            self.settle()

    def settle(self) -> None:
        new, counts = np.unique(np.concatenate([self.keys[:0], *self.waiting]), return_counts=True)
        self.waiting = []
        keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        n[place[: len(self.keys)]] += self.n
        n[place[len(self.keys) :]] += counts
        self.keys, self.n = keys, n

    def batches(self, all_: bool) -> Iterator[dict]:
        if all_:
            self.settle()
        if all_ or len(self.keys) > self.most:
            for at in range(0, len(self.keys), 1_000_000):
                yield {"key": self.keys[at : at + 1_000_000].view(np.int64), "n": self.n[at : at + 1_000_000]}
            self.keys, self.n = self.keys[:0], self.n[:0]


def likely_keys(table: DataFrame, least: int, lengths: range, seed: int, frequent, filters) -> DataFrame:
    """(key) of the phrases of ``lengths`` that occur at least ``least`` times together."""

    def make() -> Work:
        sums = Sums()

        def take(row: dict) -> Iterator[dict]:
            part = Slice(row["lang"], row["words"], row["codes"], seed, frequent.value)
            for k, _, lanes in part.climb(lengths[-1], filters.value):
                if k in lengths:
                    sums.add(lanes[0])
            return sums.batches(False)

        return take, lambda: sums.batches(True)

    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    counted = over_slices(table, "key long, n long", arrow, make).groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("key")


#: What a task knows of each slot: occurrences, 31 bits of the second hash, the first slice. ``UNSEEN`` stands for a slot without any, ``TWO`` for different second hashes.
NONE, UNSEEN, TWO = np.iinfo(np.int64).max, np.iinfo(np.int32).max, -1


def one_second(rows: np.ndarray) -> np.ndarray:
    """Of second hashes by slot, the one that all rows have that saw the slot; ``TWO`` if they differ."""
    low, high = rows.min(0), np.where(rows == UNSEEN, TWO, rows).max(0)
    return np.where((low == UNSEEN) | (low == high), low, np.int32(TWO))


FIELDS = {
    "counts": (np.int64, 0, lambda rows: rows.sum(0)),
    "second": (np.int32, UNSEEN, one_second),
    "owner": (np.int64, NONE, lambda rows: rows.min(0)),
}
SHAPE = "part long, chunk long, counts array<long>, second array<int>, owner array<long>"


def empty_fields(size: int) -> dict[str, np.ndarray]:
    return {c: np.full(size, none, kind) for c, (kind, none, _) in FIELDS.items()}


def slot_counts(table: DataFrame, seed: int, frequent, filters, hash_) -> DataFrame:
    """(part, chunk, counts, second, owner): each task's ``FIELDS`` by slot, chunk by chunk, chunks without counts left out."""
    arrow = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *((c, pa.list_(pa.from_numpy_dtype(kind))) for c, (kind, _, _) in FIELDS.items())])

    def make() -> Work:
        size = len(hash_.value.keys)
        held = empty_fields(size)

        def add(lanes: np.ndarray, number: int, weights: np.ndarray | None = None) -> None:
            slots = hash_.value.slots(lanes[0])
            keep = slots >= 0
            slots, second = slots[keep], (lanes[1][keep] % np.uint64(UNSEEN)).astype(np.int32)
            if weights is None:
                held["counts"] += np.bincount(slots, minlength=size)
            else:
                np.add.at(held["counts"], slots, weights[keep])
            new = held["second"][slots] == UNSEEN
            held["second"][slots[new]] = second[new]
            held["second"][slots[held["second"][slots] != second]] = TWO
            held["owner"][slots] = np.minimum(held["owner"][slots], number)

        def take(row: dict) -> Iterator[dict]:
            part = Slice(row["lang"], row["words"], row["codes"], seed, frequent.value)
            some = np.flatnonzero(part.alive)
            add(part.first[:, some], row["slice"], np.bincount(part.codes, minlength=len(part.names))[some])
            for _, _, lanes in part.climb(LONGEST, filters.value):
                add(lanes, row["slice"])
            return iter(())

        def result() -> Iterator[dict]:
            part = TaskContext.get().partitionId()
            for at in range(0, size, CHUNK):
                if held["counts"][at : at + CHUNK].any():
                    yield {"part": [part], "chunk": [at // CHUNK]} | {c: [v[at : at + CHUNK]] for c, v in held.items()}

        return take, result

    return over_slices(table, SHAPE, arrow, make)


def tree_sum(rows: DataFrame) -> DataFrame:
    """(chunk, counts, second, owner): the arrays of each chunk put together, ``FAN`` parts in a group, then their results."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[1]], "chunk": [key[0]]} | {c: [how(np.stack(group[c].to_list()))] for c, (_, _, how) in FIELDS.items()})

    rows = saved(rows, "counts")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        summed = saved(rows.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("chunk", "part").applyInPandas(add, SHAPE), "counts")
        discard(rows)
        rows = summed
        if parts <= 1:
            return rows


def owned_phrases(table: DataFrame, seed: int, frequent, filters, hash_, owner) -> DataFrame:
    """(lang, phrase) of each slot of more than a word, from the one slice that owns it."""
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.binary())])

    def make() -> Work:
        def take(row: dict) -> Iterator[dict]:
            mine = owner.value == row["slice"]
            if not mine.any():
                return
            part = Slice(row["lang"], row["words"], row["codes"], seed, frequent.value)
            for k, at, lanes in part.climb(LONGEST, filters.value):
                slots = hash_.value.slots(lanes[0])
                slots[~mine[slots]] = -1  # slot -1 names the last one, but stays -1
                _, first = np.unique(slots, return_index=True)
                first = first[slots[first] >= 0]
                phrases = [b" ".join(map(part.names.__getitem__, part.codes[i : i + k].tolist())) for i in at[first].tolist()]
                yield {"lang": [row["lang"]] * len(phrases), "phrase": phrases}

        return take, lambda: iter(())

    return over_slices(table, "lang string, phrase binary", arrow, make)


def parts_of(k: int) -> list[tuple[int, int]]:
    """The word ranges whose counts a phrase of ``k`` words needs: itself, then both sides of each cut."""
    return [(0, k), *(side for c in range(1, k) for side in ((0, c), (c, k)))]


def read_counts(rows: DataFrame, seed: int, hash_, counts) -> DataFrame:
    """``rows(lang, phrase, f)`` with the counts of the parts that this shard holds; the others stay as they are."""
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, rows=20_000):
            split = [p.split(b" ") for p in cols["phrase"]]
            start = {lang: start_of(lang, seed) for lang in set(cols["lang"])}
            for k in {len(s) for s in split}:
                some = [i for i, s in enumerate(split) if len(s) == k]
                raw = hashed([w for i in some for w in split[i]], seed).reshape(2, -1, k)
                first = np.concatenate([start[cols["lang"][i]] for i in some], 1)
                for n, (a, b) in enumerate(parts_of(k)):
                    lanes = first
                    for w in range(a, b):
                        lanes = onward(lanes, raw[:, :, w])
                    for i, s in zip(some, hash_.value.slots(lanes[0]).tolist(), strict=True):
                        if s >= 0:
                            cols["f"][i][n] = int(counts.value[s])
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in arrow.names}, schema=arrow)

    return rows.mapInArrow(run, "lang string, phrase binary, f array<long>")


SCORED = "lang string, phrase string, k int, inner array<string>, a long, l long, r long, score long"


def scored(rows: DataFrame, least: int, scale: int) -> DataFrame:
    """Candidates with at least ``least`` occurrences, their lowest-scoring cut, and their parts that are shorter by a word."""
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("inner", pa.list_(pa.string())), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, rows=20_000):
            out: dict[str, list] = {c: [] for c in arrow.names}
            for lang, phrase, f in zip(cols["lang"], cols["phrase"], cols["f"], strict=True):
                if f[0] < least:
                    continue
                score, _, left, right = min((scale * f[0] // (f[2 * c - 1] + f[2 * c]), c, f[2 * c - 1], f[2 * c]) for c in range(1, len(f) // 2 + 1))
                text = phrase.decode()
                inner = [text.rpartition(" ")[0], text.partition(" ")[2]] if len(f) > 3 else []
                for c, v in zip(arrow.names, (lang, text, len(f) // 2 + 1, inner, f[0], left, right, score), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return rows.mapInArrow(run, SCORED)


class SharedKey(Exception):
    """Two phrases have one key."""


def counted_candidates(table: DataFrame, usual: DataFrame, least: int, keys: int, seed: int) -> DataFrame:
    """(lang, phrase, f) of all candidates, ``f`` the counts of ``parts_of``."""
    share = table.sparkSession.sparkContext.broadcast
    words = saved(keyed_words(usual, seed), "usual")
    frequent = share(Filter.of(words))
    filters: dict[int, Filter] = {}
    found = [words]
    for lengths in (range(2, 3), range(3, LONGEST + 1)):
        found.append(saved(likely_keys(table, least, lengths, seed, frequent, share(dict(filters))), "likely"))
        filters |= dict.fromkeys(lengths, Filter.of(found[-1]))
    filters = share(filters)
    every = saved(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "keys")
    discard(*found)
    shards = max(1, -(-every.count() // keys))
    known, phrases = [], []
    for shard in range(shards):
        some = every.where(F.pmod("key", F.lit(shards)) == shard).toArrow()
        hash_ = PerfectHash(some["key"].to_numpy().astype(np.int64).view(np.uint64))
        sent, held = share(hash_), empty_fields(len(hash_.keys))
        summed = tree_sum(slot_counts(table, seed, frequent, filters, sent))
        for batch in summed.toArrow().to_batches():
            for r in batch.to_pylist():
                for c, v in held.items():
                    v[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r[c]
        discard(summed)
        if (held["second"] == TWO).any():
            raise SharedKey
        phrases.append(saved(owned_phrases(table, seed, frequent, filters, sent, share(held["owner"])), "phrases"))
        if shards > 1:  # read again below, one after the other
            known.append(saved(table.sparkSession.createDataFrame(pa.table({"key": hash_.keys.view(np.int64), "n": held["counts"]})), "counts"))
    rows = phrases[0]
    for more in phrases[1:]:
        rows = rows.unionByName(more)
    rows = saved(rows.select("lang", "phrase", F.array_repeat(F.lit(0).cast("long"), 2 * F.size(F.split(F.col("phrase").cast("string"), " ")) - 1).alias("f")), "read")
    for shard in range(shards):
        if shards > 1:
            kept = known[shard].toArrow()
            hash_ = PerfectHash(kept["key"].to_numpy().view(np.uint64))
            counts = np.zeros(len(hash_.keys), np.int64)
            counts[hash_.slots(kept["key"].to_numpy().view(np.uint64))] = kept["n"].to_numpy()
        else:
            counts = held["counts"]
        read = saved(read_counts(rows, seed, share(hash_), share(counts)), "read")
        discard(rows)
        rows = read
    discard(every, *phrases, *known)
    return rows


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, text: str = "text", lang: str = "lang", keys: int = KEYS) -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    if least < 1:
        raise ValueError("least must be at least 1")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    table = saved(coded(texts), "coded", compression="zstd")
    words = saved(word_counts(table), "words")
    usual = words.where(F.col("n") >= least)
    for seed in range(SEEDS):
        try:
            rows = counted_candidates(table, usual, least, keys, seed)
            break
        except SharedKey:
            if seed == SEEDS - 1:
                raise
    phrases = saved(scored(rows, least, scale), "scored")
    discard(table, rows)
    longer = phrases.select("lang", F.explode("inner").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("most"), F.lit(0)) * 5 < F.col("a") * 4)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = saved(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, phrases)
    return out


def keyed_words(words: DataFrame, seed: int) -> DataFrame:
    """(key) of ``words(lang, word)``."""
    arrow = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, rows=50_000):
            start = {lang: start_of(lang, seed) for lang in set(cols["lang"])}
            lanes = onward(np.concatenate([start[x] for x in cols["lang"]], 1), hashed(cols["word"], seed))
            yield pa.RecordBatch.from_pydict({"key": lanes[0].view(np.int64)}, schema=arrow)

    return words.select("lang", "word").mapInArrow(run, "key long")


#: The query's rows as DuckDB SQL: phrases of all lengths by groups.
ORACLE = """
WITH pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
split AS (SELECT p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 5) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, w, c, array_to_string(w[:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM cand, range(1, 4) t(c) WHERE c < k),
scores AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score, c FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 4) t(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
