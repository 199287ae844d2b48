"""Best-fit packing of tokenised documents after a Martello-Toth reduction.

Only piece lengths matter for the packing, and there are at most ``capacity`` different ones. So
the whole instance is the histogram of lengths, which is bounded whatever the input's size. The
reduction and the best fit run on it with multiplicities:

* reduction: for the largest length left, the sets it can stand in are looked at in the order of
  Martello and Toth. A set that dominates all others is fixed for as many copies as there are:
  alone if nothing fits beside it; with a partner that fills the sequence exactly; with the
  largest fitting partner if no two others fit together beside it; with the largest partner if that is no shorter
  than the best fitting pair;
* what no criterion fixes is packed by best fit, longest first, again a whole class at a time.

The result is a list of slots: for a length, a range of ranks that go to consecutive sequences at
one offset. Ranks are dealt inside (length, salt) cells and offset by the cells' counts; salts are by row, also for equal
rows, and there are as many as keep a cell at about ``CELL`` rows, so a
length that a third of the pieces share is spread over many tasks. A full piece needs no rank: it is a
sequence of its own (numbered from -1 down), which every packing shares.

Defined results: a null text is an empty one (one token, the end mark). Equal lengths are
interchangeable; their order is by salt and row and does not change the number of sequences. Rows
with equal ids are packed as separate documents. An empty table packs to nothing.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, saved

END = 2
#: So many pieces of one length are ranked in one task, about.
CELL = 200_000


#: Fixed value: how this vocabulary splits a text before merging bytes.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of texts, remembered for each word after a space.

    In this vocabulary a single space before another character always begins a token, and no token
    holds a space further on. So a text without runs of spaces is encoded word by word, and words that
    are new are encoded many at a time, as one text that is cut before each token with a space.
    The vocabulary's ids are its merge order, so a rank-based encoder gives the ids of the file's
    own tokenizer; the two are compared on a probe when it is loaded. A text that holds one of the file's added tokens
    (as ``<|endoftext|>``) is given to the file's tokenizer itself, which knows them.
    """

    LIMIT = 500_000
    #: Runs of white space so long are not given to the pattern.
    RUN = 2000
    RUNS = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")  # white space as the pattern's engine has it
    PROBE = "It's 12 words,  don't\n\tspace  d\u00e9j\u00e0 \u65e5\u672c\U0001f600 $x_1#"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        vocab = slow.get_vocab()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        special = {t.content for t in slow.get_added_tokens_decoder().values()}
        self.slow, self.special = slow, re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}
        if self.fast.encode_ordinary(self.PROBE) != slow.encode(self.PROBE, add_special_tokens=False).ids:
            raise ValueError(f"the ids of {path} are not its merge order")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.in_parts(t) if len(t) > self.RUN and self.RUNS.search(t) else self.fast.encode_ordinary(t), "<u4") for t in texts]

    def in_parts(self, text: str) -> list[int]:
        """Ids of a text with long runs of white space, on which the pattern's engine would run out of stack.

        The pattern takes all of a run but its last character as one part, or the whole run at the text's end; so a text can be cut before and after that part.
        What of the run is left has one character, and the parts on both sides split as they do in the whole text.
        """
        ids, at = [], 0
        for run in self.RUNS.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.fast.encode_ordinary(text[at : run.start()])
            ids += self.merged(text[run.start() : stop])
            at = stop
        return ids + self.fast.encode_ordinary(text[at:])

    def merged(self, part: str) -> list[int]:
        """Ids of one part of the split."""
        return self.fast._encode_single_piece(part)

    def learn(self, words: list[str], at_once: int = 500) -> None:
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for group, ids in zip(groups, self.whole([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(group):
                data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                self.known.update(zip(group, map(data.__getitem__, map(slice, (4 * starts).tolist(), ends)), strict=True))
            else:  # a word of white space other than a space
                self.known.update(zip(group, (x.tobytes() for x in self.whole([" " + w for w in group])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if self.special.search(t)] if self.special else []
        if not marked:
            return self.ordinary(texts)
        out = self.ordinary(["" if self.special.search(t) else t for t in texts])
        for i in marked:
            out[i] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def ordinary(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        get, known = self.known.get, self.known
        plain = ["  " not in t and not t[-1:].isspace() for t in texts]
        # what is not plain, and each plain text's first word, which no space precedes
        firsts = self.whole([t.partition(" ")[0] if ok else t for t, ok in zip(texts, plain, strict=True)])
        rest = [t.split(" ")[1:] if ok else [] for t, ok in zip(texts, plain, strict=True)]
        found = [list(map(get, words)) for words in rest]
        new = {w for words, ids in zip(rest, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        self.learn(list(new))
        return [first.tobytes() + b"".join(ids if None not in ids else map(known.__getitem__, words)) for first, words, ids in zip(firsts, rest, found, strict=True)]


_IDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document of at most ``capacity`` tokens (its end mark included) is one piece; a longer one is
    cut so that all pieces but the first are full.
    """
    end = np.array([END], "<u4").tobytes()

    def make():
        ids = _IDS.get(tokenizer_path) or _IDS.setdefault(tokenizer_path, WordIds(tokenizer_path))

        def cut(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for key, data in zip(cols["doc_id"], ids.encode([t or "" for t in cols["text"]]), strict=True):
                data += end
                n = len(data) // 4
                at, length = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    for k, v in zip(out, (key, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)])), strict=True):
                        out[k].append(v)
                    at, length = at + length, capacity
            return out

        return cut

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", rows=1000)


def reduce_and_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for all items of a histogram of lengths."""
    left = {s: n for s, n in histogram.items() if n}
    sizes = sorted(left)
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(*items: int) -> None:
        n = min(left[s] // items.count(s) for s in set(items))
        fixed.append((n, items))
        for s in items:
            left[s] -= n
        for s in set(items):
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))

    def largest(limit: int, *taken: int) -> int | None:
        """The largest length up to ``limit`` of which there are more copies than are taken."""
        i = bisect.bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] <= taken.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, *taken: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(left[s] - taken.count(s), k - len(out))
            if len(out) == k:
                break
        return out

    def dominating(big: int) -> tuple[int, ...] | None:
        """The set with ``big`` that dominates all others, among sets of up to three; None if no criterion shows one."""
        room = capacity - big
        one = largest(room, big)
        if one is None:
            return (big,)
        beside = smallest(3, big)
        if one == room or len(beside) < 2 or sum(beside[:2]) > room:  # fills it, or no two fit
            return (big, one)
        if len(beside) == 3 and sum(beside) <= room:
            return None
        best = 0  # at most two fit: the best pair against the best single
        for s in sizes[: bisect.bisect_right(sizes, room)]:
            if left[s] > (s == big) and (other := largest(room - s, s, big)) is not None:
                best = max(best, s + other)
        return (big, one) if one >= best else None

    # what is not decided stays among the partners of the others; a fixed set may decide it, so until nothing changes
    changed = True
    while changed:
        changed = False
        for big in sizes[::-1]:
            while big in left and (items := dominating(big)):
                fix(*items)
                changed = True
    return fixed + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, with whole classes of equal lengths and equal bins at a time."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # room -> groups of equal bins
    rooms: list[int] = []

    def put(room: int, n: int, items: tuple[int, ...]) -> None:
        if not bins[room]:
            bisect.insort(rooms, room)
        bins[room].append((n, items))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if n >= each:
                    put(capacity - s * each, n // each, (s,) * each)
                    n %= each
                else:
                    put(capacity - s * n, 1, (s,) * n)
                    n = 0
                continue
            room = rooms[i]
            groups = bins[room]
            have, items = groups.pop()
            if not groups:
                rooms.pop(i)
            each = room // s
            if n >= each:
                used = min(have, n // each)
                put(room - s * each, used, items + (s,) * each)
                n -= used * each
            else:
                used = 1
                put(room - s * n, 1, items + (s,) * n)
                n = 0
            if have > used:
                put(room, have - used, items)
    return [g for groups in bins.values() for g in groups]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), sorted by rank."""
    rank: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for n, items in plan:
        at = 0
        for s in items:
            rows[s].append((rank[s], sequence, at))
            rank[s] += n
            at += s
        sequence += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """All pieces with the sequence and the offset at which each stands."""
    cut = saved(pieces(docs, tokenizer_path, capacity, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer than ``capacity`` rows
    salts = max(16, -(-max(histogram.values(), default=0) // cell))
    plan = slots(reduce_and_fit(dict(histogram), capacity))
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by ``capacity`` and by the plan's slots

    def make():
        plan = shared.value

        def place(cols):
            length, rank = np.array(cols["length"], np.int64), np.array(cols["rank"], np.int64) - 1
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rows = plan[int(s)]
                i = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at], offset[at] = rows[i, 1] + rank[at] - rows[i, 0], rows[i, 2]
            out = {k: cols[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            return out | {"sequence_id": sequence.tolist(), "offset": offset.tolist()}

        return place

    salted = rest.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    before = cells.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "row", "before")
    placed = map_rows(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=20000)
    alone = full.drop("row").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone)
