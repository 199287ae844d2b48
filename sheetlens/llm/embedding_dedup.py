"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Codes: unit vectors of a bounded sample are centred and projected on their principal axes;
iterative quantisation turns the axes until the signs lose least, and each bit is cut at its median,
so bits are balanced. Vectors of fewer than ``BITS`` dimensions get several turns, each from its own start, so all have
``BITS`` bits. A dense group would pull centre and cuts into itself, and its codes would scatter; so of the sample only vectors
are fitted on whose cosine with all before them is below ``APART``; where they are few, seeded random directions fill them up, so that no rotation is learned
from a handful of points and no cut runs through the only groups there are. Every vector is encoded.

Then misses are measured: sampled vectors are turned by the threshold's angle, and the share of these pairs that no table brings together is counted. While it is
above ``MISS``, another set of codes, from a rotation with another start, adds its tables.

Retrieval: a code is cut into ``TABLES`` parts, and a table's buckets hold the vectors of one label, one length and one part. Two
vectors meet in the first table in which their parts differ in one bit at most; codes that differ in fewer than
2 x ``TABLES`` bits always meet. Pairs all of whose codes are more than ``FAR`` bits apart are left out, the others are compared by the
cosine of their vectors in double precision.

A pair of buckets with few pairs gives these as rows. One with many, as a group of near copies makes, is
compared in blocks: a task multiplies two blocks of vectors and adds up each vector's links; it puts out these sums and
for each vector one that it is joined with, so neither a row for each pair is made nor a bucket met in one task. Both ways count each pair once.

Equal vectors of a label are one node with a count. They are linked with each other without being
expanded into pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label, link with nothing: no links, their own component, kept. Vectors of different lengths
link with nothing. Every row counts as a vector, also rows that repeat an id; a row without id takes
part, and its component's id is the smallest id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, saved
from .components import connected_components
from .vectors import finite, sample_matrix, unit_rows

BITS = 64
TABLES = 5
FAR = 20
#: Pairs of buckets with at least so many pairs are compared in blocks,
DENSE = 1024
#: of about so many vectors.
BLOCK = 256
APART = 0.9
#: Of pairs just at the threshold, the tables may miss so many; ``SETS`` is a guard.
MISS, SETS = 1e-4, 8


def turned_axes(x: np.ndarray, bits: int, rounds: int, seed: int = 11) -> np.ndarray:
    """Projection of centred rows on turned principal axes, ``bits`` columns: as many turns, each from its own start, as that takes."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v, rng, found = x @ axes, np.random.default_rng(seed), []
    for _ in range(-(-bits // v.shape[1])):
        turn, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        found.append(axes @ turn)
    return np.concatenate(found, 1)[:, :bits]


def leaders(x: np.ndarray, step: int = 500) -> np.ndarray:
    """Unit rows whose cosine with all rows kept before them is below ``APART``."""
    kept = x[:0]
    for at in range(0, len(x), step):
        block = x[at : at + step]
        if len(kept):
            block = block[(block @ kept.T).max(1) < APART]
        close, free = block @ block.T >= APART, np.ones(len(block), bool)
        for i in range(len(block)):
            if free[i]:
                free[i + 1 :] &= ~close[i, i + 1 :]
        kept = np.concatenate([kept, block[free]])
    return kept


def learn_codes(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, projection, cuts) of iterative quantisation, from a sample of vectors."""
    if not len(sample):
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    x = leaders(unit_rows(sample))
    if len(x) < 4 * bits:
        x = np.concatenate([x, unit_rows(np.random.default_rng(seed + 1).normal(size=(4 * bits - len(x), x.shape[1])))])
    centre = x.mean(0)
    projection = turned_axes(x - centre, bits, rounds, seed)
    return centre, projection, np.median((x - centre) @ projection, axis=0)


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes of unit rows as signed 64-bit integers; rows of another length are cut or padded with zeros."""
    centre, projection, cuts = model
    if len(centre) == 0:
        return np.zeros(len(x), np.int64)
    y = np.zeros((len(x), len(centre)))
    y[:, : x.shape[1]] = x[:, : len(centre)]
    on = (y - centre) @ projection > cuts
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def turned_pairs(x: np.ndarray, threshold: float, pairs: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and each turned by the threshold's angle in a random direction."""
    rng = np.random.default_rng(5)
    x = x[rng.integers(0, len(x), pairs if x.shape[1] < 1000 else pairs // 10)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 5e-324)
    return x, threshold * x + (1 - threshold**2) ** 0.5 * away


def learn_sets(sample: np.ndarray, threshold: float, tables: int = TABLES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Models of as many sets of codes as bring the measured misses below ``MISS``."""
    models = [learn_codes(sample)]
    if not len(sample) or sample.shape[1] < 2:
        return models
    x, y = turned_pairs(unit_rows(sample), threshold)
    missed = np.ones(len(x), bool)
    while True:
        xor = encode(x, models[-1]).view(np.uint64) ^ encode(y, models[-1]).view(np.uint64)
        missed &= ~met_before(xor[None], tables, [(0, *part) for part in masks(tables)])
        if missed.mean() <= MISS or len(models) == SETS:
            return models
        models.append(learn_codes(sample, seed=11 + 97 * len(models)))


def masks(tables: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each table's part."""
    edges = [t * BITS // tables for t in range(tables + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def met_before(xor: np.ndarray, table: int, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether codes that differ by ``xor``, by set, meet in a table before ``table``; ``parts`` are the tables' (set, first bit, bits)."""
    before = np.zeros(xor.shape[1:], bool)
    for number, first, width in parts[:table]:
        part = (xor[number] >> np.uint64(first)) & np.uint64((1 << width) - 1)
        before |= (part & (part - np.uint64(1))) == 0  # no bit or one
    return before


class Links:
    """What a task finds: for each node its links, counted with copies, and a spanning forest."""

    def __init__(self):
        self.count: dict[int, int] = defaultdict(int)
        self.parent: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.parent
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                self.forest.append((x, y))

    def counted(self, nodes: np.ndarray, n: np.ndarray) -> None:
        for x, k in zip(nodes.tolist(), n.tolist(), strict=True):
            if k:
                self.count[x] += k

    def rows(self) -> dict[str, list]:
        n, f = len(self.count), self.forest
        return {"a": [*self.count, *(x for x, _ in f)], "b": [None] * n + [y for _, y in f], "n": [*self.count.values(), *[None] * len(f)]}


def link_rows(df: DataFrame, take) -> DataFrame:
    """(a, null, n): links of a node counted by a task; (a, b, null): nodes that links join, enough for the components. ``take(links, batch)`` finds them."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            take(links, batch)
            if len(links.parent) > 1_000_000:
                yield pa.RecordBatch.from_pydict(links.rows(), schema=arrow)
                links = Links()
        yield pa.RecordBatch.from_pydict(links.rows(), schema=arrow)

    return df.mapInArrow(run, "a long, b long, n long")


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def few_pairs(threshold: float):
    """Rows (a, b, copies_a, copies_b, unit_a, unit_b) of vectors of one length: their cosines, many at a time."""

    def take(links: Links, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, 5000):
            cols = batch.slice(at, 5000).to_pydict()
            sizes = np.array([len(x) for x in cols["unit_a"]])
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                x, y = (matrix([cols[c][i] for i in some]) for c in ("unit_a", "unit_b"))
                near = some[np.einsum("ij,ij->i", x, y) >= threshold]
                a, b, ca, cb = (np.array(cols[c], np.int64)[near] for c in ("a", "b", "copies_a", "copies_b"))
                links.counted(a, cb)
                links.counted(b, ca)
                links.add(a, b)

    return take


def joined(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the nodes ``a`` and ``b`` the smallest node that it reaches by the links ``near`` between them."""
    none = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(near, a[:, None], none).min(0))
        new_a = np.minimum(a, np.where(near, new_b[None, :], none).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def block_pairs(threshold: float, parts: list[tuple[int, int, int]], far: int):
    """Rows (t, same, block_a, block_b): all pairs of two blocks that meet in table ``t`` first."""

    def take(links: Links, batch: pa.RecordBatch) -> None:
        for row in range(batch.num_rows):
            r = {k: v[0] for k, v in batch.slice(row, 1).to_pydict().items()}
            (a, ca, na, x), (b, cb, nb, y) = (
                (np.array([m["node"] for m in block]), np.array([m["code"] for m in block], np.int64).view(np.uint64).T, np.array([m["copies"] for m in block], np.int64), matrix([m["unit"] for m in block]))
                for block in (r["block_a"], r["block_b"])
            )
            xor = ca[:, :, None] ^ cb[:, None, :]
            near = (x @ y.T >= threshold) & (np.bitwise_count(xor).min(0) <= far) & ~met_before(xor, r["t"], parts)
            if r["same"]:
                near &= a[:, None] < b[None, :]
            links.counted(a, near @ nb)
            links.counted(b, na @ near)
            for nodes, least in zip((a, b), joined(near, a, b), strict=True):
                links.add(nodes[least < nodes], least[least < nodes])

    return take


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, sample: int = 20_000, tables: int = TABLES, far: int = FAR, dense: int = DENSE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    usable = finite("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    good = rows.where(usable).withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))  # -0.0 becomes 0.0
    keyed = good.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "v", "label")})
    nodes = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = spark.sparkContext.broadcast(learn_sets(sample_matrix(nodes, "v", sample), threshold, tables))  # matrices of the vectors' length x BITS

    def make_codes():
        def codes(cols):
            n = len(cols["v"])
            unit, code = [None] * n, np.zeros((n, len(shared.value)), np.int64)
            sizes = np.array([len(v) for v in cols["v"]])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit_rows(np.array([cols["v"][i] for i in at], float))
                code[at] = np.stack([encode(x, model) for model in shared.value], 1)
                for i, row in zip(at, x, strict=True):
                    unit[i] = row.tobytes()
            return {"node": cols["node"], "copies": cols["copies"], "part": [f"{size}:{x}" for size, x in zip(sizes, cols["label"], strict=True)], "code": code.tolist(), "unit": unit}

        return codes

    coded = saved(map_rows(nodes.select("node", "copies", "label", "v"), make_codes, "node long, copies long, part string, code array<long>, unit binary", rows=5000), "codes")
    found = saved(found_links(coded, threshold, tables, far, dense, len(shared.value)), "links")
    roots = saved(connected_components(found.where("n IS NULL").select("a", "b")), "roots")
    degree = saved(found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others")), "degree")
    placed = saved(nodes.select("k1", "k2", "node", "copies", "least").join(roots, "node", "left").join(degree, "node", "left")
                   .select("k1", "k2", "least", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    result = saved(placed.join(least, "root").select("k1", "k2", "n_links", "component_id"), "result")
    discard(nodes, coded, found, roots, degree, placed)
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.select("vec_id", "k1", "k2").join(result, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(alone)


def found_links(coded: DataFrame, threshold: float, tables: int, far: int, dense: int, sets: int = 1) -> DataFrame:
    """``link_rows`` of all pairs of ``coded(node, copies, part, code, unit)`` that meet; ``part`` is what both must share, ``code`` has a code of each set."""
    parts = [(number, *part) for number in range(sets) for part in masks(tables)]
    tables = len(parts)
    at = lambda code, t: F.shiftrightunsigned(code[parts[t][0]], parts[t][1]).bitwiseAND(F.lit((1 << parts[t][2]) - 1))
    place = ["part", "t", "bits"]
    entries = coded.select("node", "code", "part", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), at(F.col("code"), t).alias("bits")) for t in range(tables)))).alias("e")).select("node", "code", "part", "e.*")
    buckets = saved(entries.groupBy(*place).agg(F.count("*").alias("n")), "buckets")
    # each bucket meets itself and those whose part has one bit more
    width = max(w for _, _, w in parts)
    other = buckets.withColumn("flip", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(width))))).where(F.col("bits").bitwiseAND(F.col("flip")) == 0)
    other = other.select(*place, "n", (F.col("bits") + F.col("flip")).alias("bits_b"))
    meet = saved(other.join(buckets.withColumnsRenamed({"bits": "bits_b", "n": "n_b"}), ["part", "t", "bits_b"]).where((F.col("bits") != F.col("bits_b")) | (F.col("n") > 1)), "meet")

    def earlier(xor: list[Column]) -> Column:
        """Whether codes that differ by ``xor``, by set, meet in a table before ``t``."""
        return F.array_max(F.array(F.lit(False), *((F.col("t") > t) & (F.bit_count(at(xor, t)) <= 1) for t in range(tables - 1))))

    pairs = F.col("n") * F.col("n_b")
    side = lambda s, **names: entries.withColumnsRenamed({"node": s, "code": f"code_{s}", **names})
    xor = [F.col("code_a")[n].bitwiseXOR(F.col("code_b")[n]) for n in range(sets)]
    once = (F.col("bits") != F.col("bits_b")) | (F.col("a") < F.col("b"))
    few = side("a").join(meet.where(pairs < dense), place).join(side("b", bits="bits_b"), ["part", "t", "bits_b"]).where(once & (F.array_min(F.array(*map(F.bit_count, xor))) <= far) & ~earlier(xor)).select("a", "b")
    few = saved(few, "pairs")
    for s in "ab":
        few = few.join(coded.select(F.col("node").alias(s), F.col("copies").alias(f"copies_{s}"), F.col("unit").alias(f"unit_{s}")), s)
    found = link_rows(few, few_pairs(threshold))

    many = saved(meet.where(pairs >= dense), "dense")
    if many.isEmpty():
        return found
    full = saved(many.select(*place, "n").unionByName(many.select("part", "t", F.col("bits_b").alias("bits"), F.col("n_b").alias("n"))).distinct(), "full")
    members = entries.join(full, place).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).join(coded.select("node", "copies", "unit"), "node")
    blocks = saved(members.groupBy(*place, "block").agg(F.collect_list(F.struct("node", "code", "copies", "unit")).alias("members")), "blocks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1)
    tiles = many.withColumn("block_no_a", F.explode(upto("n"))).withColumn("block_no_b", F.explode(upto("n_b"))).withColumn("same", F.col("bits") == F.col("bits_b"))
    # inside a bucket two blocks meet once; a block with itself counts each pair once
    tiles = tiles.where(~F.col("same") | (F.col("block_no_a") <= F.col("block_no_b"))).withColumn("same", F.col("same") & (F.col("block_no_a") == F.col("block_no_b")))
    tiles = tiles.join(blocks.withColumnsRenamed({"block": "block_no_a", "members": "block_a"}), [*place, "block_no_a"])
    tiles = tiles.join(blocks.withColumnsRenamed({"bits": "bits_b", "block": "block_no_b", "members": "block_b"}), ["part", "t", "bits_b", "block_no_b"])
    return found.unionByName(link_rows(tiles.select("t", "same", "block_a", "block_b"), block_pairs(threshold, parts, far)))


#: The query's rows as DuckDB SQL: all pairs of a label, and the smallest id that links reach.
ORACLE = """
WITH RECURSIVE good AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT * FROM good WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN good ON good.r = reach.b GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM good JOIN least USING (r) LEFT JOIN degree USING (r)"""
