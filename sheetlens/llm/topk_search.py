"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are integers by component ("terms"). Documents are reordered by their nearest of
``CLUSTERS`` centres (fitted on a bounded sample) and cut into blocks of about ``BLOCK`` documents; a
block keeps its forward index (ids and vectors) and each term's largest and smallest value. For a query, a
block's bound is the sum over terms of the query's weight times the larger or the
smaller of these, which no score in the block exceeds.

First round: every query scores the ``FIRST`` blocks with the highest bounds, which gives a
k-th score. Second round: of the other blocks, those whose bound is not below that k-th score are scored; all
others cannot hold a result. Queries travel in chunks, so bounds and scores are matrix products.

Ties go to the smaller id: a block whose bound equals the k-th score is still scored. A query's own row
never counts; rows that repeat its id are its own too.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id. Vectors of another length than the most common one are padded with zeros or, if longer, searched with
their further components among vectors that have them. Integer components and scores beyond the range of a long count as
its nearest end; such scores are equal and tie. Equal vectors are all candidates, also rows that repeat an id. Rows that repeat
a query's id are searched each, and share the query's ranks. An empty table, or no query, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, saved
from .vectors import finite, sample_matrix

BLOCK = 512
CLUSTERS = 32
CHUNK = 256
FIRST = 3
GROUP = 512
#: So many chunks of queries meet a group of blocks in one task.
SALTED = 64


def centres(sample: np.ndarray, k: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Plain k-means on a sample."""
    if not len(sample):
        return np.zeros((1, 1))
    rng = np.random.default_rng(5)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = np.argmin((c * c).sum(1) - 2 * sample @ c.T, 1)
        c = np.array([sample[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
    return c


LONGEST = np.iinfo(np.int64).max


def integers(x: np.ndarray) -> np.ndarray:
    """Doubles as Python integers in the range of a long."""
    return np.array([min(max(int(v), -LONGEST - 1), LONGEST) for v in x.ravel()], object).reshape(x.shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers held as doubles, exact: in doubles while no sum can pass 2^53, else in Python integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return integers(a) @ integers(b).T


def in_range(s: np.ndarray) -> np.ndarray:
    """Scores, those beyond the range of a long at its end."""
    return s if s.dtype != object else np.minimum(np.maximum(s, -LONGEST - 1), LONGEST)


def pack(rows: DataFrame, by: str, width: int) -> DataFrame:
    """One row per value of ``by`` (groups of bounded expected size): ids and the matrix of their vectors."""

    def make():
        def packed(cols):
            out = {by: cols[by], "ids": [], "matrix": [], "high": [], "low": []}
            for members in cols["members"]:
                x = np.zeros((len(members), width))
                for i, m in enumerate(members):
                    x[i, : len(m["q"])] = m["q"]
                out["ids"].append([m["vec_id"] for m in members])
                out["matrix"].append(x.tobytes())
                out["high"].append(x.max(0).tolist())
                out["low"].append(x.min(0).tolist())
            return out

        return packed

    grouped = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("vec_id", "q"))).alias("members"))
    return map_rows(grouped, make, f"{by} long, ids array<long>, matrix binary, high array<double>, low array<double>", rows=16)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows by inner product of ``floor(scale * x)``."""
    ids = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = ids.where(finite(embedding) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col("_query").alias("query"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("q"))
    size = rows.agg(F.max(F.size("q")), F.count("*"), F.count_if("query")).first()
    width, n, n_queries = size[0] or 1, size[1], size[2]
    shared = vectors.sparkSession.sparkContext.broadcast(centres(sample_matrix(rows, "q", sample)))  # CLUSTERS vectors

    def make_clusters():
        def clusters(cols):
            c = shared.value
            x = np.zeros((len(cols["q"]), c.shape[1]))
            for i, v in enumerate(cols["q"]):
                x[i, : len(v)] = v[: c.shape[1]]
            return {**cols, "cluster": np.argmin((c * c).sum(1) - 2 * x @ c.T, 1).tolist()}

        return clusters

    placed = map_rows(rows, make_clusters, "vec_id long, query boolean, q array<double>, cluster int", rows=5000)
    placed = saved(placed.withColumn("row", F.monotonically_increasing_id()), "clusters")  # rows of one id are dealt apart
    cuts = {r[0]: math.ceil(r[1] / BLOCK) for r in placed.groupBy("cluster").count().collect()}  # CLUSTERS rows
    most = max([1, *cuts.values()])
    split = F.element_at(F.create_map(*(F.lit(x) for c, m in sorted(cuts.items()) for x in (c, m))), F.col("cluster")) if cuts else F.lit(1)
    block = F.col("cluster") * F.lit(most).cast("long") + F.pmod(F.xxhash64("row"), split)
    index = saved(pack(placed.withColumn("block", block), "block", width), "blocks")
    chunks = max(1, math.ceil(n_queries / CHUNK))
    queries = saved(pack(placed.where("query").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(chunks))), "chunk", width), "queries")
    groups = max(1, math.ceil(sum(cuts.values()) / GROUP))
    # chunks meet groups of blocks in as many tasks as there are groups and salts
    salts = max(1, math.ceil(chunks / SALTED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    grouped = index.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("grp").agg(F.collect_list(F.struct("block", "high", "low")).alias("blocks"))
    summaries = saved(grouped.withColumn("salt", every(salts)), "summaries")
    asked = queries.select("chunk", "ids", "matrix", F.pmod("chunk", F.lit(salts)).alias("salt")).withColumn("grp", every(groups))

    def bounds(cols, i):
        x = np.frombuffer(cols["matrix"][i]).reshape(-1, width)
        names = np.array([b["block"] for b in cols["blocks"][i]])
        high, low = (np.array([b[s] for b in cols["blocks"][i]]) for s in ("high", "low"))
        positive, negative = product(np.maximum(x, 0), high), product(np.minimum(x, 0), low)
        if positive.dtype != negative.dtype:  # Python integers beside doubles that hold integers exactly
            positive, negative = (m if m.dtype == object else integers(m) for m in (positive, negative))
        return names, in_range(positive + negative)

    def make_best():
        def best(cols):
            out = {"query_id": [], "chunk": [], "block": [], "bound": []}
            for i in range(len(cols["ids"])):
                names, b = bounds(cols, i)
                for q, row in zip(cols["ids"][i], b, strict=True):
                    for j in sorted(range(len(names)), key=lambda j: (-row[j], names[j]))[:FIRST]:
                        for key, v in zip(out, (q, cols["chunk"][i], int(names[j]), float(row[j])), strict=True):
                            out[key].append(v)
            return out

        return best

    def first_of(df: DataFrame, by: str, n: int, *order) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)

    each = map_rows(asked.join(summaries, ["grp", "salt"]).select("chunk", "ids", "matrix", "blocks"), make_best, "query_id long, chunk long, block long, bound double", rows=4)
    first = saved(first_of(each, "query_id", FIRST, F.desc("bound"), "block").select("query_id", "chunk", "block"), "first")

    def make_scores():
        def scores(cols):
            out = {"query_id": [], "vec_id": [], "score": []}
            for i in range(len(cols["wanted"])):
                queries = np.array(cols["ids"][i], np.int64)
                x = np.frombuffer(cols["matrix"][i]).reshape(-1, width)
                docs, y = np.array(cols["doc_ids"][i], np.int64), np.frombuffer(cols["docs"][i]).reshape(-1, width)
                low = dict(zip((w["query_id"] for w in cols["wanted"][i]), (w["least"] for w in cols["wanted"][i]), strict=True))
                use = np.flatnonzero(np.isin(queries, list(low)))
                s = in_range(product(x[use], y))
                for q, row in zip(queries[use].tolist(), s, strict=True):
                    ok = np.flatnonzero((docs != q) & (row >= (-np.inf if low[q] is None else low[q])))
                    best = sorted(ok.tolist(), key=lambda j: (-row[j], docs[j]))[:k]
                    out["query_id"] += [q] * len(best)
                    out["vec_id"] += docs[best].tolist()
                    out["score"] += [int(row[j]) for j in best]
            return out

        return scores

    def scored(wanted: DataFrame) -> DataFrame:
        """Per query and block of ``wanted(query_id, chunk, block, least)``, the k best scores of at least ``least``."""
        lists = wanted.groupBy("chunk", "block").agg(F.collect_list(F.struct("query_id", "least")).alias("wanted"))  # at most a chunk's queries
        full = lists.join(queries.select("chunk", "ids", "matrix"), "chunk").join(index.select("block", F.col("ids").alias("doc_ids"), F.col("matrix").alias("docs")), "block")
        return map_rows(full.select("wanted", "ids", "matrix", "doc_ids", "docs"), make_scores, "query_id long, vec_id long, score long", rows=8)

    best = (F.desc("score"), "vec_id")
    so_far = saved(first_of(scored(first.withColumn("least", F.lit(None).cast("long"))), "query_id", k, *best), "so_far")
    kth = so_far.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # a chunk's k-th scores travel with the chunk
    done = saved(first.groupBy("query_id", "chunk").agg(F.collect_list("block").alias("done")).join(kth, "query_id", "left")
                 .groupBy("chunk").agg(F.collect_list(F.struct("query_id", "least", "done")).alias("state")), "state")

    def make_rest():
        def rest(cols):
            out = {"query_id": [], "chunk": [], "block": [], "least": []}
            for i in range(len(cols["ids"])):
                names, b = bounds(cols, i)
                state = {s["query_id"]: s for s in cols["state"][i]}
                for q, row in zip(cols["ids"][i], b, strict=True):
                    least, done = state[q]["least"], set(state[q]["done"])
                    for j in np.flatnonzero(row >= (-np.inf if least is None else least)).tolist():
                        if (name := int(names[j])) not in done:
                            for key, v in zip(out, (q, cols["chunk"][i], name, least), strict=True):
                                out[key].append(v)
            return out

        return rest

    again = map_rows(asked.join(summaries, ["grp", "salt"]).join(done, "chunk").select("chunk", "ids", "matrix", "blocks", "state"), make_rest, "query_id long, chunk long, block long, least long", rows=4)
    again = saved(again, "again")
    more = scored(again)
    result = first_of(so_far.drop("rank").unionByName(more), "query_id", k, *best)
    result = saved(result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
    discard(placed, index, queries, summaries, first, so_far, done, again)
    return result


#: The query's rows as DuckDB SQL.
ORACLE = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scores QUALIFY rank <= 5"""
