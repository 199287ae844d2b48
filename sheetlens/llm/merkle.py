"""A Merkle manifest of a dataset: a proof for each document, by superblock reduction.

A leaf is the SHA-256 of a document's fields, each written with its length. In each source the leaves ascend by id; every
``FANOUT`` consecutive nodes become the hash of their digests in a row until one is left, the source's root. The
roots of the sources, in the order of the sources, become the root of the dataset in the same way.

Places: rows are dealt by ranges of (source, id, leaf), so equal ids stand beside each other and a large source is
spread over many tasks; a row's place in its source is its place in the task and the number of the source's rows in tasks before
it. Superblocks: a place divided by ``FANOUT`` to the power ``LEVELS`` names a bucket. A bucket is one group, of a bounded
number of nodes, which pandas collapses by ``LEVELS`` levels to one root; the roots of the buckets are nodes again, until
each source has one. So no group grows with the data, and a tree of n leaves takes log(n) / log(FANOUT ** LEVELS) rounds.

Proofs: a step of a proof is the place of a node in its run and the run's digests. The steps above a bucket are the same for
all its members, so they are put together from the top down over buckets alone; only where the leaves are read again does each leaf's
lower proof (inside its bucket) meet the upper one. So no proof is shuffled for each document, and a proof is hashed where it is made.

Defined results: null fields are written as ``-``, so null and empty texts differ. A null source comes first, a null id first in its
source; rows of equal ids stand in the order of their leaves, and equal rows get neighbouring places. The one leaf of a source is its
root, the one source's root the dataset's. Ids are written in decimal, texts in UTF-8. Columns that ``fields`` does not name are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import discard, saved

FANOUT = 16
#: So many levels are collapsed in one group: at most FANOUT ** LEVELS nodes.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step: the node's place in its run, and the digests of the whole run.
STEPS = "array<struct<at:int,run:string>>"


def field(col: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields.values())), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels from ``n`` nodes to one."""
    d = 0
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> tuple[str, list[list[str]]]:
    """The root of a bucket, and for each level its runs, each as the digests in a row."""
    floors = []
    for _ in range(levels):
        runs = ["".join(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        floors.append(runs)
        nodes = [digest(r) for r in runs]
    return nodes[0], floors


def steps_of(place: int, floors: list[list[str]], fanout: int = FANOUT) -> list[tuple[int, str]]:
    """The steps of the node at ``place`` of its bucket."""
    out = []
    for runs in floors:
        out.append((place % fanout, runs[place // fanout]))
        place //= fanout
    return out


def siblings(step: tuple[int, str]) -> str:
    at, run = step
    return run[: 64 * at] + run[64 * at + 64 :]


def folded(node: str, steps: list[tuple[int, str]]) -> str:
    """The root that follows from a node and its steps."""
    for at, run in steps:
        node = digest(run[: 64 * at] + node + run[64 * at + 64 :])
    return node


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(s, ..)`` with ``place``, from 0 by ``order`` in each ``s``, and ``n``, the number of rows of ``s``. Equal rows may stand either way.

    A single large ``s`` and a single repeated row are dealt over tasks: rows are ranged by ``order`` and then by where they came from.
    """
    first = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "unplaced")
    tasks = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = first.repartitionByRange(int(tasks), "s", *order, "_row").sortWithinPartitions("s", *order, "_row").drop("_row")
    dealt = saved(ranged.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    parts = dealt.groupBy("s", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("s").orderBy("_task")  # one row for each task that holds the source
    parts = parts.withColumns({"_before": F.sum("_n").over(before) - F.col("_n"), "n": F.sum("_n").over(Window.partitionBy("s"))})
    parts = saved(parts.select("s", "_task", (F.col("_before") - F.col("_first")).alias("_shift"), "n"), "offsets")
    out = saved(dealt.join(parts, ["s", "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift"), "placed")
    discard(first, dealt, parts)
    return out


def bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("place") / F.lit(fanout**levels)).cast("long"))


def upper_tree(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes(s, place, n, digest)``: (s, place, steps) up to the root of ``s``, and (s, root)."""

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        up = min(levels, depth(int(group["n"].iloc[0]), fanout))
        root, floors = collapse(group["digest"].tolist(), up, fanout)
        lower = [[{"at": a, "run": r} for a, r in steps_of(i, floors, fanout)] for i in range(len(group))]
        return pd.DataFrame({"s": group["s"], "place": group["place"], "bucket": key[1], "n": group["n"], "steps": lower, "root": root})

    rounds = []
    while True:
        level = saved(bucketed(nodes, fanout, levels).groupBy("s", "bucket").applyInPandas(reduce, f"s string, place long, bucket long, n long, steps {STEPS}, root string"), "level")
        rounds.append(level)
        if (level.agg(F.max("bucket")).first()[0] or 0) == 0:
            break
        # sources that have one node already keep it: a tree of one node has no levels
        nodes = level.select("s", F.col("bucket").alias("place"), F.ceil(F.col("n") / F.lit(fanout**levels)).cast("long").alias("n"), F.col("root").alias("digest")).distinct()
    top = rounds.pop()
    roots = saved(top.select("s", "root").distinct(), "roots")
    paths = saved(top.select("s", "place", "steps"), "paths")
    while rounds:
        below = rounds.pop()
        above = paths.select("s", F.col("place").alias("bucket"), F.col("steps").alias("upper"))
        longer = saved(below.join(above, ["s", "bucket"]).select("s", "place", F.concat("steps", "upper").alias("steps")), "paths")
        discard(paths, below)
        paths = longer
    discard(top)
    return paths, roots


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", doc_id: str = "doc_id", changed: dict[str, Column] | None = None, suspect: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` gives other values of some fields for the rows of ``suspect``: what a later copy of the dataset holds. Their leaf is
    computed from these, and folded along the proof of the original; a row is verified if that gives the root.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    own = {c: F.col(c) for c in fields}
    other = F.when(F.lit(False) if suspect is None else suspect, leaf(own | (changed or {})))
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(source).cast("string")))  # null first
    leaves = docs.select(key.alias("s"), F.col(doc_id).alias("doc_id"), leaf(own).alias("leaf"), other.alias("other"))
    spots = placed(leaves, ["doc_id", "leaf"])

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        root, _ = collapse(group["leaf"].tolist(), min(levels, depth(int(group["n"].iloc[0]), fanout)), fanout)
        members = [{"doc_id": i, "leaf": a, "other": b} for i, a, b in zip(group["doc_id"], group["leaf"], group["other"], strict=True)]
        return pd.DataFrame({"s": [key[0]], "bucket": [key[1]], "n": group["n"].iloc[:1], "members": [members], "digest": [root]})

    shape = "s string, bucket long, n long, members array<struct<doc_id:string,leaf:string,other:string>>, digest string"
    shown = spots.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make doubles of ids beside null
    buckets = saved(bucketed(shown, fanout, levels).groupBy("s", "bucket").applyInPandas(reduce, shape), "buckets")
    discard(spots)
    paths, subroots = upper_tree(buckets.select("s", F.col("bucket").alias("place"), F.ceil(F.col("n") / F.lit(fanout**levels)).cast("long").alias("n"), "digest"), fanout, levels)
    whole = placed(subroots.select(F.lit("").alias("s"), F.col("s").alias("source"), F.col("root").alias("digest")), ["source"])
    last, root = upper_tree(whole.select("s", "place", "n", "digest"), fanout, levels)
    ends = whole.select("source", "place", "digest").join(last.select("place", "steps"), "place")
    above = saved(
        paths.select("s", F.col("place").alias("bucket"), "steps").join(ends.select(F.col("source").alias("s"), F.col("digest").alias("subroot"), F.col("steps").alias("rest")), "s")
        .select("s", "bucket", "subroot", F.concat("steps", "rest").alias("steps")), "above")
    dataset = (root.select("root").first() or [None])[0]  # one row, or none
    discard(whole, last, root, paths, subroots)

    shape = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow = to_arrow_schema(_parse_datatype_string(shape))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                upper = [(x["at"], x["run"]) for x in row["steps"]]
                tail = "".join(map(siblings, upper))
                nodes = [m["leaf"] for m in row["members"]]
                _, floors = collapse(nodes, min(levels, depth(row["n"], fanout)), fanout)
                out = {k: [] for k in arrow.names}
                for place, m in enumerate(row["members"]):
                    lower = steps_of(place, floors, fanout)
                    got = folded(m["other"] or m["leaf"], [*lower, *upper])
                    proof = digest("".join(map(siblings, lower)) + tail)
                    for k, v in zip(arrow.names, (m["doc_id"], m["leaf"], row["subroot"], dataset, proof, got, got == dataset), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    rows = buckets.select("s", "bucket", "n", "members").join(above, ["s", "bucket"]).select("n", "members", "subroot", "steps")
    return rows.mapInArrow(prove, shape).withColumn("doc_id", F.col("doc_id").cast(kind))


def lowered(col: str) -> Column:
    """A text with A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.col(col), upper, upper.lower())


def oracle() -> str:
    """The query's rows as DuckDB SQL: all nodes level by level, proofs by joins with their runs, folding and CRC-32 by recursion."""
    show = lambda e: f"coalesce(strlen(({e})::VARCHAR) || ':' || ({e})::VARCHAR, '-')"
    hash_of = lambda text: "sha256(" + " || ".join(show(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
sums AS (SELECT doc_id, s, 0 AS k, 4294967295::UBIGINT AS c FROM ids
  UNION ALL SELECT doc_id, s, k + 1, xor(c // 256, t[(xor(c, ascii(s[k + 1])::UBIGINT) % 256 + 1)::BIGINT]) FROM sums, crc WHERE k < length(s)),
fifth AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 5 = 0 AS t FROM sums WHERE k = length(s)),
leaves AS (SELECT d.doc_id, source, {hash_of('text')} AS leaf, CASE WHEN coalesce(t, false) THEN {hash_of(lower)} END AS other FROM documents d LEFT JOIN fifth USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low AS (SELECT 0 AS l, source, i, n, leaf AS h FROM numbered
  UNION ALL SELECT l + 1, source, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, source, i // {FANOUT}, n),
subroots AS (SELECT source, h AS subroot, l AS up, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS l, i, n, subroot AS h FROM subroots
  UNION ALL SELECT l + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // {FANOUT}, n),
runs AS (SELECT l, coalesce('=' || source, '') AS s, i // {FANOUT} AS r, string_agg(h, '' ORDER BY i) AS run FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 100 + l, 'top', i // {FANOUT}, string_agg(h, '' ORDER BY i) FROM high WHERE n > 1 GROUP BY ALL),
tops AS (SELECT h AS root FROM high WHERE n = 1),
paths AS (SELECT k.doc_id, k.leaf, k.other, k.source, k.i, s.subroot, s.i AS si, s.up, row_number() OVER () AS id FROM numbered k JOIN subroots s ON k.source IS NOT DISTINCT FROM s.source),
steps AS (SELECT id, l, (i // pow({FANOUT}, l)::BIGINT) AS at_, coalesce('=' || source, '') AS s FROM paths, range(0, 12) q(l) WHERE l < up
  UNION ALL SELECT id, 100 + l, (si // pow({FANOUT}, l)::BIGINT), 'top' FROM paths, range(0, 12) q(l) WHERE l < (SELECT max(l) FROM high)),
full_ AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY l))::BIGINT AS k, at_ % {FANOUT} AS p, run FROM steps JOIN runs USING (l, s) WHERE at_ // {FANOUT} = r),
proofs AS (SELECT id, list({{'p': p, 'run': run}} ORDER BY k) AS path, string_agg(run[:64 * p] || run[64 * p + 65:], '' ORDER BY k) AS proof FROM full_ GROUP BY id),
fold AS (SELECT id, 0 AS k, coalesce(other, leaf) AS h, path FROM paths LEFT JOIN proofs USING (id)
  UNION ALL SELECT id, k + 1, sha256(path[k + 1].run[:64 * path[k + 1].p] || h || path[k + 1].run[64 * path[k + 1].p + 65:]), path FROM fold WHERE k < coalesce(len(path), 0))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM paths LEFT JOIN proofs USING (id) JOIN fold USING (id) CROSS JOIN tops WHERE k = coalesce(len(fold.path), 0)"""
