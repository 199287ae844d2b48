"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The corpus is a tree, by default domain, language, source. A node's capacity is the tokens of its
leaves times ``epochs``. From the root down, each node's budget is split among its children by weight; a
child that cannot use its share keeps its capacity, and the shortage goes to its siblings by weight.
As a child's capacity is that of its whole subtree, only what no sibling can use is left to
the level above. With children in the order of capacity / weight, the level that the shares
rise to is the largest value of (budget - capacities before) / (weights from here on), so the split is two
window functions over the nodes, not a loop.

Each leaf then takes a token-prefix: as many whole epochs as fit, and of the next the documents
in the order of a seeded hash of epoch and id, as long as their tokens in all do not pass the rest. Prefix sums are not
taken over all rows of a leaf: tokens are summed by the hash's first byte, then inside the one byte
where the prefix ends by the second, and only the hashes that share both bytes with its end are
ordered one by one, after a sum for each. A leaf with a third of all rows is thus never in one task, nor are the rows of one id.

Tokens are runs of characters other than space, tab, carriage return and newline.

Defined results: null texts have no tokens; documents without tokens are taken as long as the prefix
reaches them. Null domains, languages and sources are the node ``none``. A weight that is null or not
above 0 gives nothing. Rows that repeat an id have equal hashes and are taken together or not at all; a null id hashes
as the empty text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def domain_of(source: str) -> Column:
    """Domain of a source ``srcN``: N modulo 4; ``none`` for other names."""
    number = F.expr(f"try_cast(substring(`{source}`, 4) AS BIGINT)")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), F.lit("none"))


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^ \t\r\n]+")), F.lit(0)).cast("long")


def weight_of(col: str, weights: dict[str, float]) -> Column:
    """A node's weight by name, 1 where none is given."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, F.lit(float(w))).otherwise(out)
    return out


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children(parent.., name, weight, capacity, budget)`` with ``share``; ``budget`` is the parent's."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy(*parent))
    leveled = children.where("weight > 0").withColumn("level", (F.col("budget") - before) / onward)
    return leveled.withColumn("share", F.least("capacity", F.greatest(F.lit(0.0), F.col("weight") * level))).drop("level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column, epochs: int) -> DataFrame:
    """``leaves(levels.., tokens)`` with the tokens that each leaf is to give (``share``)."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs).withColumn("root", F.lit(0))
    whole = F.lit(leaves.agg(budget.alias("share")).first()[0])
    path, nodes = ["root"], None
    for name in levels:
        children = leaves.groupBy(*path, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weights[name])
        children = children.withColumn("budget", whole) if nodes is None else children.join(nodes.withColumnRenamed("share", "budget"), path)
        nodes = split_budget(children, path, name).select(*path, name, "share")
        path.append(name)
    return leaves.join(nodes, path).select(*levels, "tokens", "share")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], fraction: float, epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the levels' columns, tokens and epoch of every document taken, once for each epoch.

    ``levels`` gives the tree's columns from the top; ``fraction`` of all tokens is the whole budget.
    """
    names = list(levels)
    leaf = {c: F.coalesce(e.cast("string"), F.lit("none")).alias(c) for c, e in levels.items()}
    base = saved(docs.select(F.col(doc_id).alias("doc_id"), *leaf.values(), token_count(text).alias("tokens")), "tokens")
    leaves = saved(base.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    shares = leaf_budgets(leaves, names, weights, F.floor(F.sum("tokens") * F.lit(fraction)).cast("double"), epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = saved(shares.withColumn("full", full).withColumn("rest", F.col("share") - F.col("full") * F.col("tokens")).drop("tokens", "share"), "plan")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = base.join(plan, names)
    ordered = rows.where(F.col("full") < epochs).withColumn("h", order)
    # where each leaf's prefix ends: first by the first byte of the hash, then by the second
    ends = plan.where(F.col("full") < epochs).select(*names, "rest", F.lit(0).cast("long").alias("before"))
    inside = ordered.select(*names, "h", "tokens")
    for k in (1, 2):
        sums = inside.withColumn("byte", F.substring("h", 2 * k - 1, 2)).groupBy(*names, "byte").agg(F.sum("tokens").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy(*names).orderBy("byte"))
        last = sums.withColumn("upto", upto).join(ends, names).where(F.col("before") + F.col("upto") > F.col("rest"))
        cut = last.groupBy(*names).agg(F.min(F.struct("byte", F.col("upto").alias("upto"), "sum")).alias("end"))
        ends = saved(ends.join(cut, names, "left").select(*ends.columns[: len(names) + k], F.col("end.byte").alias(f"end{k}"), (F.col("before") + F.coalesce(F.col("end.upto") - F.col("end.sum"), F.lit(0))).alias("before")), "ends")
        inside = inside.join(ends.select(*names, f"end{k}"), names).where(F.substring("h", 2 * k - 1, 2) == F.col(f"end{k}")).drop(f"end{k}")
    near = ordered.drop("rest").join(ends, names)
    first, second = F.substring("h", 1, 2), F.substring("h", 3, 2)
    kept = ["doc_id", *names, "tokens"]
    passed = near.where(F.col("end1").isNull() | (first < F.col("end1")) | ((first == F.col("end1")) & (F.col("end2").isNull() | (second < F.col("end2")))))
    # in the one cell where the prefix ends: tokens by hash, so that rows of one id, or without id, are summed before they are ordered
    cell = near.where((first == F.col("end1")) & (second == F.col("end2")))
    upto = F.sum("sum").over(Window.partitionBy(*names).orderBy("h"))
    sums = cell.groupBy(*names, "h", "before", "rest").agg(F.sum("tokens").alias("sum")).withColumn("upto", upto)
    end = saved(sums.where(F.col("before") + F.col("upto") <= F.col("rest")).groupBy(*names).agg(F.max("h").alias("end_h")), "end")
    last = cell.join(end, names).where("h <= end_h")
    whole = rows.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    part = passed.select(*kept, F.col("full").alias("epoch")).unionByName(last.select(*kept, F.col("full").alias("epoch")))
    return whole.select(*kept, "epoch").unionByName(part)


def tree(source: str = "source", lang: str = "lang") -> tuple[dict[str, Column], dict[str, Column]]:
    """Levels and weights of the domain, language, source tree."""
    levels = {"domain": domain_of(source), "lang": F.col(lang), "source": F.col(source)}
    return levels, {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(1.0)}


def _case(col: str, weights: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


def oracle(fraction: float, epochs: int = 2, seed: int = 17) -> str:
    """The same mix as DuckDB SQL, with prefix sums over whole leaves."""
    sql = f"""
WITH base AS (
  SELECT doc_id, coalesce('domain' || (((TRY_CAST(substr(source, 4) AS BIGINT) % 4) + 4) % 4), 'none') AS domain, coalesce(lang, 'none') AS lang,
         coalesce(source, 'none') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {epochs} AS capacity FROM base GROUP BY ALL),
n0 AS (SELECT root, floor(sum(tokens) * {fraction}::DOUBLE)::DOUBLE AS share FROM leaves GROUP BY root)"""
    path = ["root"]
    for i, (name, w) in enumerate((("domain", _case("domain", DOMAIN_WEIGHTS)), ("lang", _case("lang", LANG_WEIGHTS)), ("source", "1.0::DOUBLE")), 1):
        p = ", ".join(path)
        sql += f""",
c{i} AS (SELECT {p}, {name}, sum(capacity) AS capacity, {w} AS weight FROM leaves GROUP BY {p}, {name}),
l{i} AS (SELECT c.*, (share - coalesce(sum(capacity) OVER (PARTITION BY {p} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (PARTITION BY {p} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c{i} c JOIN n{i - 1} n USING ({p})),
n{i} AS (SELECT {p}, {name}, least(capacity, greatest(0.0, weight * max(level) OVER (PARTITION BY {p}))) AS share FROM l{i})"""
        path.append(name)
    return sql + f""",
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(share / tokens)::BIGINT ELSE 0 END AS full_, share, tokens AS total
         FROM leaves JOIN n3 USING (domain, lang, source)),
ordered AS (SELECT b.*, full_, share - full_ * total AS rest, md5('{seed}|' || full_ || '|' || coalesce(doc_id::VARCHAR, '')) AS h FROM base b JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM ordered)
SELECT doc_id, domain, lang, source, tokens, full_ AS epoch FROM summed WHERE full_ < {epochs} AND upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, tokens, unnest(range(full_)) AS epoch FROM ordered WHERE full_ > 0"""
