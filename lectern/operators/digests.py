"""Digests of tables as trees: rows fold into leaves, leaves into nodes, by their place; no list is longer than the fan-out.

A row's place is a number, its order or a part of its key's hash. A leaf covers
FAN places, a node FAN leaves, the root all nodes; each digests its members in
order, with their numbers. So equal rows give equal trees whatever their
partitioning, and where two trees differ, only what lies below differing nodes
has to be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a node. Two levels below the root hold 16 million places for each entry of the root.
FAN = 4096
LEVELS = 2
#: Bits of a key's hash that its place can have.
BITS = 48


def place(key: Column, rows: int) -> Column:
    """A place for a key among about as many as there are rows, by its hash."""
    bits = min(BITS, max(0, (rows - 1).bit_length()))
    return F.shiftrightunsigned(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, BITS // 4), 16, 10).cast("long"), BITS - bits)


def _members(number: Column, digest: str) -> Column:
    named = F.sort_array(F.collect_list(F.struct(number.alias("i"), F.col(digest).alias("d"))))
    return F.sha2(F.array_join(F.transform(named, lambda x: F.concat_ws(":", x["i"], x["d"])), "\n"), 256).alias("digest")


def leaves(rows: DataFrame, at: Column, line: Column, by: list[str] | None = None) -> DataFrame:
    """(by, nth, n, digest): leaves over rows, in the order of their places and, in one place, of their lines' digests."""
    keys = by or []
    hashed = rows.select(*keys, at.cast("long").alias("at"), F.sha2(line, 256).alias("line"))
    return hashed.groupBy(*keys, F.floor(F.col("at") / FAN).alias("nth")).agg(F.count("*").alias("n"), _members(F.col("at"), "line"))


def above(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The level over nodes (by, nth, n, digest)."""
    keys = by or []
    return nodes.groupBy(*keys, F.floor(F.col("nth") / FAN).alias("up")).agg(F.sum("n").alias("n"), _members(F.col("nth"), "digest")).withColumnRenamed("up", "nth")


def root(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, digest): the digest over the last level; one row, or one for each of by. Of no rows it is that of the empty text."""
    return nodes.groupBy(*(by or [])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _members(F.col("nth"), "digest"))


def tree(rows: DataFrame, at: Column, line: Column) -> list[DataFrame]:
    """All levels of nodes below the root, leaves first."""
    levels = [leaves(rows, at, line)]
    for _ in range(LEVELS - 1):
        levels.append(above(levels[-1]))
    return levels


def rolled(rows: DataFrame, at: Column, line: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n, digest): the roots of rows' trees."""
    nodes = leaves(rows, at, line, by)
    for _ in range(LEVELS - 1):
        nodes = above(nodes, by)
    return root(nodes, by)


def table(levels: list[DataFrame]) -> DataFrame:
    """(level, nth, n, digest): all levels of a tree in one table, to be kept with what it digests."""
    whole = levels[0].select(F.lit(0).alias("level"), "nth", "n", "digest")
    for k, nodes in enumerate(levels[1:], 1):
        whole = whole.unionByName(nodes.select(F.lit(k).alias("level"), "nth", "n", "digest"))
    return whole


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nth): leaves of two tables of nodes that differ, found from the top: of each level only children of differing nodes are compared."""
    open_ = None
    for k in reversed(range(LEVELS)):
        x, y = (t.where(F.col("level") == k).select("nth", "digest") for t in (a, b))
        if open_ is not None:
            x, y = (t.withColumn("up", F.floor(F.col("nth") / FAN)).join(open_, "up", "left_semi").select("nth", "digest") for t in (x, y))
        met = x.join(y.withColumnRenamed("digest", "other"), "nth", "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        open_ = met.select(F.col("nth").alias("up"))
    return open_.withColumnRenamed("up", "nth")


def changed_rows(old: DataFrame, new: DataFrame, key: str, at: Column, line: Column) -> DataFrame:
    """(key, old, new): rows of two tables that differ, with their lines' digests; only rows of differing leaves are joined."""
    left = differing(table(tree(old, at, line)), table(tree(new, at, line)))
    some = lambda df, name: df.withColumn("nth", F.floor(at.cast("long") / FAN)).join(left, "nth", "left_semi").select(key, F.sha2(line, 256).alias(name))
    return some(old, "old").join(some(new, "new"), key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
