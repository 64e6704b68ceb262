"""Merkle manifest of a table: a tree of row digests for each source, a tree over the sources, and proofs for every row.

Rows become leaves, numbered within their source. Runs of sixteen nodes fold
into one until a source has one node, its subroot; subroots fold the same way
into the root. Nodes of all levels are written as a table keyed by coordinates
(tree, level, nth). A proof needs no tree in memory: from a node's index and the
number of nodes of its level follow the coordinates of its siblings, which are
exploded, joined with the node table, ordered and put together. What lies above
a run is the same for all of it, so each node asks for the siblings of its own
level only, and paths are handed down from parent to child, from the root to the
leaves. No key of a join then has more than sixteen rows, also in a source that
holds most of the table. Folding a leaf along its path gives the root again,
unless the leaf or the table changed.

Numbers within a source come from range partitions and counts of these, so no
task holds a source.

Edge cases: null fields count as `-`; rows with a null source form a tree of
their own, first in order; null ids come first within a source, rows under one
id by their leaf's digest; equal rows are leaves of their own, with equal
digests and proofs that may differ; a source of one row has its leaf as subroot,
a table of one source its subroot as root, one of one row has an empty path, whose proof
is the digest of nothing; a very long text is hashed in its row; an empty table
gives an empty result; other columns of the input, whatever their names, are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import null_key, stored

#: Nodes that fold into one.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["_lt_tree", "_lt_nth"]
PATH = "array<struct<left:binary,right:binary>>"


def hashed(*parts: Column) -> Column:
    """SHA-256 over strings, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digits(digest: Column) -> Column:
    """Bytes as lowercase hex text."""
    return F.lower(F.hex(digest))


def leaf(*fields: Column) -> Column:
    """A row's digest over its fields: - for null, else the length in UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return hashed(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in text])


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds _lt_nth, the place of each row in its tree from 0, and _lt_n, the rows of the tree."""
    parts = stored(rows.repartitionByRange(tree, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_lt_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(tree, "_lt_part").agg(F.count("*").alias("_lt_rows"))
    ordered, whole = W.partitionBy(tree).orderBy("_lt_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(tree)
    starts = counts.select(tree, "_lt_part", F.coalesce(F.sum("_lt_rows").over(ordered), F.lit(0)).alias("_lt_start"), F.sum("_lt_rows").over(whole).alias("_lt_n"))
    own = F.row_number().over(W.partitionBy(tree, "_lt_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    placed = parts.withColumn("_lt_nth", own.cast("long")).join(starts.hint("merge"), [tree, "_lt_part"])
    return placed.withColumn("_lt_nth", F.col("_lt_nth") + F.col("_lt_start")).drop("_lt_part", "_lt_start")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of nodes (_lt_tree, _lt_nth, _lt_n, _lt_hash); trees of one node have none."""
    members = F.sort_array(F.collect_list(F.struct("_lt_nth", "_lt_hash")))
    runs = nodes.where("_lt_n > 1").groupBy("_lt_tree", F.expr(f"_lt_nth div {FAN}").alias("_lt_run")).agg(members.alias("_lt_m"), F.first("_lt_n").alias("_lt_n"))
    return runs.select("_lt_tree", F.col("_lt_run").alias("_lt_nth"), F.ceil(F.col("_lt_n") / FAN).cast("long").alias("_lt_n"), hashed(F.array_join(F.transform("_lt_m", lambda m: digits(m["_lt_hash"])), "")).alias("_lt_hash"))


@dataclass
class Trees:
    """Levels of nodes (_lt_tree, _lt_nth, _lt_n, _lt_hash), leaves first; the tops of all trees are those with _lt_n = 1."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(_lt_tree, _lt_level, _lt_hash): a tree's only node of its last level."""
        found = [n.where("_lt_n = 1").select("_lt_tree", F.lit(k).alias("_lt_level"), "_lt_hash") for k, n in enumerate(self.levels)]
        whole = found[0]
        for f in found[1:]:
            whole = whole.unionByName(f)
        return whole


def grown(nodes: DataFrame) -> Trees:
    """All levels over the leaves nodes (_lt_tree, _lt_nth, _lt_n, _lt_hash, ...; stored), each written."""
    levels = [nodes]
    most = nodes.agg(F.max("_lt_n")).first()[0] or 0
    while most > 1:
        levels.append(stored(parents(levels[-1]), "nodes"))
        most = -(-most // FAN)
    return Trees(levels)


def siblings(nodes: DataFrame) -> DataFrame:
    """(_lt_tree, _lt_nth, _lt_step): for each node of a level its siblings' digests to the left and to the right, by their coordinates."""
    first = F.expr(f"{FAN} * (_lt_nth div {FAN})")
    coordinates = F.array_except(F.sequence(first, F.least(first + FAN, F.col("_lt_n")) - 1), F.array("_lt_nth"))
    asked = nodes.where("_lt_n > 1").select("_lt_tree", F.col("_lt_nth").alias("_lt_own"), F.explode_outer(coordinates).alias("_lt_nth"))
    met = asked.join(nodes.select(*NODE, "_lt_hash").hint("merge"), NODE, "left")
    found = met.groupBy("_lt_tree", "_lt_own").agg(F.sort_array(F.collect_list(F.when(F.col("_lt_nth").isNotNull(), F.struct("_lt_nth", "_lt_hash")))).alias("_lt_s"))
    side = lambda keep: F.aggregate(F.filter("_lt_s", keep), F.unhex(F.lit("")), lambda acc, s: F.concat(acc, s["_lt_hash"]))
    own = F.col("_lt_own")
    return found.select("_lt_tree", own.alias("_lt_nth"), F.struct(side(lambda s: s["_lt_nth"] < own).alias("left"), side(lambda s: s["_lt_nth"] > own).alias("right")).alias("_lt_step"))


def paths(trees: Trees, tops: DataFrame) -> DataFrame:
    """The leaves with _lt_path, steps from leaf to root, and what else tops carry.

    tops: (_lt_tree, _lt_level, _lt_path, ...), where the paths of trees end, a
    row for each tree. Paths go down a level at a time.
    """
    rest = [c for c in tops.columns if c not in ("_lt_tree", "_lt_level")]
    above = None
    for k in reversed(range(len(trees.levels))):
        nodes = trees.levels[k]
        own = [c for c in nodes.columns if c != "_lt_n"] if k == 0 else NODE
        here = nodes.where("_lt_n = 1").join(tops.where(F.col("_lt_level") == k), "_lt_tree").select(*own, *rest)
        if above is not None:
            # The siblings lie where their node's row goes; all sizes take the same way.
            steps = nodes.where("_lt_n > 1").select(*own).join(siblings(nodes).hint("merge"), NODE).withColumn("_lt_run", F.expr(f"_lt_nth div {FAN}"))
            down = steps.join(above.withColumnRenamed("_lt_nth", "_lt_run").hint("merge"), ["_lt_tree", "_lt_run"])
            longer = F.concat(F.array("_lt_step"), F.col("_lt_path"))
            here = here.unionByName(down.select(*own, *[longer.alias(c) if c == "_lt_path" else c for c in rest]))
        above = stored(here, "paths") if k else here
    return above


def proof(path: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return digits(hashed(F.array_join(F.transform(path, lambda s: digits(F.concat(s["left"], s["right"]))), "")))


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return digits(F.aggregate(path, leaf_, lambda acc, s: hashed(digits(s["left"]), digits(acc), digits(s["right"]))))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (_lt_tree, _lt_hash, ...) with subroot, root (bytes) and _lt_path; ordered within a tree by order and digest.

    The nodes of all trees are written below the shared folder on the way.
    """
    rows = stored(numbered(leaves, "_lt_tree", [*order, "_lt_hash"]), "leaves")
    trees = grown(rows)
    subroots = stored(trees.tops(), "subroots")
    named = subroots.select(F.lit("").alias("_lt_tree"), F.col("_lt_tree").alias("_lt_name"), F.col("_lt_level").alias("_lt_top"), "_lt_hash")
    upper = stored(numbered(named, "_lt_tree", ["_lt_name"]), "upper")
    over = grown(upper)
    top = over.tops().withColumn("root", F.col("_lt_hash")).withColumn("_lt_path", F.array().cast(PATH)).drop("_lt_hash")
    ends = paths(over, top).select(F.col("_lt_name").alias("_lt_tree"), F.col("_lt_top").alias("_lt_level"), F.col("_lt_hash").alias("subroot"), "root", "_lt_path")
    return paths(trees, stored(ends, "ends"))


def verified(docs: DataFrame, changed: Column, sides: list[Column], columns: tuple = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of each row, and what the rows lead to where changed holds and fields read as sides: folded_root, verified."""
    fields = [F.col(c) for c in columns]
    found = docs.select(F.col("doc_id").alias("doc_id"), null_key(F.col("source")).alias("_lt_tree"), leaf(*fields).alias("_lt_hash"), F.when(changed, leaf(*sides)).alias("_lt_changed"))
    rows = manifest(found, ["doc_id"]).withColumn("folded_root", folded(F.coalesce("_lt_changed", "_lt_hash"), F.col("_lt_path")))
    root = digits(F.col("root"))
    return rows.select("doc_id", digits(F.col("_lt_hash")).alias("leaf"), digits(F.col("subroot")).alias("subroot"), root.alias("root"), proof(F.col("_lt_path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
