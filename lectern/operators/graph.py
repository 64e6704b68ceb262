"""Citation graph: adjacency, bounded traversal, merge of retrieval lanes, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.references import target_key, verses

DIRECTIONS = ("outbound", "inbound", "both")
MOST_DEPTH, MOST_NODES = 3, 200


def ordered_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with their origin's canonical order."""
    origin = units.select(F.col("reference").alias("origin_reference"), F.col("canonical_order").alias("origin_order"))
    return edges.join(origin, "origin_reference")


def adjacency(ordered: DataFrame) -> DataFrame:
    """(edge_id, origin_order, src, dst, tgt_ord, external_key): a row for each verse of an internal target, one with a null dst for an external one."""
    internal = F.col("target.kind") == "internal"
    each = F.when(internal, verses(F.col("target"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = ordered.select("edge_id", "origin_order", F.col("origin_reference").alias("src"), internal.alias("_i"), target_key(F.col("target")).alias("_k"), F.posexplode_outer(each).alias("tgt_ord", "dst"))
    return rows.select("edge_id", "origin_order", "src", "dst", F.coalesce("tgt_ord", F.lit(0)).alias("tgt_ord"), F.when(~F.col("_i"), F.col("_k")).alias("external_key"))


def incident(adjacent: DataFrame, direction: str) -> DataFrame:
    """(node, pass, origin_order, edge_id, tgt_ord, neighbor, external_key): what a node sees, in its order of discovery.

    Outbound edges come before inbound ones, edges by their origin's order and id.
    """
    out = adjacent.select(F.col("src").alias("node"), F.lit(0).alias("pass"), "origin_order", "edge_id", "tgt_ord", F.col("dst").alias("neighbor"), "external_key")
    back = adjacent.where("dst is not null").select(F.col("dst").alias("node"), F.lit(1).alias("pass"), "origin_order", "edge_id", F.lit(0).alias("tgt_ord"), F.col("src").alias("neighbor"), F.lit(None).cast("string").alias("external_key"))
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def expanded(adjacent: DataFrame, seeds: DataFrame, direction: str = "outbound", depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Uncapped breadth-first expansion of many seeds at once, by levels.

    seeds: (seed, node). Nodes: (seed, node, depth, rank, path), each node once
    for a seed, at its first discovery. Touched: (seed, edge_id, external_key)
    of all edges at expanded nodes.
    """
    seen_edges = incident(adjacent, direction)
    level = seeds.select("seed", "node", F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("rank"), F.array().cast("array<string>").alias("path"))
    nodes, touched = level, []
    for d in range(1, depth + 1):
        met = level.join(seen_edges, "node")
        touched.append(met.select("seed", "edge_id", "external_key"))
        # A rank is the parent's rank and the place among what the parent sees: sorting ranks is the queue's order.
        place = F.struct("rank", "pass", "origin_order", "edge_id", "tgt_ord")
        found = met.where("neighbor is not null").groupBy("seed", "neighbor").agg(F.min_by(F.struct("path", "edge_id"), place).alias("via"), F.min(place).alias("place"))
        found = found.join(nodes.select("seed", F.col("node").alias("neighbor")), ["seed", "neighbor"], "left_anti")
        row = F.row_number().over(W.partitionBy("seed").orderBy("place")).cast("long")
        level = found.select("seed", F.col("neighbor").alias("node"), F.lit(d).alias("depth"), F.array(F.lit(d).cast("long"), row).alias("rank"), F.concat("via.path", F.array("via.edge_id")).alias("path"))
        nodes = nodes.unionByName(level)
    edges = reduce(DataFrame.unionByName, touched) if touched else seeds.select("seed", F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("string").alias("external_key")).limit(0)
    return nodes, edges.distinct()


def traverse(adjacent: DataFrame, origin: str, direction: str = "outbound", depth: int = 1, most: int = MOST_NODES) -> dict[str, DataFrame]:
    """Traversal from one node, capped at ``most`` visited nodes.

    nodes (node, depth, rank, path), edges (edge_id, rank) in the order of first
    touch, externals (external_key, edge_id), frontier (node): neighbours that
    no room was left for. At most 200 nodes are visited, so each level's capped
    rows are few; a level's order is global, as the cap needs.
    """
    spark = adjacent.sparkSession
    seen_edges = incident(adjacent, direction)
    level = spark.createDataFrame([(origin, 0, 0, [])], "node string, depth int, rank long, path array<string>")
    nodes, touched, refused, visited = level, None, None, 1
    for d in range(1, depth + 1):
        met = level.join(seen_edges, "node")
        place = F.struct(F.col("rank"), F.col("pass"), F.col("origin_order"), F.col("edge_id"), F.col("tgt_ord"))
        rows = met.select("edge_id", "external_key", F.lit(d).alias("level"), place.alias("place"))
        touched = rows if touched is None else touched.unionByName(rows)
        found = met.where("neighbor is not null").groupBy("neighbor").agg(F.min_by(F.struct("path", "edge_id"), place).alias("via"), F.min(place).alias("place"))
        found = found.join(nodes.select(F.col("node").alias("neighbor")), "neighbor", "left_anti")
        room = most - visited
        taken = found.orderBy("place").limit(max(0, room)).select("neighbor", F.concat("via.path", F.array("via.edge_id")).alias("path"), "place")
        # At most `most` rows: bounded, so they come to the driver, which fixes the level and cuts the plan.
        rows = sorted(taken.collect(), key=lambda r: r["place"]) if room > 0 else []
        left = found.select(F.col("neighbor").alias("node"))
        refused = left if refused is None else refused.union(left)
        level = spark.createDataFrame([(r["neighbor"], d, visited + k, r["path"]) for k, r in enumerate(rows)], "node string, depth int, rank long, path array<string>")
        nodes = nodes.unionByName(level)
        visited += len(rows)
        if not rows:
            break
    none = spark.createDataFrame([], "edge_id string, external_key string, level int, place struct<rank:long,pass:int,origin_order:long,edge_id:string,tgt_ord:int>")
    touched = none if touched is None else touched
    frontier = refused.join(nodes, "node", "left_anti").distinct() if refused is not None else spark.createDataFrame([], "node string")
    first = touched.groupBy("edge_id").agg(F.min(F.struct("level", "place")).alias("first"))
    externals = touched.where("external_key is not null").groupBy("external_key").agg(F.min_by("edge_id", F.struct("level", "place")).alias("edge_id"))
    return {"nodes": nodes, "edges": first, "externals": externals, "frontier": frontier}


def merged(lexical: DataFrame, official: DataFrame) -> DataFrame:
    """Candidates of both lanes by canonical order.

    lexical: (canonical_order, raw_score), a row each. official: (canonical_order,
    seed_rank, path). A candidate with a lexical hit is in lane 0, others in lane
    1 with score 0; bases list the lexical one first and then one for each
    reaching seed, by the seed's rank.
    """
    a = lexical.select("canonical_order", F.lit("lexical").alias("lane"), F.lit(-1).cast("long").alias("seq"), F.col("raw_score").alias("score"), F.array().cast("array<string>").alias("path"))
    b = official.select("canonical_order", F.lit("official").alias("lane"), F.col("seed_rank").cast("long").alias("seq"), F.lit(None).cast("double").alias("score"), "path")
    rows = a.unionByName(b).groupBy("canonical_order").agg(F.sort_array(F.collect_list(F.struct("seq", "lane", "score", "path"))).alias("basis"))
    best = F.array_min(F.transform(F.filter("basis", lambda x: x["lane"] == "lexical"), lambda x: x["score"]))
    return rows.withColumn("lane_priority", F.when(best.isNull(), 1).otherwise(0)).withColumn("best_score", F.coalesce(best, F.lit(0.0)))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates in order: lane, best score, canonical order."""
    return candidates.orderBy("lane_priority", "best_score", "canonical_order")


def page_after(candidates: DataFrame, key: tuple[int, float, int] | None, limit: int) -> DataFrame:
    """The next candidates behind a key of the order, and one more."""
    if key is not None:
        at = F.struct("lane_priority", "best_score", "canonical_order")
        candidates = candidates.where(at > F.struct(F.lit(key[0]), F.lit(float(key[1])), F.lit(key[2]).cast("long")))
    return rank_candidates(candidates).limit(limit + 1)
