"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups, the largest
first, go to the least-loaded shard through a heap. Groups of one size are alike,
so the schedule runs over the counts of sizes, and a run of equal groups is
scheduled at once: it goes round the shards in the order of their loads. The
schedule is exactly the one that the heap makes one group at a time. Distinct
sizes d of all groups satisfy d^2 / 2 <= total bytes, and one task reads them in
a stream.

Edge cases: a null text counts as an empty one (size 1, CRC 0) and shares its
group; repeated rows share a group and take a slot each; ties between groups of
one size go by the texts' hashes, whatever the cluster; a very long text is one
row; a null doc_id sorts first within its bucket; an empty table gives an empty
result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ranked, skew_join, stored

SHARDS = 8
#: Rows of one size or shard are dealt into so many groups to number them, whatever the cluster.
BUCKETS = 1024


def schedule(classes, shards: int = SHARDS):
    """For (size, groups) with falling sizes: (size, [(first rank, shards in turn), ...]).

    The heap orders shards by load and number. A shard with load q x size + r
    takes groups in rounds q, q + 1, ...; within a round shards go by (r, number).
    Between two rounds in which a shard joins, the turn stays the same.
    """
    loads = [(0, j) for j in range(shards)]
    for size, groups in classes:
        joins = [(load // size, load % size, j) for load, j in loads]
        heapq.heapify(joins)
        turns, given, now, left, rank = [], [0] * shards, [], groups, 0
        while left:
            q = joins[0][0]
            while joins and joins[0][0] == q:
                now.append(heapq.heappop(joins)[1:])
            now.sort()
            cycle = [j for _, j in now]
            n = min(left, (joins[0][0] - q) * len(cycle)) if joins else left
            turns.append((rank, cycle))
            for k, j in enumerate(cycle):
                given[j] += n // len(cycle) + (k < n % len(cycle))
            rank += n
            left -= n
        loads = [(load + given[j] * size, j) for load, j in loads]
        yield size, turns


def _plan(batches, shards):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("first", pa.int64()), ("turn", pa.list_(pa.int32()))]))
    rows = ((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    sizes, turns, groups = [], [], []

    def noted():
        for s, n in rows:
            groups.append(n)
            yield s, n

    def out():
        return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array([[{"first": a, "turn": t} for a, t in x] for x in turns], kind), pa.array(groups, pa.int64())], ["_lt_bytes", "_lt_turns", "_lt_groups"])

    for s, t in schedule(noted(), shards):
        sizes.append(s)
        turns.append(t)
        if len(sizes) == 1000:
            yield out()
            sizes, turns, groups = [], [], []
    if sizes:
        yield out()


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs; shards are near equal in bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_lt_key"))
    rows = stored(rows, "sized")
    groups = stored(rows.groupBy("_lt_key").agg(F.count("*").alias("_lt_rows"), F.sum("size").alias("_lt_bytes")), "groups")
    sizes = groups.groupBy("_lt_bytes").agg(F.count("*").alias("n"))
    plan = sizes.coalesce(1).sortWithinPartitions(F.desc("_lt_bytes")).mapInArrow(lambda it: _plan(it, shards), "_lt_bytes long, _lt_turns array<struct<first:long,turn:array<int>>>, _lt_groups long")
    order = ranked(groups, ["_lt_bytes"], [F.col("_lt_key")], F.xxhash64("_lt_key"), "_lt_rank", BUCKETS)
    order = skew_join(order, stored(plan, "plan"), "_lt_bytes", "_lt_groups", F.xxhash64("_lt_key"), "inner")
    turn = F.element_at(F.filter("_lt_turns", lambda t: t["first"] <= F.col("_lt_rank")), -1)
    order = order.withColumn("_lt_turn", turn)
    shard = F.get("_lt_turn.turn", F.pmod(F.col("_lt_rank") - F.col("_lt_turn.first"), F.size("_lt_turn.turn")).cast("int"))
    found = stored(order.select("_lt_key", "_lt_rows", shard.alias("shard")), "shards")
    placed = skew_join(rows, found, "_lt_key", "_lt_rows", F.monotonically_increasing_id()).drop("_lt_key")
    return ranked(stored(placed, "placed"), ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.xxhash64("doc_id", "text_crc32"), "slot", BUCKETS)
