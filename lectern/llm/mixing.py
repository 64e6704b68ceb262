"""Mixing sources to target weights by entropy balancing. Native expressions only.

Among all document rates from 0 to 3 whose words add up to each source's target,
entropy balancing takes those nearest to one copy each in relative entropy. They
are min(3, exp(multiplier of the source x size of the document)): a source that
has to shrink loses its long documents first, one that has to grow repeats them
first. The multipliers solve a convex dual, found by Newton steps that each sum
the tilted words over the whole table of (source, size) counts; a step that
leaves the bracket of the root halves it instead. Rates become whole copies:
along falling sizes the running sum of expected copies is rounded, so a source's
words are within its largest document of the target. Which documents of one size
get the extra copy is decided by their hashes, never by the partitioning, and all
sums are of decimals, so reruns agree on every cluster.

Edge cases: a null text has size 0 and takes nothing; documents with a null
source are one source, last in order; a null doc_id is a document like any
other; equal rows each count and may get different numbers of copies, ties being
broken by hash, doc_id and text; a very long text is one document, and its
source is met within its size; a source without words has target 0; an empty
table gives an empty result; other columns pass through, and the columns added
here replace any of the same name (names that start with _lt_ are not to be
used).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SEPARATORS, null_key, row_hash, stored

WEIGHTS = (5, 2, 1)
#: A source is repeated no more than this many times.
MOST_COPIES = 3
#: Words by which a source may miss its target, as a share of it, before rounding.
TOLERANCE = 1e-9
STEPS = 200
#: Documents of one source and size are dealt into so many groups, whatever the cluster.
BUCKETS = 1024
#: Sizes of a source whose sums are added up in one task.
BLOCK = 1024
#: Sums don't depend on the order of their terms.
EXACT = "decimal(38,9)"


def ranks(sources: DataFrame) -> DataFrame:
    """Adds _lt_rank, from 0, in order of code points, null last: places in range partitions, and counts of these."""
    parts = stored(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_lt_part", F.spark_partition_id()), "source-ranges")
    counts = parts.groupBy("_lt_part").agg(F.count("*").alias("_lt_n"))  # a row a partition
    starts = counts.select("_lt_part", F.coalesce(F.sum("_lt_n").over(W.orderBy("_lt_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lt_start"))
    own = F.row_number().over(W.partitionBy("_lt_part").orderBy(F.col("source").isNull(), "source")) - 1
    return parts.withColumn("_lt_rank", own).join(F.broadcast(starts), "_lt_part").withColumn("_lt_rank", F.col("_lt_rank") + F.col("_lt_start")).drop("_lt_part", "_lt_start")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds target to sources (source, source_size, a row each).

    Sources by code point, null last, weigh the weights in turn and share all
    words; targets stop at most x source_size and the excess goes to the others
    by weight, until none is above. That is target = min(most x size, weight x
    level); each round raises the level by what the sources at their bound leave,
    from two sums over all sources.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_lt_rank", F.lit(len(weights))).cast("int"))
    t = ranks(sources).withColumn("_lt_w", weight).withColumn("_lt_cap", most * F.col("source_size").cast("double")).drop("_lt_rank")
    t = stored(t, "source-weights")
    words, open_weight = t.agg(F.sum("source_size"), F.sum(F.col("_lt_w").cast(EXACT))).first()
    level = float(words or 0) / float(open_weight) if open_weight else 0.0
    while True:
        full = F.col("_lt_cap") <= F.col("_lt_w") * F.lit(level)
        capped, left = t.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_lt_w").cast(EXACT)))).first()
        higher = (float(words) - most * float(capped or 0)) / float(left) if left else level
        if higher <= level:
            break
        level = higher
    return t.withColumn("target", F.least("_lt_cap", F.col("_lt_w") * F.lit(level))).drop("_lt_w", "_lt_cap")


def multipliers(cells: DataFrame, goals: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(_lt_source, multiplier) from cells (_lt_source, size, n) and goals (_lt_source, source_size, target).

    Newton on the dual, the sum of n x f(multiplier x size) - target x
    multiplier, where f' = min(most, exp). As sizes are whole numbers, the root
    lies between 0 and ln(target / source_size); a step outside of what is left of
    that bracket halves it.
    """
    goal = F.ln(F.col("target") / F.col("source_size"))
    open_ = goals.where("target > 0 and source_size > 0").select("_lt_source", F.col("target").alias("t"), F.least(goal, F.lit(0.0)).alias("low"), F.greatest(goal, F.lit(0.0)).alias("high"), F.lit(0.0).alias("m"), F.lit(False).alias("done"))
    state = stored(open_, "duals")
    sizes = cells.where("size > 0").select("_lt_source", "size", (F.col("n") * F.col("size")).cast("double").alias("words"))
    x = F.col("m") * F.col("size")
    rate = F.when(x >= math.log(most), F.lit(float(most))).otherwise(F.exp(x))
    for _ in range(STEPS):
        sums = sizes.join(state.where("not done").select("_lt_source", "m"), "_lt_source").withColumn("r", F.col("words") * rate)
        sums = sums.groupBy("_lt_source").agg(F.sum(F.col("r").cast(EXACT)).cast("double").alias("g"), F.sum(F.when(x < math.log(most), F.col("r") * F.col("size")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        s = state.join(sums, "_lt_source", "left")
        above = F.col("g") > F.col("t")
        s = s.withColumn("low", F.when(above, F.col("low")).otherwise(F.coalesce(F.when(F.col("g").isNotNull(), F.col("m")), F.col("low")))).withColumn("high", F.when(above, F.col("m")).otherwise(F.col("high")))
        step = F.col("m") - (F.col("g") - F.col("t")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        settled = F.coalesce((F.abs(F.col("g") - F.col("t")) <= TOLERANCE * F.col("t")) | (F.col("high") - F.col("low") <= 1e-15), F.col("done"))
        m = F.when(settled, F.col("m")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(s.select("_lt_source", "t", "low", "high", m.alias("m"), settled.alias("done")), "duals")
        if not state.where("not done").limit(1).count():
            break
    return state.select("_lt_source", F.col("m").alias("multiplier"))


def copies(cells: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(_lt_source, size, _lt_base, _lt_more) from cells (_lt_source, size, n, multiplier or null): each of the n documents gets base copies and more of them one in addition.

    Running sums of expected copies along falling sizes are rounded. They are
    added up by blocks of sizes first, so that no task holds all of a source.
    """
    x = F.col("multiplier") * F.col("size")
    rate = F.when(x >= math.log(most), F.lit(float(most))).otherwise(F.exp(x))
    expected = F.when(F.col("multiplier").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("n") * rate)
    cells = cells.withColumn("_lt_block", F.expr(f"-(size div {BLOCK})")).withColumn("_lt_e", F.round(expected, 9).cast("decimal(28,9)"))
    blocks = cells.groupBy("_lt_source", "_lt_block").agg(F.sum("_lt_e").alias("_lt_e"))
    before = W.partitionBy("_lt_source").orderBy("_lt_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_lt_source", "_lt_block", F.coalesce(F.sum("_lt_e").over(before), F.lit(0)).cast(EXACT).alias("_lt_start"))
    within = W.partitionBy("_lt_source", "_lt_block").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("_lt_sum", F.sum("_lt_e").over(within)).join(starts.hint("merge"), ["_lt_source", "_lt_block"])
    through = (F.col("_lt_sum") + F.col("_lt_start")).cast(EXACT)
    rounded = lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    cells = cells.withColumn("_lt_k", rounded(through) - rounded((through - F.col("_lt_e")).cast(EXACT)))
    return cells.select("_lt_source", "size", F.expr("_lt_k div n").alias("_lt_base"), (F.col("_lt_k") % F.col("n")).alias("_lt_more"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies x size, a row for each document."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SEPARATORS.replace("[", "[^", 1))).cast("long"))
    sized = sized.withColumn("_lt_source", null_key(F.col("source"))).withColumn("_lt_bucket", F.pmod(row_hash(F.col("doc_id"), F.col("text")), F.lit(BUCKETS).cast("long")))
    keys = ["_lt_source", "size"]
    counts = stored(sized.groupBy(*keys, "_lt_bucket").agg(F.count("*").alias("n"), F.first("source").alias("_lt_name")), "counts")
    cells = stored(counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_lt_name").alias("_lt_name")), "sizes")
    sources = cells.groupBy("_lt_source").agg(F.first("_lt_name").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = stored(targets(sources, weights, most).drop("source"), "targets")
    found = copies(cells.select(*keys, "n").join(multipliers(cells, goals, most), "_lt_source", "left"), most)

    earlier = W.partitionBy(*keys).orderBy("_lt_bucket").rowsBetween(W.unboundedPreceding, -1)
    quotas = counts.withColumn("_lt_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(found.hint("merge"), keys).join(goals, "_lt_source")
    quotas = quotas.select(*keys, "_lt_bucket", "source_size", "target", "_lt_base", (F.col("_lt_more") - F.col("_lt_start")).alias("_lt_more"))
    own = F.row_number().over(W.partitionBy(*keys, "_lt_bucket").orderBy("doc_id", row_hash(F.col("text"))))
    rows = sized.withColumn("_lt_own", own).join(quotas.hint("merge"), [*keys, "_lt_bucket"])  # about as many quotas as documents: never to be broadcast
    rows = rows.withColumn("copies", F.col("_lt_base") + F.when(F.col("_lt_own") <= F.col("_lt_more"), 1).otherwise(0))
    return rows.select(*docs.columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs as the mix takes them: each as many times as it has copies."""
    return mixed(docs, weights, most).withColumn("_lt_each", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)
