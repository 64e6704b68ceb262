"""Ranking evaluation over many cases at once: precision, recall, NDCG, MRR, coverage, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5, 10, 20)


def checked_depths(depths) -> list[int]:
    depths = list(depths)
    if not depths or depths != sorted(set(depths)) or depths[0] < 1 or depths[-1] > 100:
        raise ValueError("depths are unique, ascending and between 1 and 100")
    return depths


def ranked(results: DataFrame, order: list) -> DataFrame:
    """(case_id, reference, rank) from rows of results; ranks from 1."""
    return results.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(*order)).cast("long"))


def grades(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rankings with their grade, 0 where unjudged, and whether they are judged."""
    joined = ranking.join(judgments.select("case_id", "reference", F.col("grade").alias("_g")), ["case_id", "reference"], "left")
    return joined.withColumn("grade", F.coalesce("_g", F.lit(0))).withColumn("judged", F.col("_g").isNotNull()).drop("_g")


def _per_depth(cases: DataFrame, depths) -> DataFrame:
    return cases.select("case_id").crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(d,) for d in checked_depths(depths)], "depth int")))


def precision_recall(cases: DataFrame, graded: DataFrame, judgments: DataFrame, depths=DEPTHS) -> DataFrame:
    """(case_id, depth, precision, recall); precision divides by the depth, recall is 0 without relevant judgments."""
    relevant = judgments.groupBy("case_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    hits = _per_depth(cases, depths).join(graded, "case_id", "left").groupBy("case_id", "depth").agg(F.count_if((F.col("grade") > 0) & (F.col("rank") <= F.col("depth"))).alias("hits"))
    out = hits.join(relevant, "case_id", "left")
    recall = F.when(F.coalesce("relevant", F.lit(0)) > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    return out.select("case_id", "depth", (F.col("hits") / F.col("depth")).alias("precision"), recall.alias("recall"))


def ndcg(cases: DataFrame, graded: DataFrame, judgments: DataFrame, depths=DEPTHS) -> DataFrame:
    """(case_id, depth, ndcg), gain 2^grade - 1 over log2(rank + 1), the ideal from all judgments."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    ideal = judgments.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("grade"), "reference")))
    total = lambda df, name: _per_depth(cases, depths).join(df, "case_id", "left").groupBy("case_id", "depth").agg(F.coalesce(F.sum(F.when(F.col("rank") <= F.col("depth"), gain)), F.lit(0.0)).alias(name))
    out = total(graded, "actual").join(total(ideal, "ideal"), ["case_id", "depth"])
    return out.select("case_id", "depth", F.when(F.col("ideal") > 0, F.col("actual") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def mrr(cases: DataFrame, graded: DataFrame) -> DataFrame:
    """(case_id, mrr) over the whole ranking."""
    first = graded.where("grade > 0").groupBy("case_id").agg(F.min("rank").alias("first"))
    return cases.select("case_id").join(first, "case_id", "left").select("case_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def coverage(cases: DataFrame, graded: DataFrame) -> DataFrame:
    """(case_id, n_returned, judgment_coverage), 1 for an empty ranking."""
    found = graded.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("judged").alias("j"))
    return cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_returned"), F.coalesce(F.col("j") / F.col("n"), F.lit(1.0)).alias("judgment_coverage"))


def unjudged(cases: DataFrame, graded: DataFrame) -> DataFrame:
    """(reference, in_locked): what rankings returned without a judgment in that case."""
    rows = graded.where(~F.col("judged")).join(cases.select("case_id", "split"), "case_id")
    return rows.groupBy("reference").agg(F.bool_or(F.col("split") == "locked").alias("in_locked"))


def eligibility(cases: DataFrame, graded: DataFrame) -> DataFrame:
    """(reason) rows why a report may not stand for a comparison."""
    spark = cases.sparkSession
    locked = cases.where(F.col("split") == "locked").select("case_id")
    rows = graded.join(locked, "case_id")
    facts = locked.agg(F.count("*").alias("n")).crossJoin(rows.agg(F.coalesce(F.bool_or(F.col("grade") > 0), F.lit(False)).alias("hit"), F.coalesce(F.bool_or(~F.col("judged")), F.lit(False)).alias("open")))
    some = F.when(F.col("n") == 0, "no_locked_cases").when(~F.col("hit"), "no_locked_relevant_hits")
    reasons = F.array_compact(F.array(F.lit("no_baseline_comparison"), some, F.when(F.col("open"), "incomplete_locked_judgments")))
    return facts.select(F.explode(reasons).alias("reason"))


def pool_coverage(returned: DataFrame, pool: DataFrame) -> DataFrame:
    """(path, n_returned, n_covered, coverage) of ordered paths (path, pos, reference) against a pool of references."""
    first = returned.groupBy("path", "reference").agg(F.min("pos").alias("pos"))
    size = F.broadcast(pool.select("reference").distinct().agg(F.count("*").alias("size")))
    there = pool.select("reference").distinct().withColumn("_in", F.lit(1))
    joined = first.join(there, "reference", "left").groupBy("path").agg(F.count("*").alias("n_returned"), F.count("_in").alias("n_covered"))
    return joined.crossJoin(size).select("path", "n_returned", "n_covered", F.when(F.col("size") > 0, F.col("n_covered") / F.col("size")).otherwise(0.0).alias("coverage"))


def citations(returned: DataFrame, units: DataFrame) -> DataFrame:
    """(reference, problem) of returned passages that the corpus lacks or has with other content."""
    now = units.select("reference", F.col("text").alias("_t"), F.col("content_hash").alias("_h"), F.lit(1).alias("_in"))
    joined = returned.select("reference", "text", "content_hash").join(now, "reference", "left")
    same = F.col("text").eqNullSafe(F.col("_t")) & F.col("content_hash").eqNullSafe(F.col("_h"))
    return joined.select("reference", F.when(F.col("_in").isNull(), "missing").when(~same, "changed").alias("problem")).where("problem is not null")


def class_audit(records: DataFrame, allowed: list[str]) -> DataFrame:
    """(lane, n, allowed): how many bases of each evidence class came back."""
    return records.groupBy("lane").agg(F.count("*").alias("n")).withColumn("allowed", F.col("lane").isin(*allowed))


def latency_percentiles(samples: DataFrame, group: str, value: str, at=(0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles: the element at ceil(n q) - 1."""
    named = [F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double").alias(f"p{round(q * 100)}") for q in at]
    return samples.groupBy(group).agg(F.count(value).alias("n"), *named)
