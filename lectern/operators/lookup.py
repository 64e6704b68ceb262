"""Exact lookups, context windows and canonical order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get_passage(units: DataFrame, reference: str) -> DataFrame:
    return units.where(F.col("reference") == reference)


def get_passage_by_id(units: DataFrame, canonical_order: int) -> DataFrame:
    return units.where(F.col("canonical_order") == canonical_order)


def with_origins(notes: DataFrame, units: DataFrame) -> DataFrame:
    """Notes with the canonical order of the unit that each belongs to; notes of units that aren't there are left out."""
    return notes.join(units.select(F.col("reference").alias("origin_reference"), "canonical_order"), "origin_reference")


def compatible(configs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Configurations (corpus_version, retrieval_config) of corpora that are accepted: the pairs that can be active."""
    return configs.join(accepted.select("corpus_version").distinct(), "corpus_version", "left_semi")


def get_context(units: DataFrame, canonical_order: int, before: int, after: int) -> DataFrame:
    """Units around one, across chapters and books, without it."""
    o = F.col("canonical_order")
    return units.where(o.between(max(0, canonical_order - before), canonical_order + after) & (o != canonical_order)).orderBy("canonical_order")


def get_context_batch(units: DataFrame, wanted: DataFrame, before: int, after: int) -> DataFrame:
    """(canonical_order, context_order, reference) for each wanted canonical_order.

    Every wanted unit asks for its neighbours' orders, an equi-join, so nothing
    is sorted into one task.
    """
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("canonical_order") - before), F.col("canonical_order") + after))
    asked = wanted.select("canonical_order", around.alias("context_order")).where("context_order <> canonical_order")
    return asked.join(units.select(F.col("canonical_order").alias("context_order"), "reference"), "context_order").select("canonical_order", "context_order", "reference")


def numbered(units: DataFrame, groups: list[str], order: list[str], name: str = "canonical_order", within: str | None = None) -> DataFrame:
    """Adds a dense order from 0 over (groups, order), and the order ``within`` a group: offsets of groups come from their counts.

    A null is a group like any other and comes first.
    """
    keys = [f"_g{k}" for k in range(len(groups))]
    sizes = units.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys))).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = units.withColumn("_own", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long") - 1)
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys)))
    placed = own.join(offsets, same).withColumn(name, F.col("_own") + F.col("_before"))
    return (placed.withColumn(within, F.col("_own")) if within else placed).drop("_own", "_before", *keys)
