"""Checks of a normalized corpus, each a query that returns what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.references import GRAMMAR, verses
from lectern.functions.text import collapse, digest

FINDINGS = "code string, reference string"


def _found(df: DataFrame, code: str, reference: str = "reference") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(reference).alias("reference"))


def duplicates(rows: DataFrame, key: str, code: str = "duplicate_passage") -> DataFrame:
    return _found(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), code, key)


def missing(passages: DataFrame, expected: DataFrame) -> DataFrame:
    return _found(expected.join(passages, "reference", "left_anti").distinct(), "missing_passage")


def unexpected(passages: DataFrame, expected: DataFrame) -> DataFrame:
    return _found(passages.join(expected, "reference", "left_anti").select("reference").distinct(), "unexpected_passage")


def wrong_order(passages: DataFrame, expected: DataFrame) -> DataFrame:
    right = expected.select("reference", F.col("canonical_order").alias("_right"))
    return _found(passages.join(right, "reference").where("canonical_order <> _right"), "wrong_canonical_order")


def wrong_hash(passages: DataFrame) -> DataFrame:
    return _found(passages.where(digest(F.col("text")) != F.col("content_hash")), "content_hash_mismatch")


def without_spans(rows: DataFrame, code: str = "missing_source_span", reference: str = "reference") -> DataFrame:
    return _found(rows.where(F.coalesce(F.size("source_spans"), F.lit(0)) == 0), code, reference)


def orphan_notes(notes: DataFrame, passages: DataFrame) -> DataFrame:
    there = passages.select(F.col("reference").alias("origin_reference")).distinct().withColumn("_there", F.lit(1))
    joined = notes.join(there, "origin_reference", "left")
    return _found(joined.where(F.col("_there").isNull() | (F.coalesce(F.size("source_spans"), F.lit(0)) == 0)), "orphan_apparatus", "origin_reference")


def orphan_edges(edges: DataFrame, passages: DataFrame) -> DataFrame:
    there = passages.select(F.col("reference").alias("origin_reference")).distinct()
    return _found(edges.join(there, "origin_reference", "left_anti"), "orphan_edge", "origin_reference")


def other_grammar(edges: DataFrame) -> DataFrame:
    return _found(edges.where(F.col("grammar_version") != GRAMMAR), "unsupported_official_reference_grammar", "origin_reference")


def broken_edges(edges: DataFrame, passages: DataFrame) -> DataFrame:
    """Verses of internal targets that the corpus lacks, a row for each edge and verse."""
    asked = edges.where(F.col("target.kind") == "internal").select("edge_id", F.explode(verses(F.col("target"))).alias("reference")).distinct()
    return _found(asked.join(passages.select("reference"), "reference", "left_anti"), "broken_local_edge")


def validate_corpus(passages: DataFrame, notes: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(code, reference) of everything that is wrong, all twelve codes."""
    checks = [
        duplicates(passages, "reference"), missing(passages, expected), unexpected(passages, expected), wrong_order(passages, expected), wrong_hash(passages),
        without_spans(passages), orphan_notes(notes, passages), duplicates(edges, "edge_id", "duplicate_official_edge"), orphan_edges(edges, passages),
        without_spans(edges, "official_edge_missing_source_span", "origin_reference"), other_grammar(edges), broken_edges(edges, passages),
    ]
    return reduce(DataFrame.unionByName, checks)


def finding_report(findings: DataFrame) -> DataFrame:
    """One row: blocked or accepted, the number of findings, and how many of each code."""
    by = findings.groupBy("code").agg(F.count("*").alias("n"))
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws("=", x["code"], x["n"])), ",")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return by.agg(F.when(total > 0, "blocked").otherwise("accepted").alias("status"), total.alias("n_findings"), codes.alias("codes"))


def reconcile(persisted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(side, rows...) of the multiset difference both ways; empty when they agree."""
    return wanted.exceptAll(persisted).withColumn("side", F.lit("absent")).unionByName(persisted.exceptAll(wanted).withColumn("side", F.lit("extra")))


def _span_findings(spans: DataFrame, sources: DataFrame, kind: str, readable: Column, holds: Column) -> DataFrame:
    joined = spans.join(sources, "source_id", "left")
    code = F.when(F.col("kind") != kind, "source_span_kind_mismatch").when(~F.coalesce(readable, F.lit(False)), "source_span_unreadable").when(~F.coalesce(holds, F.lit(False)), "source_span_mismatch")
    return joined.select(code.alias("code"), "reference").where("code is not null")


def reconcile_spans(spans: DataFrame, sources: DataFrame, kind: str = "epub") -> DataFrame:
    """Findings of spans (reference, kind, source_id, start, end, text) against sources (source_id, content).

    The text must occur in the cited part of the source, white space aside. For
    pages, content is the text of the cited box, and start and end are null.
    """
    start, end = F.col("start"), F.col("end")
    cited = F.when(start.isNull(), F.col("content")).otherwise(F.substr("content", start + 1, end - start))
    readable = F.col("content").isNotNull() & (start.isNull() | ((start >= 0) & (end >= start) & (end <= F.length("content"))))
    return _span_findings(spans, sources, kind, readable, F.contains(collapse(cited), collapse(F.col("text"))))


def reconcile_sources(spans: DataFrame, contents: dict[str, DataFrame]) -> DataFrame:
    """Findings of spans (reference, source_format, kind, source_id, start, end, text), each against the contents (source_id, content) of its source's format.

    A format without contents is unsupported: all references from it are findings.
    """
    known = F.col("source_format").isin(*contents)
    found = spans.where(~F.coalesce(known, F.lit(False))).select(F.lit("unsupported_source").alias("code"), "reference").distinct()
    for kind, sources in contents.items():
        found = found.unionByName(reconcile_spans(spans.where(F.col("source_format") == kind), sources, kind))
    return found
