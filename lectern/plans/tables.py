"""The driver's tables seen as a corpus: units, edges, notes, judgments, cases, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import digest
from lectern.operators import search
from lectern.operators.lookup import numbered
from lectern.shared import kept

#: Evaluation cases over the corpus: id, split, query.
CASES = [("c1", "locked", "the of"), ("c2", "development", "erin thing"), ("c3", "locked", "que le"), ("c4", "development", "nowhere at all")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, one for each key."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))


def units(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Documents as units: book = language, chapter = source, verse = place in it; a dense canonical order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("book"), (F.substring("source", 4, 9).cast("int") + 1).alias("chapter"), *columns)
    rows = numbered(docs, ["book", "chapter"], ["doc_id"], within="verse").withColumn("verse", F.col("verse") + 1)
    return rows.withColumn("reference", F.concat_ws("/", F.lit("doc"), "book", "chapter", "verse"))


def index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stored units, stats and blocks of postings of the documents, and nothing read twice to make them."""

    def make(put):
        stored = put("units", units(spark, sf_dir).select("canonical_order", "reference", "book", "doc_id", "text"))
        toks = search.tokenized(stored)
        stats = put("stats", search.statistics(toks))
        put("blocks", search.blocks(toks, stats).repartitionByRange("term", "block").sortWithinPartitions("term", "block"))

    return kept(spark, "index", [f"{sf_dir}/documents.parquet"], make)


def hashed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).withColumn("content_hash", digest(F.col("text")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as citation edges between nodes of work bofm: origin 1-ne/<order % 40 + 1>/<part % 7 + 1>, a target that is a range for some and external for others."""
    line = lines(spark, sf_dir)
    origin = F.concat(F.lit("bofm/1-ne/"), F.col("l_orderkey") % 40 + 1, F.lit("/"), F.col("l_partkey") % 7 + 1)
    external = F.col("l_suppkey") % 11 == 0
    verse, chapter = F.col("l_suppkey") % 7 + 1, F.col("l_partkey") % 40 + 1
    target = F.struct(
        F.when(external, "external").otherwise("internal").alias("kind"), F.when(external, "bible").otherwise("bofm").alias("work"), F.when(external, "john").otherwise("1-ne").alias("book"),
        chapter.alias("chapter"), verse.alias("verse"), F.when(F.col("l_linenumber") == 2, verse + 1).alias("end_verse"),
    )
    edge = F.format_string("e%09d-%d", "l_orderkey", "l_linenumber")
    return line.select(edge.alias("edge_id"), origin.alias("origin_reference"), target.alias("target"))


def nodes(spark: SparkSession) -> DataFrame:
    """The 40 x 8 nodes that edges connect, in canonical order."""
    n = spark.range(320)
    return n.select(F.concat(F.lit("bofm/1-ne/"), F.expr("id div 8") + 1, F.lit("/"), F.col("id") % 8 + 1).alias("reference"), F.col("id").alias("canonical_order"))


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "case_id string, split string, query string")


def judgments(spark: SparkSession, sf_dir: str, units_: DataFrame) -> DataFrame:
    """Labels as graded judgments, 0 to 3, the same for each case."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") * 2 + 1 - F.col("toxic")).cast("int").alias("grade"))
    return labels.join(units_.select("doc_id", "reference"), "doc_id").select("reference", "grade").crossJoin(F.broadcast(cases(spark).select("case_id")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks of layout: an order is a page of width 100 and height 200."""
    line = lines(spark, sf_dir)
    x0, top = F.col("l_partkey") % 60, F.col("l_suppkey") % 13 * 15
    kind = F.element_at(F.array(*map(F.lit, ("Text", "Text", "SectionHeader", "Footnote", "Table"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return line.select(
        F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), kind.alias("block_type"), F.col("l_returnflag").alias("html"),
        x0.cast("double").alias("x0"), top.cast("double").alias("top"), (x0 + F.col("l_quantity")).cast("double").alias("x1"), (top + 10).cast("double").alias("bottom"),
        F.lit(0.0).alias("page_x0"), F.lit(0.0).alias("page_top"), F.lit(100.0).alias("page_x1"), F.lit(200.0).alias("page_bottom"),
    )


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as glyphs of a page."""
    line = lines(spark, sf_dir)
    return line.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.char(F.lit(97) + F.col("l_partkey") % 14).alias("text"),
        F.when(F.col("l_suppkey") % 3 == 0, 5.0).otherwise(10.0 + F.col("l_suppkey") % 2).alias("size"),
        (F.col("l_partkey") % 90).cast("double").alias("x0"), (F.col("l_suppkey") % 9 * 4).cast("double").alias("top"),
        (F.col("l_partkey") % 90 + 5).cast("double").alias("x1"), (F.col("l_suppkey") % 9 * 4 + 8).cast("double").alias("bottom"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("box_id"), F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 40).cast("double").alias("x0"), F.lit(5.0).alias("top"),
        (F.col("o_custkey") % 40 + 50).cast("double").alias("x1"), F.lit(25.0).alias("bottom"),
    )
