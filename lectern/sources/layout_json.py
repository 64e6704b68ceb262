"""Layout exports: JSON trees of pages and blocks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.layout import carry_forward, markup_text, visual_order

BLOCK = "struct<block_type: string, html: string, bbox: array<double>>"
TREE = f"struct<children: array<struct<block_type: string, bbox: array<double>, children: array<{BLOCK}>>>>"


def blocks(exports: DataFrame) -> DataFrame:
    """Blocks of exports (doc, json): pages from 0, blocks in their order, with the page's box."""
    tree = F.from_json("json", TREE, {"mode": "FAILFAST"})
    pages = exports.select("doc", F.posexplode(tree["children"]).alias("page", "p"))
    whole = F.when((F.col("p.block_type") == "Page") & (F.size("p.bbox") == 4), F.col("p")).otherwise(F.raise_error(F.lit("a malformed page")).cast(pages.schema["p"].dataType))
    rows = pages.withColumn("p", whole).select("doc", "page", F.col("p.bbox").alias("pb"), F.posexplode("p.children").alias("ord", "b"))
    at = lambda box, k: F.get(box, F.lit(k))
    names = ("x0", "top", "x1", "bottom")
    return rows.select("doc", "page", "ord", F.col("b.block_type").alias("block_type"), F.coalesce("b.html", F.lit("")).alias("html"), *[at(F.col("b.bbox"), k).alias(n) for k, n in enumerate(names)], *[at(F.col("pb"), k).alias(f"page_{n}") for k, n in enumerate(names)])


def read(spark: SparkSession, path: str) -> DataFrame:
    return blocks(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("json")))


def fragments(blocks_: DataFrame, titles: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Text blocks in reading order, under their book and chapter, as verse_fsm reads them.

    shown: (doc, page, ord, shown), numbers that the page shows in a block's box.
    """
    rows = visual_order(blocks_).withColumn("text", markup_text(F.col("html"))).where("text <> ''")
    rows = carry_forward(rows, titles).where("block_type = 'Text' AND chapter IS NOT NULL")
    rows = rows.join(shown, ["doc", "page", "ord"], "left") if shown is not None else rows.withColumn("shown", F.lit(None).cast("array<int>"))
    k = F.row_number().over(W.partitionBy("doc", "book", "chapter").orderBy("page", "seq")).cast("long")
    return rows.select("doc", "book", "chapter", "page", k.alias("k"), "text", ((F.col("x1") - F.col("x0")) / (F.col("page_x1") - F.col("page_x0"))).alias("width_ratio"), F.contains("html", F.lit("<i>")).alias("italic"), "shown", "x0", "top", "x1", "bottom", "page_x0", "page_top", "page_x1", "page_bottom")


def export_of(pages: list[list[tuple]], width: float = 100, height: float = 200) -> str:
    """An export of pages of blocks (block_type, html, bbox), for tests and samples."""
    return json.dumps({"children": [{"block_type": "Page", "bbox": [0, 0, width, height], "children": [{"block_type": t, "html": h, "bbox": list(b)} for t, h, b in p]} for p in pages]})


def sample() -> str:
    one = [
        ("SectionHeader", "<h1>1 NEPHI</h1>", (10, 5, 90, 12)),
        ("SectionHeader", "<h2>CHAPTER 1</h2>", (10, 14, 90, 20)),
        ("Text", "<p><i>An account of things</i></p>", (10, 22, 90, 28)),
        ("Text", "<p>First verse<sup>a</sup> text.</p>", (5, 30, 45, 40)),
        ("Text", "<p>3 Third verse. 4 Fourth one.</p>", (55, 30, 95, 40)),
        ("Text", "<p><sup>2</sup> Second <sup>a</sup>verse.</p>", (5, 42, 45, 52)),
        ("Footnote", "<p>1a note one. 2a note two b more</p>", (5, 180, 95, 195)),
    ]
    return export_of([one])
