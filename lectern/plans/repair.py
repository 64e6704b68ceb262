"""From a layout export to passages, notes and findings, all operators of layout together."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import collapse, stable_id
from lectern.operators import ingest
from lectern.operators import layout as L
from lectern.shared import cut
from lectern.plans.snapshots import Store, canonical, rows_digest, sha256
from lectern.sources.layout_json import fragments

FOOTNOTE, ANCHOR = "official-footnote", "official-footnote-anchor"


@dataclass(frozen=True)
class Corrections:
    """What a reviewer has verified for one exact source: verses of misprinted footnotes, and markers that aren't there."""

    verse_overrides: dict | None = None
    false_anchors: frozenset = frozenset()
    sources: dict | None = None  # digests of the files that they were verified against, by kind

    def bound(self, sources: dict | None) -> None:
        """Refuses corrections for other files than those given, and corrections without files."""
        if (self.verse_overrides or self.false_anchors) and (not self.sources or self.sources != sources):
            raise ValueError("corrections are for exactly the files that they were verified against")


@dataclass(frozen=True)
class Repair:
    passages: DataFrame  # doc, reference, text, source_spans
    notes: DataFrame  # doc, note_id, origin_reference, anchor, kind, label, text
    findings: DataFrame  # code, reference


def _span(order: Column) -> Column:
    box = F.struct("x0", "top", "x1", "bottom")
    return F.struct(F.lit("pdf").alias("kind"), (F.col("page") + 1).alias("page"), box.alias("bbox"), order.alias("order"))


def _scaled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes in points of the source's pages; sizes: (doc, page, source_width, source_height)."""
    sized = rows.join(sizes, ["doc", "page"], "left")
    width, height = F.col("page_x1") - F.col("page_x0"), F.col("page_bottom") - F.col("page_top")
    sized = sized.withColumns({"width": width, "height": height, "source_width": F.coalesce("source_width", width), "source_height": F.coalesce("source_height", height)})
    return L.bbox_rescale(sized).drop("width", "height", "source_width", "source_height")


def _reference(prefix: str = "bofm") -> Column:
    return F.concat_ws("/", F.lit(prefix), "book", "chapter", "verse")


def _found(rows: DataFrame, code: str, reference: str = "reference") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(reference).alias("reference"))


def _superscripts(boxes: DataFrame, glyphs: DataFrame | None) -> DataFrame:
    """(box_id, n) for boxes (doc, box_id, page, box); zero everywhere without glyphs (doc, page, ord, text, size, box)."""
    if glyphs is None:
        return boxes.select("box_id", F.lit(0).cast("long").alias("n")).limit(0)
    page = F.concat_ws("#", "doc", "page")
    return L.superscript_count(L.glyph_box_join(glyphs.withColumn("page", page), boxes.withColumn("page", page)))


def _proposals(left: DataFrame, on_pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Left-over entries with the only verse that they can belong to: (entry columns, reference).

    That is the only verse of this number on the page; or the only one that
    lacks the label; or, where as many entries with one label are left as there
    are verses, each in order.
    """
    met = left.join(on_pages, ["doc", "page", "verse"])
    entry = ["doc", "page", "ord"]
    met = met.withColumn("n", F.count("*").over(W.partitionBy(*entry)))
    free = met.where("n > 1").join(resolved, ["reference", "anchor"], "left_anti").withColumn("m", F.count("*").over(W.partitionBy(*entry)))
    alone = met.where("n = 1").drop("n").unionByName(free.where("m = 1").drop("n", "m"))
    rest = met.where("n > 1").join(alone.select(*entry), entry, "left_anti")
    place = W.partitionBy("doc", "page", "verse")
    numbered = rest.withColumn("i", F.dense_rank().over(place.orderBy("ord"))).withColumn("j", F.dense_rank().over(place.orderBy("canonical_order")))
    whole = W.partitionBy("doc", "page", "verse")
    numbered = numbered.withColumn("a", F.max("i").over(whole)).withColumn("b", F.max("j").over(whole)).withColumn("labels", F.size(F.collect_set("anchor").over(whole)))
    return alone.unionByName(numbered.where("i = j AND a = b AND labels = 1").drop("i", "j", "a", "b", "labels", "n"))


def repair(blocks: DataFrame, titles: DataFrame, expected: DataFrame, sizes: DataFrame, glyphs: DataFrame | None = None, shown: DataFrame | None = None, corrections: Corrections = Corrections(), sources: dict | None = None) -> Repair:
    """Verses with their spans, notes with their texts, and everything that was mended or is in doubt.

    A verse that the structure lacks, or one that is missing, is a finding of
    validation, as for any source. Tables are written between steps. sources:
    digests of the files that all this comes from, which corrections must name.
    """
    corrections.bound(sources)
    read = cut(fragments(blocks, titles, shown))
    parsed = cut(L.verse_fsm(read))
    boxes = _scaled(read.select("doc", "book", "chapter", "k", "page", *[c for c in read.columns if c in ("x0", "top", "x1", "bottom") or c.startswith("page_")]), sizes)
    pieces = cut(parsed.where("finding IS NULL").drop("page").join(boxes, ["doc", "book", "chapter", "k"]).withColumn("reference", _reference()))
    own = F.row_number().over(W.partitionBy("doc").orderBy("page", "book", "chapter", "ord"))
    pieces = pieces.withColumn("order", own - 1)
    clean = collapse(F.regexp_replace("text", L.MARK, ""))
    passages = pieces.select("doc", "reference", F.struct("ord", clean.alias("t"), _span(F.col("order")).alias("s")).alias("x")).groupBy("doc", "reference").agg(F.sort_array(F.collect_list("x")).alias("x"))
    passages = passages.select("doc", "reference", F.array_join(F.filter(F.transform("x", lambda x: x["t"]), lambda t: t != ""), " ").alias("text"), F.transform("x", lambda x: x["s"]).alias("source_spans"))

    labels = L.inline_labels(pieces.select("reference", "ord", "text"))
    pages = pieces.groupBy("reference").agg(F.collect_set("page").alias("pages"))
    at = pieces.select("doc", "reference", "ord", "page", "verse", F.concat_ws("#", "doc", "reference", "page", "x0", "top", "x1", "bottom").alias("box_id"), "x0", "top", "x1", "bottom")
    marks = labels.join(at, ["reference", "ord"]).join(pages, "reference").join(expected, "reference", "left")
    notes = cut(marks.select("doc", stable_id(F.col("reference"), F.col("canonical")).alias("note_id"), "reference", F.col("canonical").alias("anchor"), "page", "pages", "box_id", (F.coalesce("canonical_order", F.lit(0)) * 1000 + F.col("nth")).cast("long").alias("ord"), "changed"))

    entries = cut(L.parse_apparatus(L.apparatus_order(L.apparatus_blocks(blocks))))
    links = cut(L.link_apparatus(notes.drop("box_id", "changed"), entries, corrections.verse_overrides, set(corrections.false_anchors)))
    shape = at.select("doc", "box_id", "page", "x0", "top", "x1", "bottom").dropDuplicates(["box_id"])
    counts = cut(_superscripts(shape, glyphs))
    false = cut(L.false_positives(links, notes.select("note_id", "box_id"), counts)) if glyphs is not None else links.select("note_id", "reference").limit(0)

    numbered = entries.withColumn("entry", L.entry_id(F.col("page"), F.col("ord")))
    numbered = cut(numbered)
    left = numbered.join(links.where("entry IS NOT NULL").select("doc", "entry"), ["doc", "entry"], "left_anti")
    good = links.join(false, "note_id", "left_anti")
    existing = good.join(numbered.select("doc", "entry", F.col("anchor").alias("entry_anchor")), ["doc", "entry"], "left").select("reference", F.coalesce("entry_anchor", "anchor").alias("anchor")).distinct()
    resolved = links.where("entry IS NOT NULL").join(numbered.select("doc", "entry", F.col("anchor").alias("a")), ["doc", "entry"]).select("reference", F.col("a").alias("anchor")).distinct()
    on_pages = pieces.select("doc", "page", "verse", "reference").distinct().join(expected, "reference", "left")
    proposed = _proposals(left, on_pages, resolved)
    if corrections.false_anchors:
        wrong = links.sparkSession.createDataFrame(sorted(corrections.false_anchors), "reference string, anchor string")
        proposed = proposed.join(wrong, ["reference", "anchor"], "left_anti")
    proposed = cut(proposed)
    shown_by = counts.join(at.select("box_id", "reference").distinct(), "box_id").groupBy("reference").agg(F.sum("n").alias("n"))
    recovered = cut(L.recover_labels(existing, proposed.select("reference", "anchor", "text", "explicit"), shown_by if glyphs is not None else None))

    again = recovered.select("reference").distinct().withColumn("_again", F.lit(True))
    linked = good.join(numbered.select("doc", "entry", F.col("anchor").alias("entry_anchor")), ["doc", "entry"], "left").join(again, "reference", "left")
    anchor = F.when(F.col("_again"), F.coalesce("entry_anchor", "anchor")).otherwise(F.col("anchor"))
    kept = linked.select("doc", F.col("reference").alias("origin_reference"), anchor.alias("anchor"), F.when(F.col("entry").isNotNull(), FOOTNOTE).otherwise(ANCHOR).alias("kind"), "text")
    mended = recovered.join(pieces.select("doc", "reference").distinct(), "reference").select("doc", F.col("reference").alias("origin_reference"), "anchor", F.lit(FOOTNOTE).alias("kind"), "text")
    every = kept.unionByName(mended)
    every = every.select("doc", stable_id(F.col("origin_reference"), F.col("anchor")).alias("note_id"), "origin_reference", "anchor", "kind", F.col("anchor").alias("label"), "text")

    every = cut(every)
    taken = proposed.join(recovered.select("reference", "anchor"), ["reference", "anchor"], "left_semi").select("doc", "page", "ord")
    unused = left.join(taken, ["doc", "page", "ord"], "left_anti").join(on_pages, ["doc", "page", "verse"], "left")
    assigned = every.select(F.col("origin_reference").alias("reference"), "anchor", F.lit(1).alias("_has")).distinct()
    unused = unused.join(assigned, ["reference", "anchor"], "left").groupBy("doc", "page", "ord").agg(F.bool_and(F.col("reference").isNull() | F.col("_has").isNotNull()).alias("false_entry"))
    none = F.lit(None).cast("string")
    findings = reduce(DataFrame.unionByName, [
        parsed.where("finding IS NOT NULL").select(F.col("finding").alias("code"), _reference().alias("reference")),
        _found(notes.where("changed"), "inline_anchor_repaired"),
        _found(links.where("how = 'override'"), "source_profile_correction"),
        _found(links.where("how = 'order'").select("reference").distinct(), "apparatus_anchor_reconciled"),
        _found(false, "inline_anchor_false_positive"),
        _found(recovered, "inline_anchor_recovered"),
        _found(every.where("text IS NULL").select("origin_reference").distinct(), "apparatus_text_unlinked", "origin_reference"),
        unused.where("false_entry").select(F.lit("apparatus_entry_false_positive").alias("code"), none.alias("reference")),
        unused.where("NOT false_entry").select(F.lit("apparatus_entry_unmatched").alias("code"), none.alias("reference")),
    ])
    return Repair(passages, every, findings)


def publish(store: Store, made: Repair, sources: dict[str, str]) -> str:
    """Writes a repair for review, as folders of text lines in order, under a digest of its rows and its sources' digests; never a corpus by itself.

    The report counts findings by code; the findings themselves are lines of a
    file, like passages and notes. All is written under a temporary name first.
    """
    part = lambda df, kind, *key: df.select(F.lit(kind).alias("part"), F.array(*key).alias("key"), ingest.json_line(kind, {c: F.col(c) for c in df.columns}).alias("line"))
    rows = cut(part(made.passages, "passage", "reference").unionByName(part(made.notes, "note", "origin_reference", "anchor")).unionByName(part(made.findings, "finding", "code", "reference")))
    code = F.when(F.col("part") == "finding", F.get_json_object("line", "$.code"))
    counts = {(r.part, r.code): r["count"] for r in rows.groupBy("part", code.alias("code")).count().collect()}  # a row a code
    found = {c: n for (kind, c), n in sorted(counts.items(), key=str) if kind == "finding"}
    report = {"status": "review_required", "sources": sources, "passages": counts.get(("passage", None), 0), "notes": counts.get(("note", None), 0), "findings": found}
    digest = sha256(rows_digest(rows.select("part", "line"), "line") + canonical(report))
    folder = f"repairs/{digest}"
    if not store.exists(folder):
        temporary = f"{folder}.{uuid.uuid4().hex}.tmp"
        files = {"candidate.jsonl": rows.where("part <> 'finding'").orderBy(F.desc("part"), "key", "line"), "findings.jsonl": rows.where("part = 'finding'").orderBy("key", "line")}
        for name, df in files.items():
            df.select("line").write.text(f"{store.root}/{temporary}/{name}")
        store.create(f"{temporary}/report.json", canonical(report) + "\n")
        store.rename(temporary, folder)
    return folder


def publish_review(store: Store, passages: DataFrame, notes: DataFrame, edges: DataFrame, normalized_digest: str, location: Column, source_format: str = "table", source_profile: str = "table-v1") -> list[str]:
    """Writes review.md, normalized.jsonl and, for pages, overlays.json of a normalized corpus, as folders of text lines in order."""
    root = f"{store.root}/reviews/{normalized_digest}"
    spark = passages.sparkSession
    rows = ingest.review_lines(passages, location)
    places = rows.select("location").distinct()
    # Of each location a heading, its lines and an empty line, each a row of its own.
    head_rows = places.select("location", F.lit(0).alias("part"), F.lit(None).cast("long").alias("place"), F.concat(F.lit("## "), F.col("location"), F.lit("\n")).alias("value"))
    line_rows = rows.where("line is not null").select("location", F.lit(1).alias("part"), F.col("canonical_order").cast("long").alias("place"), F.col("line").alias("value"))
    groups = head_rows.unionByName(line_rows).unionByName(places.select("location", F.lit(2).alias("part"), F.lit(None).cast("long").alias("place"), F.lit("").alias("value")))
    head = spark.createDataFrame([(source_format, source_profile, normalized_digest)], "source_format string, source_profile string, normalized_digest string")
    lines = ingest.serialize_jsonl(head, passages, notes, edges)
    out = {"review.md": groups.orderBy("location", "part", "place", "value").select("value"), "normalized.jsonl": lines.orderBy("kind_ord", "key_ord", "key").select(F.col("line").alias("value"))}
    if source_format == "pdf":
        out["overlays.json"] = ingest.overlays(passages).orderBy("reference").select(F.to_json(F.struct("reference", F.col("spans").alias("source_spans"))).alias("value"))
    for name, df in out.items():
        if not store.exists(f"reviews/{normalized_digest}/{name}"):
            df.write.text(f"{root}/{name}")
    return [f"{root}/{name}" for name in out]
