"""Layout repair from an export to passages and notes."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.plans import repair as R
from lectern.plans.snapshots import Store
from lectern.sources import layout_json as J


def made(spark, pages, verses, **more):
    blocks = J.blocks(spark.createDataFrame([("d", J.export_of(pages))], "doc string, json string"))
    titles = spark.createDataFrame([("1NEPHI", "1-ne", 2)], "title_key string, book string, n_chapters int")
    expected = spark.createDataFrame([(f"bofm/1-ne/1/{v}", v - 1) for v in range(1, verses + 1)], "reference string, canonical_order long")
    sizes = spark.createDataFrame([("d", k, 50.0, 100.0) for k in range(len(pages))], "doc string, page int, source_width double, source_height double")
    return R.repair(blocks, titles, expected, sizes, **more)


def head():
    return [("SectionHeader", "1 NEPHI", (10, 5, 90, 12)), ("SectionHeader", "CHAPTER 1", (10, 14, 90, 20))]


def block(text, top, x0=5, x1=95):
    return ("Text", text, (x0, top, x1, top + 8))


def foot(text):
    return ("Footnote", text, (5, 180, 95, 195))


def notes(m):
    return sorted((r.origin_reference.rpartition("/")[2], r.anchor, r.kind == R.FOOTNOTE, r.text) for r in m.notes.collect())


def codes(m):
    return sorted((r.code, r.reference and r.reference.rpartition("/")[2]) for r in m.findings.collect())


def test_whole(spark, tmp_path):
    m = made(spark, [[*head(), block("First <sup>a</sup>one <sup>b</sup>here.", 30), block("2 Second <sup>a</sup>two.", 40), foot("<p>1a note one. b note two. 2a note three.</p>")]], 2)
    rows = {r.reference: r for r in m.passages.collect()}
    assert {k: r.text for k, r in rows.items()} == {"bofm/1-ne/1/1": "First one here.", "bofm/1-ne/1/2": "Second two."}
    span = rows["bofm/1-ne/1/1"].source_spans[0]
    assert (span.page, span.bbox.x0, span.bbox.bottom) == (1, 2.5, 19.0)
    assert notes(m) == [("1", "a", True, "note one."), ("1", "b", True, "note two."), ("2", "a", True, "note three.")]
    assert codes(m) == []
    store = Store(spark, f"file://{tmp_path}")
    folder = R.publish(store, m, {"json": "0"})
    assert R.publish(store, m, {"json": "0"}) == folder and '"review_required"' in store.read(f"{folder}/report.json")
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/{folder}/candidate.jsonl").collect()]
    assert [(x["type"], x.get("reference"), x.get("anchor")) for x in lines] == [("passage", "bofm/1-ne/1/1", None), ("passage", "bofm/1-ne/1/2", None), ("note", None, "a"), ("note", None, "b"), ("note", None, "a")]
    assert [x["text"] for x in lines] == ["First one here.", "Second two.", "note one.", "note two.", "note three."]


def test_relabelled_recovered_and_unlinked(spark):
    pages = [[*head(), block("First <sup>b</sup>one <sup>c</sup>here.", 30), block("2 Second <sup>a</sup>two.", 40), block("3 Third <sup>a</sup>three.", 50), foot("<p>1a one. 1b two. 2a three. 2b missed. 9a stray</p>")]]
    m = made(spark, pages, 3)
    assert notes(m) == [("1", "a", True, "one."), ("1", "b", True, "two."), ("2", "a", True, "three."), ("2", "b", True, "missed."), ("3", "a", False, None)]
    assert codes(m) == [("apparatus_entry_false_positive", None), ("apparatus_text_unlinked", "3"), ("inline_anchor_recovered", "2"), ("inline_anchor_repaired", "1"), ("inline_anchor_repaired", "1")]


def test_corrections_and_order(spark):
    pages = [[*head(), block("First <sup>a</sup>one.", 30), block("2 Second <sup>a</sup>two.", 40), foot("<p>7a overridden 2c by order</p>")]]
    m = made(spark, pages, 2, corrections=R.Corrections({("bofm/1-ne/1/1", "a"): 7}, sources={"json": "1"}), sources={"json": "1"})
    for wrong in ({}, {"sources": {"json": "2"}}):
        with pytest.raises(ValueError, match="exactly"):
            made(spark, pages, 2, corrections=R.Corrections({("bofm/1-ne/1/1", "a"): 7}, sources={"json": "1"}), **wrong)
    assert notes(m) == [("1", "a", True, "overridden"), ("2", "a", True, "by order")]
    assert codes(m) == [("apparatus_anchor_reconciled", "2"), ("source_profile_correction", "1")]


@pytest.mark.parametrize("real", [1, 2])
def test_glyphs_tell_false_markers(spark, real):
    pages = [[*head(), block("First <sup>a</sup>one <sup>b</sup>x.", 30), foot("<p>1a note</p>")]]
    body = [("d", 0, k, "m", 10.0, 5.0 + k, 16.0, 6.0 + k, 18.0) for k in range(9)]
    small = [("d", 0, 20 + k, "ab"[k], 5.0, 20.0 + k, 15.5, 21.0 + k, 17.0) for k in range(real)]
    glyphs = spark.createDataFrame(body + small, "doc string, page int, ord int, text string, size double, x0 double, top double, x1 double, bottom double")
    m = made(spark, pages, 1, glyphs=glyphs)
    assert ("inline_anchor_false_positive" in {c for c, _ in codes(m)}) == (real == 1)
    assert len(notes(m)) == real


def test_review_files(spark, tmp_path):
    m = made(spark, [[*head(), block("One.", 30), block("2 Two.", 40)]], 2)
    units = m.passages.withColumn("canonical_order", F.element_at(F.split("reference", "/"), -1).cast("long")).withColumn("content_hash", F.sha2("text", 256))
    store = Store(spark, f"file://{tmp_path}")
    edges = m.notes.select(F.col("note_id").alias("edge_id")).limit(0)
    paths = R.publish_review(store, units, m.notes, edges, "x", F.concat(F.lit("PDF page "), F.get("source_spans", F.lit(0))["page"]), "pdf", "p")
    assert [len(spark.read.text(p).collect()) > 0 for p in paths] == [True] * 3
    assert R.publish_review(store, units, m.notes, edges, "x", F.lit("PDF page 1"), "pdf", "p") == paths
