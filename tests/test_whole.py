"""Queries over whole tables against plain Python."""

import hashlib
import json
from collections import Counter

import pytest

from lectern.operators import ingest
from lectern.plans import tables as T
from lectern.plans.queries import QUERIES
from tests.oracle import duck

@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_order_line_is_an_edge(spark, sf, con):
    assert QUERIES["target_key"](spark, sf).count() == con.sql("SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem").fetchall()[0][0]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def rooted(rows):
    """(n, digest) of rows (place, line) by plain lists: leaves of 4096 places, nodes of 4096 leaves, the root."""
    level = [(p, sha(line)) for p, line in rows]
    for _ in range(2):
        groups = {}
        for p, d in sorted(level):
            groups.setdefault(p // 4096, []).append(f"{p}:{d}")
        level = [(p, sha("\n".join(g))) for p, g in groups.items()]
    return len(rows), sha("\n".join(f"{p}:{d}" for p, d in sorted(level)))


def test_metadata_digest_covers_all_documents(spark, sf, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["corpus_metadata"](spark, sf).collect()[0]
    assert (got.n_units, got.digest) == rooted([(i, "" if t is None else sha(t)) for i, t in rows])


def canonical(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_lines_hold_texts_notes_and_edges(spark, sf):
    units = [r.asDict() for r in T.hashed_units(spark, sf).collect()]
    passage = lambda u: {k: u[k] for k in ("canonical_order", "content_hash", "reference", "text")}
    assert Counter(map(tuple, QUERIES["canonical_projection"](spark, sf).collect())) == Counter((u["canonical_order"], sha(canonical(passage(u)))) for u in units)
    want = Counter([(0, 0, "", sha(canonical({"type": "corpus", "source_format": "table", "source_profile": "driver", "normalized_digest": "x"})))])
    want += Counter((1, u["canonical_order"], u["reference"], sha(canonical({"type": "passage", **passage(u)}))) for u in units)
    want += Counter((2, 0, f"n{u['doc_id']}", sha(canonical({"type": "note", "anchor": None, "note_id": f"n{u['doc_id']}"}))) for u in units)
    for e in T.edges(spark, sf).collect():
        t = e.target
        target = f"{t.work}/{t.book}/{t.chapter}/{t.verse}" + ("" if t.end_verse is None else f"-{t.end_verse}")
        want[3, 0, e.edge_id, sha(canonical({"type": "edge", "edge_id": e.edge_id, "origin_reference": e.origin_reference, "target": target}))] += 1
    assert Counter(map(tuple, QUERIES["serialize_jsonl"](spark, sf).select("kind_ord", "key_ord", "key", "line").collect())) == want


def test_lines_escape_what_json_needs(spark):
    texts = ['say "hi"', "a\nb\tc\rd", "back\\slash / é 日本 😀", "\x01\x0b\x1f\x7f\u2028", "", None]
    rows = spark.createDataFrame([(k, "h", "r", t) for k, t in enumerate(texts)], "canonical_order long, content_hash string, reference string, text string")
    got = {r.canonical_order: r.line for r in ingest.canonical_projection(rows).collect()}
    assert {k: json.loads(v)["text"] for k, v in got.items()} == dict(enumerate(texts))
    assert got[0] == canonical({"canonical_order": 0, "content_hash": "h", "reference": "r", "text": texts[0]})


def test_review_groups_roll_digests(spark, sf):
    groups = {}
    for u in (r.asDict() for r in T.hashed_units(spark, sf).collect()):
        line = f"- `{u['reference']}` — {u['text']}\n  - content SHA-256: `{u['content_hash']}`"
        groups.setdefault(f"EPUB member `{u['chapter']}.xhtml`", []).append((u["canonical_order"], line))
    assert {r.location: (r.n_passages, r.body) for r in QUERIES["review_groups"](spark, sf).collect()} == {k: rooted(g) for k, g in groups.items()}


def test_a_digest_tree_of_one_large_group(spark, monkeypatch):
    """Three levels over 2000 places with a fan-out of 8: no list is longer, the partitioning doesn't show, and what changed is found from the top."""
    from pyspark.sql import functions as F

    from lectern.operators import digests

    monkeypatch.setattr(digests, "FAN", 8)
    monkeypatch.setattr(digests, "LEVELS", 3)
    rows = spark.range(2000).select("id", F.concat(F.lit("line "), "id").alias("line"))
    tree = lambda df: digests.table(digests.tree(df, F.col("id"), F.col("line")))
    whole = tree(rows)
    assert {r.level: (r.n, r.most) for r in whole.groupBy("level").agg(F.count("*").alias("n"), F.max(F.when(F.col("level") == 0, F.col("n"))).alias("most")).collect()} == {0: (250, 8), 1: (32, None), 2: (4, None)}
    root = lambda df: digests.rolled(df, F.col("id"), F.col("line")).first()
    assert root(rows) == root(rows.repartition(7, F.rand(3))) and root(rows) != root(rows.where("id <> 1234"))
    other = rows.where("id <> 1999").withColumn("line", F.when(F.col("id").isin(3, 1234), "x").otherwise(F.col("line"))).unionByName(spark.createDataFrame([(2100, "new")], "id long, line string"))
    assert {r.nth for r in digests.differing(whole, tree(other)).collect()} == {0, 1234 // 8, 1999 // 8, 2100 // 8}
    assert digests.differing(whole, tree(rows.repartition(3))).count() == 0
    found = {r.id: (r.old is None, r.new is None) for r in digests.changed_rows(rows, other, "id", F.col("id"), F.col("line")).collect()}
    assert found == {3: (False, False), 1234: (False, False), 1999: (False, True), 2100: (True, False)}
    assert root(rows.limit(0)).n == 0


def test_headings_carry_over_one_long_document(spark):
    """All rows under one document, over many stretches of pages, against a plain loop."""
    import random

    from lectern.operators import layout

    rnd = random.Random(5)
    rows, want, book, chapter = [], {}, None, 0
    for page in range(0, 1500):
        if rnd.random() < 0.3:
            continue
        for seq in range(rnd.randint(1, 3)):
            text = rnd.choice([*["words"] * 60, "JACOB", "Enos", "CHAPTER 4", "CHAPTER 11"]) if not 300 < page < 700 else "words"
            head = text != "words"
            if text == "JACOB":
                book, chapter = "jacob", 0
            elif text == "Enos":
                book, chapter = "enos", 1
            elif head:
                chapter = int(text[8:])
            rows.append(("d", page, seq, "SectionHeader" if head else "Text", text))
            want[page, seq] = (book, (chapter or None) if book else None)
    titles = spark.createDataFrame([("JACOB", "jacob", 7), ("ENOS", "enos", 1)], "title_key string, book string, n_chapters int")
    blocks = spark.createDataFrame(rows, "doc string, page int, seq int, block_type string, text string")
    found = layout.carry_forward(blocks, titles)
    assert {(r.page, r.seq): (r.book, r.chapter) for r in found.collect()} == want
    assert blocks.select((blocks.page / layout.STRETCH).cast("int").alias("s")).distinct().count() > 20


def test_review_holds_no_location_in_one_value(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.plans import repair
    from lectern.plans.snapshots import Store

    units = spark.createDataFrame([(f"r{k}", f"t{k}", k, f"h{k}", ["s"]) for k in range(2500)], "reference string, text string, canonical_order long, content_hash string, source_spans array<string>")
    notes = spark.createDataFrame([], "note_id string")
    at = F.when(F.col("canonical_order") < 2400, "a").otherwise("b")
    path = repair.publish_review(Store(spark, f"file://{tmp_path}"), units, notes, notes.select(F.col("note_id").alias("edge_id")), "x", at)[0]
    got = "".join(f.read_text() for f in sorted((tmp_path / "reviews/x/review.md").glob("part-*")))
    body = lambda r: "\n".join(f"- `r{k}` — t{k}\n  - content SHA-256: `h{k}`" for k in r)
    assert got == f"## a\n\n{body(range(2400))}\n\n## b\n\n{body(range(2400, 2500))}\n\n"
    assert ingest.review_lines(units, at).count() == 2500


def test_lists_keep_their_own_verdicts_after_a_shuffle(spark):
    """Rows meet their verdict by the list's text, whatever order they come in."""
    from pyspark.sql import functions as F

    forms = {"bofm/1-ne/1/2": ("parsed", 1), "bofm/1-ne/1/9": ("invalid", 0), "bible/john/3/16": ("unresolved_external", 1), "": ("unsupported", 0), "bofm/1-ne/1/2; bofm/1-ne/1/2": ("invalid", 0), "bofm/1-ne/1/1-3": ("parsed", 1), None: ("unsupported", 0)}
    rows = [(k, list(forms)[k % len(forms)]) for k in range(3000)]
    lists = spark.createDataFrame(rows, "id long, list string").repartition(7, F.rand())
    valid = spark.createDataFrame([(f"bofm/1-ne/1/{v}",) for v in range(1, 5)], "reference string")
    got = ingest.grammar_parse(lists, "list", valid).collect()
    assert len(got) == 3000 and all((r.state, r.n_targets) == forms[r.list] for r in got)


def test_strict_lists_are_parsed_where_they_differ(spark):
    """A filter on verdicts, as before a strict parse, isn't moved to where it would parse every row."""
    from pyspark.sql import functions as F

    forms = ["bofm/1-ne/1/2", "bofm/1-ne/1/1-3; bible/john/3/16.", "bofm/1-ne/1/9", "bofm/1-ne/1/1, bofm/1-ne/1/2", "bofm/1-ne/1/1;;bofm/1-ne/1/2"]
    lists = spark.range(1000).select("id", F.element_at(F.array(*map(F.lit, forms)), (F.col("id") % 5 + 1).cast("int")).alias("list"))
    valid = spark.createDataFrame([(f"bofm/1-ne/1/{v}",) for v in range(1, 5)], "reference string")
    good = ingest.grammar_parse(lists, "list", valid).where("n_targets > 0").select("id", "list")
    found = ingest.grammar_strict(good, "list", valid)
    assert {(r.id % 5, r.normalized_text) for r in found.collect()} == {(0, forms[0]), (1, forms[1][:-1])} and found.count() == 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") > 0 and not [line for line in plan.split("\n") if "Filter" in line and ("regexp" in line or "RLIKE" in line)]


def test_numbers_beyond_64_bits_stay_in_lists(spark):
    big = "9" * 20
    want = {f"bible/john/{big}/1": 1, f"bible/john/{big}/1; bible/john/{big}8/1": 2, f"bofm/1-ne/1/1-{big}": 0, f"bofm/1-ne/{big}/1": 0}
    valid = spark.createDataFrame([("bofm/1-ne/1/1",)], "reference string")
    got = ingest.grammar_parse(spark.createDataFrame([(t,) for t in want], "list string"), "list", valid).collect()
    assert {r.list: r.n_targets for r in got} == want and all(r.normalized_text == (r.list if r.n_targets else None) for r in got)


def test_numbered_keeps_null_groups(spark):
    from lectern.operators.lookup import numbered

    rows = [(None, None, 3), (None, "a", 1), ("en", None, 2), ("en", "a", 5), ("en", "a", 4), (None, None, 1)]
    got = {(r.a, r.b, r.i): (r.canonical_order, r.v) for r in numbered(spark.createDataFrame(rows, "a string, b string, i int"), ["a", "b"], ["i"], within="v").collect()}
    assert got == {(None, None, 1): (0, 0), (None, None, 3): (1, 1), (None, "a", 1): (2, 0), ("en", None, 2): (3, 0), ("en", "a", 4): (4, 0), ("en", "a", 5): (5, 1)}
