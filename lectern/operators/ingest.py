"""From extracted rows to normalized ones: order, digests, lists of references, edges, serialized forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.references import AMBIGUOUS, BOOKS, EXTERNAL_WORKS, GRAMMAR, TARGET, parsed, rendered, target_key, verses
from lectern.functions.text import digest, stable_id
from lectern.operators import digests


def expected_references(structure: DataFrame, work: str = "bofm") -> DataFrame:
    """(reference, canonical_order) of a structure (book_ord, book, counts): books, chapters and verses in manifest order."""
    chapters = structure.select("book_ord", "book", F.posexplode("counts").alias("c", "n"))
    each = chapters.select("book_ord", "book", (F.col("c") + 1).alias("chapter"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("verse"))
    from lectern.operators.lookup import numbered

    each = numbered(each, ["book_ord"], ["chapter", "verse"])
    return each.select(F.concat_ws("/", F.lit(work), "book", "chapter", "verse").alias("reference"), "canonical_order")


def canonical_order(passages: DataFrame, expected: DataFrame) -> DataFrame:
    """Passages with their place in the structure; unknown references come after all."""
    size = F.broadcast(expected.agg(F.count("*").alias("_n")))
    return passages.join(expected, "reference", "left").crossJoin(size).withColumn("canonical_order", F.coalesce("canonical_order", "_n")).drop("_n")


def with_hash(passages: DataFrame) -> DataFrame:
    return passages.withColumn("content_hash", digest(F.col("text")))


def edge_expand(raw: DataFrame) -> DataFrame:
    """A row for each member of a list of targets, in order."""
    return raw.select("*", F.posexplode(F.split("target", ";")).alias("member_ord", "member")).withColumn("member", F.trim("member"))


#: States of a list of references by code; any other code is an invalid list.
STATES = {
    "official_reference_parsed": "parsed",
    "official_reference_unresolved_external_target": "unresolved_external",
    "official_reference_unsupported_syntax": "unsupported",
    "official_reference_ambiguous_syntax": "ambiguous",
}


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _whole(text: Column) -> Column:
    """The list without the full stop at its end."""
    return F.regexp_replace(F.regexp_replace(_stripped(text), r"\.\z", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def _members(whole: Column) -> Column:
    return F.transform(F.split(whole, ";"), _stripped)


def _inside(t: Column) -> Column:
    return F.coalesce((t["work"] == "bofm") & t["book"].isin(*BOOKS["bofm"]) & (F.coalesce(t["end_verse"], t["verse"]) >= t["verse"]), F.lit(False))


#: What a list can fail by, by number.
PROBLEMS = ("official_reference_unsupported_syntax", "official_reference_invalid_canonical_target", "official_reference_duplicate_target", "official_reference_ambiguous_syntax")
UNSUPPORTED, INVALID, DUPLICATE, AMBIGUITY = range(4)


def _decided(named: DataFrame, valid: DataFrame) -> DataFrame:
    """(_list, normalized_text, state, code, n_targets) of different lists: a row for each member, then for each verse of a member, added up over the list.

    What a member fails by is 4 times its place plus the problem's number; what
    the list as a whole fails by is less than any of these, so the least decides.
    """
    m, k, t = F.col("_members"), F.col("_k"), F.col("_t")
    early = F.when(F.col("_whole").rlike(AMBIGUOUS), AMBIGUITY - 4).when(F.array_contains(m, ""), UNSUPPORTED - 4)
    again = F.filter(F.transform(m, lambda x, i: F.when(F.array_position(m, x) <= i, i)), lambda i: i.isNotNull())
    twice = F.when(F.size(F.array_distinct(m)) < F.size(m), F.get(again, F.lit(0)) * 4 + DUPLICATE)
    lists = named.withColumn("_whole", _whole(F.col("_list"))).withColumn("_members", _members(F.col("_whole")))
    # Every list has a member; an explode that isn't outer would be preceded by a filter on their number, which Spark moves to all rows before they are told apart.
    members = lists.select("_list", F.least(early, twice).alias("_early"), F.posexplode_outer("_members").alias("_k", "_member")).withColumn("_t", parsed(F.col("_member")))

    backwards = F.coalesce(t["end_verse"], t["verse"]) < t["verse"]
    outside = (t["work"] == "bofm") & (~_inside(t) | (target_key(t) != F.col("_member")))  # a number beyond 64 bits is lost in the key
    problem = F.when(t.isNull() | ~t["work"].isin("bofm", *EXTERNAL_WORKS), UNSUPPORTED).when(outside | backwards, INVALID)
    external = F.coalesce(t["work"].isin(*EXTERNAL_WORKS), F.lit(False))
    each = members.select("_list", "_early", "_k", external.alias("_external"), problem.alias("_problem"), F.explode_outer(F.when(_inside(t), verses(t))).alias("_verse"))
    # Members without verses to look up keep their lists as keys: as nulls they would all meet in one task.
    each = each.withColumns({"_inside": F.col("_verse").isNotNull(), "_verse": F.coalesce("_verse", "_list")})
    each = each.join(valid.select(F.col("reference").alias("_verse")).distinct().withColumn("_known", F.lit(True)), "_verse", "left")

    problem = F.coalesce("_problem", F.when(F.col("_inside") & F.col("_known").isNull(), INVALID))
    found = each.groupBy("_list").agg(F.min(F.least("_early", k * 4 + problem)).alias("_first"), F.max("_external").alias("_external"), F.max(k + 1).cast("long").alias("_n"))
    first = F.col("_first")
    fine = F.when(F.col("_external"), "official_reference_unresolved_external_target").otherwise("official_reference_parsed")
    code = F.when(first.isNull(), fine).otherwise(F.element_at(F.array(*map(F.lit, PROBLEMS)), F.pmod(first, F.lit(4)) + 1))
    state = F.coalesce(*(F.when(F.col("code") == c, F.lit(v)) for c, v in STATES.items()), F.lit("invalid"))
    normalized = F.when(first.isNull(), F.array_join(_members(_whole(F.col("_list"))), "; "))
    return found.withColumn("code", code).select("_list", normalized.alias("normalized_text"), state.alias("state"), "code", F.when(first.isNull(), F.col("_n")).otherwise(0).alias("n_targets"))


def grammar_parse(lists: DataFrame, text: str, valid: DataFrame) -> DataFrame:
    """Adds normalized_text, state, code and n_targets to rows with lists of references; all or nothing.

    The checks go in the grammar's order: emptiness, ambiguity, empty members,
    then member by member syntax, work, range, membership and repetition; the
    first member that fails decides. ``valid`` has the references that exist,
    and may be as large as the corpus. Each different list is decided once, and
    its verdict goes back to the rows by its text. A null list is an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    decided = _decided(lists.select(whole.alias("_list")).distinct(), valid)
    rows = lists.drop("normalized_text", "state", "code", "n_targets")
    return rows.join(decided, whole == F.col("_list"), "left").drop("_list")


def grammar_strict(lists: DataFrame, text: str, valid: DataFrame) -> DataFrame:
    """Like grammar_parse, but a list without targets is an error that ends the job."""
    found = grammar_parse(lists, text, valid)
    return found.withColumn("state", F.when(F.col("n_targets") > 0, F.col("state")).otherwise(F.raise_error(F.col("code")).cast("string")))


def targets(members: DataFrame, column: str = "member") -> DataFrame:
    """Adds the target of a member that parses: kind, work, book, chapter, verse, end_verse, resolution."""
    t = parsed(F.col(column))
    internal = t["work"] == "bofm"
    target = F.struct(
        F.when(internal, "internal").otherwise("external").alias("kind"), t["work"].alias("work"), t["book"].alias("book"), t["chapter"].alias("chapter"),
        t["verse"].alias("verse"), t["end_verse"].alias("end_verse"), F.when(~internal, "unresolved_external").alias("resolution"),
    )
    return members.withColumn("target", F.when(t.isNotNull(), target))


def edge_ids(edges: DataFrame) -> DataFrame:
    """edge_id over origin, anchor, target key, attribution, grammar version and the spans' JSON."""
    t = F.col("target")
    key = rendered(t["work"], t["book"], t["chapter"], t["verse"], t["end_verse"])
    return edges.withColumn("grammar_version", F.lit(GRAMMAR)).withColumn("edge_id", stable_id(F.col("origin_reference"), F.col("origin_anchor"), key, F.col("source_attribution"), F.lit(GRAMMAR), F.col("spans_json")))


def json_line(kind: str, fields: dict[str, Column]) -> Column:
    """A row as canonical JSON: keys sorted, nulls written, no spaces."""
    named = [c.alias(k) for k, c in sorted({**fields, "type": F.lit(kind)}.items())]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def serialize_jsonl(head: DataFrame, passages: DataFrame, notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind_ord, key_ord, key, line): the header, passages by order and reference, notes and edges by id; a sink sorts by the first three."""
    part = lambda df, kind, n, order, key, fields: df.select(F.lit(n).alias("kind_ord"), order.cast("long").alias("key_ord"), key.alias("key"), json_line(kind, {f: F.col(f) for f in fields}).alias("line"))
    zero = F.lit(0)
    return (
        part(head, "corpus", 0, zero, F.lit(""), ["source_format", "source_profile", "normalized_digest"])
        .unionByName(part(passages, "passage", 1, F.col("canonical_order"), F.col("reference"), [c for c in ("reference", "text", "canonical_order", "content_hash", "source_spans") if c in passages.columns]))
        .unionByName(part(notes, "note", 2, zero, F.col("note_id"), notes.columns))
        .unionByName(part(edges, "edge", 3, zero, F.col("edge_id"), edges.columns))
    )


def canonical_projection(passages: DataFrame) -> DataFrame:
    """(canonical_order, line): what is the same whatever the source's format."""
    names = ["canonical_order", "content_hash", "reference", "text"]
    return passages.select("canonical_order", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


def rolled_digest(lines: DataFrame, order: str, line: str) -> DataFrame:
    """(normalized_digest): the root of the lines' digest tree, by their order; a null line is an empty one."""
    return digests.rolled(lines, F.col(order), F.coalesce(line, F.lit(""))).select(F.col("digest").alias("normalized_digest"))


def review_lines(passages: DataFrame, location: Column) -> DataFrame:
    """(location, canonical_order, line), a row for each passage; a sink sorts by all three, so no location meets whole in one task."""
    line = F.concat(F.lit("- `"), F.col("reference"), F.lit("` — "), F.col("text"), F.lit("\n  - content SHA-256: `"), F.col("content_hash"), F.lit("`"))
    return passages.select(location.alias("location"), "canonical_order", line.alias("line"))


def review_groups(passages: DataFrame, location: Column) -> DataFrame:
    """(location, n_passages, body): body is the root of a digest tree over a location's lines, by canonical order."""
    rows = digests.rolled(review_lines(passages, location), F.col("canonical_order"), F.coalesce("line", F.lit("")), ["location"])
    return rows.select("location", F.col("n").alias("n_passages"), F.col("digest").alias("body"))


def overlays(passages: DataFrame) -> DataFrame:
    """(reference, spans): the page spans of each passage."""
    return passages.select("reference", F.filter("source_spans", lambda s: s["kind"] == "pdf").alias("spans"))
