"""Merkle fingerprints of documents. Native expressions only.

A text is cut, without loss, into sections (up to an empty line), these into
paragraphs (lines) and these into pieces (sentences, of at most 128 code
points). A piece is hashed, a paragraph hashes its pieces' hashes, a section its
paragraphs', and the root its sections'. The fingerprint is the whole tree: the
root, then each section's short hash and its paragraphs, each with its short hash
and its pieces'. Equal roots mean equal texts.

Two trees are compared from the top: at each level equal branches at both ends
are left, and only what lies between them is opened, so that the paragraphs
reached in the end locate the edit. The likeness is the share of pieces in equal
branches; of pieces in between, which may have moved, each different one that both
sides have counts once.

Edge cases: a null text is an empty one, with no pieces; the next document of
the last one in order is the first; rows under one id follow each other by a
hash of their text; null ids come last; equal rows are neighbours, in any order;
a single document is its own next; a very long text is one row in one task, with
a fingerprint about a tenth as long; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import NULL_ID, bind, partitions, place, row_hash

ROOT = 32
SHORT = 12
SECTION = r"(?s).*?(?:\n\n+|\z)"
PARAGRAPH = r"[^\n]*(?:\n+|\z)"
PIECE = r"[^.!?\n]{0,127}(?:[^.!?\n]|[.!?\n]|\z)"


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, null as empty: root:section;section, a section as hash=paragraph,paragraph, a paragraph as hash.pieces."""
    hashed = lambda hashes: F.sha2(F.array_join(hashes, ""), 256)
    short = lambda h: F.left(h, F.lit(SHORT))
    named = lambda h, sign, s: bind(h, lambda x: F.struct(x.alias("h"), F.concat(short(x), F.lit(sign), s).alias("s")))
    over = lambda nodes: hashed(F.transform(nodes, lambda n: n["h"]))
    strings = lambda nodes, sign: F.array_join(F.transform(nodes, lambda n: n["s"]), sign)
    pieces = lambda p: F.transform(_cut(p, PIECE), lambda x: F.sha2(x, 256))
    paragraph = lambda p: bind(pieces(p), lambda h: named(hashed(h), ".", F.array_join(F.transform(h, short), "")))
    section = lambda s: bind(F.transform(_cut(s, PARAGRAPH), paragraph), lambda n: named(over(n), "=", strings(n, ",")))
    whole = lambda n: F.concat(F.left(over(n), F.lit(ROOT)), F.lit(":"), strings(n, ";"))
    return bind(F.transform(_cut(F.coalesce(text, F.lit("")), SECTION), section), whole)


def root(fp: Column) -> Column:
    """The root of a fingerprint, which tests equality."""
    return F.left(fp, F.lit(ROOT))


def n_pieces(fp: Column) -> Column:
    """Number of pieces: of all short hashes, those that are no section's or paragraph's."""
    body = F.substring(fp, ROOT + 2, 2**31 - 1)
    inner = F.length(body) - F.length(F.translate(body, "=.", ""))
    return (F.length(F.translate(body, ";=,.", "")) / SHORT).cast("int") - inner


def _between(pair: Column, key) -> Column:
    """Of struct(a, b), two arrays, what lies between their equal ends, and the length of the equal head."""
    unlike = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(key(x) != key(y), F.lit(True))), F.lit(True)).cast("int")
    same = lambda a, b, then: bind(unlike(a, b), lambda at: bind(F.when(at == 0, F.size(a)).otherwise(at - 1), then))
    rest = lambda c, n: F.slice(c, n + 1, F.size(c) - n)
    most = lambda c, n: F.slice(c, F.lit(1), F.size(c) - n)
    headless = same(pair["a"], pair["b"], lambda n: F.struct(rest(pair["a"], n).alias("a"), rest(pair["b"], n).alias("b"), n.alias("head")))
    return bind(headless, lambda p: same(F.reverse(p["a"]), F.reverse(p["b"]), lambda n: F.struct(most(p["a"], n).alias("a"), most(p["b"], n).alias("b"), p["head"].alias("head"))))


def descended(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: struct(likeness, section, paragraphs, n_a, n_b).

    section: number of the first section that differs; paragraphs: number of
    equal paragraphs before the edit within the sections that differ; n_a, n_b:
    paragraphs of a and b that differ; all 0 for equal roots.
    """
    both = lambda x, f: F.struct(f(x["a"]).alias("a"), f(x["b"]).alias("b"))
    name = lambda node: F.left(node, F.lit(SHORT))
    children = lambda nodes, sign: F.flatten(F.transform(nodes, lambda n: F.split(F.substring(n, SHORT + 2, 2**31 - 1), sign)))
    pieces = lambda nodes: F.flatten(F.transform(nodes, lambda n: F.regexp_extract_all(F.substring(n, SHORT + 2, 2**31 - 1), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0))))
    sections = lambda fp: F.filter(F.split(F.substring(fp, ROOT + 2, 2**31 - 1), ";"), lambda x: x != "")

    def leaves(s: Column, p: Column) -> Column:
        total = n_pieces(a) + n_pieces(b)
        share = lambda x: F.when(total == 0, F.lit(0.0)).otherwise(2.0 * (n_pieces(a) - F.size(x["a"]) + F.size(F.array_intersect(x["a"], x["b"]))) / total)
        return bind(_between(both(p, pieces), lambda x: x), lambda x: F.struct(share(x).alias("likeness"), s["head"].alias("section"), p["head"].alias("paragraphs"), F.size(p["a"]).alias("n_a"), F.size(p["b"]).alias("n_b")))

    opened = bind(_between(F.struct(sections(a).alias("a"), sections(b).alias("b")), name), lambda s: bind(_between(both(s, lambda x: children(x, ",")), name), lambda p: leaves(s, p)))
    zero = F.lit(0)
    return F.when(root(a) == root(b), F.struct(F.lit(1.0).alias("likeness"), zero.alias("section"), zero.alias("paragraphs"), zero.alias("n_a"), zero.alias("n_b"))).otherwise(opened)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), _lt_fp of it, and those of the next document, descending doc_id.

    Documents are dealt into ranges of ids; the first document of each range
    also goes, as a guest, to the range before it, so that a window within each
    range sees every successor and no text moves twice.
    """
    n = 8 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_lt_text", row_hash(F.col("text")))
    at = F.coalesce("doc_id", F.lit(NULL_ID))
    cuts = rows.agg(F.percentile_approx(at, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(20 * n))).first()[0] if n > 1 else []
    # An id that fills several ranges is cut by the hashes of its texts, which are spread evenly.
    bounds = [(v, -(2**63) + (2**64 * j) // times) for v, times in sorted(Counter(cuts or []).items()) for j in range(times)]
    point = lambda v, h: F.struct(v.alias("v"), h.alias("h"))
    bound = F.array(*[point(F.lit(v).cast("long"), F.lit(h).cast("long")) for v, h in bounds])
    rows = rows.withColumn("_lt_range", place(point(at, F.col("_lt_text")), bound, len(bounds)) if bounds else F.lit(0).cast("long"))
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("_lt_text").alias("c"))
    first = rows.groupBy("_lt_range").agg(F.max(key).alias("_lt_first"))
    falling = W.orderBy(F.desc("_lt_range"))  # a row a range
    everything = falling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = first.withColumn("_lt_to", F.coalesce(F.lag("_lt_range").over(falling), F.last("_lt_range").over(everything)))
    rows = rows.join(F.broadcast(first), "_lt_range")
    stays, visits = F.struct(F.col("_lt_range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_lt_to").alias("r"), F.lit(1).alias("g"))
    rows = rows.withColumn("_lt_at", F.explode(F.when(key == F.col("_lt_first"), F.array(stays, visits)).otherwise(F.array(stays))))
    rows = rows.select("doc_id", "text", "_lt_text", F.col("_lt_at.r").alias("_lt_range"), F.col("_lt_at.g").alias("_lt_guest"))
    rows = rows.repartition(partitions(docs.sparkSession), "_lt_range").withColumn("_lt_fp", fingerprint(F.col("text")))
    order = W.partitionBy("_lt_range").orderBy("_lt_guest", F.desc_nulls_last("doc_id"), F.desc("_lt_text"))
    rows = rows.withColumn("_lt_next", F.lead("text").over(order)).withColumn("_lt_next_fp", F.lead("_lt_fp").over(order))
    return rows.filter("_lt_guest = 0").drop("_lt_range", "_lt_guest", "_lt_text")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint held against that of its edited text and of the next document.

    The edited text has the last third of its code points replaced by the first
    as many of the next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("_lt_next", third)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("_lt_fp").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "_lt_next_fp")
    rows = rows.withColumn("_lt_e", descended(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("_lt_n", descended(F.col("fingerprint"), F.col("_lt_next_fp")))
    edit = {"near_edited": "_lt_e.likeness", "near_next": "_lt_n.likeness", "edited_section": "_lt_e.section", "edited_paragraph": "_lt_e.paragraphs", "n_edited": "_lt_e.n_b"}
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *(F.col(c).alias(n) for n, c in edit.items()))
