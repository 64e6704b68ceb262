"""Canonical references, work/book/chapter/verse[-end], and lists of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Books of the two works that a corpus can hold; fixed values.
BOOKS = {
    "bofm": ("1-ne", "2-ne", "jacob", "enos", "jarom", "omni", "w-of-m", "mosiah", "alma", "hel", "3-ne", "4-ne", "morm", "ether", "moro"),
    "nt": ("matt", "mark", "luke", "john", "acts", "rom", "1-cor", "2-cor", "gal", "eph", "philip", "col", "1-thes", "2-thes", "1-tim", "2-tim", "titus", "philem", "heb", "james", "1-pet", "2-pet", "1-jn", "2-jn", "3-jn", "jude", "rev"),
}
#: Works that a target may name without being in the corpus.
EXTERNAL_WORKS = ("bible", "dc", "pgp")
GRAMMAR = "official-reference-v1"
TARGET = r"^([a-z][a-z0-9-]*)/([a-z0-9-]+)/([1-9][0-9]*)/([1-9][0-9]*)(?:-([1-9][0-9]*))?$"
#: What makes a list of references ambiguous.
AMBIGUOUS = r"(?iU),|\s+(?:and|or)\s+"


def parsed(reference: Column) -> Column:
    """struct(work, book, chapter, verse, end_verse), null for a malformed reference."""
    part = lambda k: F.regexp_extract(reference, TARGET, k)
    number = lambda k: F.expr("null").cast("long") if k is None else F.nullif(part(k), F.lit("")).try_cast("long")
    return F.when(reference.rlike(TARGET), F.struct(part(1).alias("work"), part(2).alias("book"), number(3).alias("chapter"), number(4).alias("verse"), number(5).alias("end_verse")))


def rendered(work: Column, book: Column, chapter: Column, verse: Column, end_verse: Column) -> Column:
    """The key of a target."""
    return F.concat(F.concat_ws("/", work, book, chapter, verse), F.when(end_verse.isNotNull(), F.concat(F.lit("-"), end_verse)).otherwise(""))


def target_key(target: Column) -> Column:
    return rendered(*(target[f] for f in ("work", "book", "chapter", "verse", "end_verse")))


def verses(target: Column) -> Column:
    """All single verses of a target, in order."""
    end = F.coalesce(target["end_verse"], target["verse"])
    each = F.when(end >= target["verse"], F.sequence(target["verse"], end)).otherwise(F.array().cast("array<long>"))
    return F.transform(each, lambda v: F.concat_ws("/", target["work"], target["book"], target["chapter"], v))


def in_corpus_grammar(reference: Column, works: Iterable[str] = ("bofm",)) -> Column:
    """Whether a reference names a known book of the works, and its range does not run backwards."""
    t = parsed(reference)
    known = F.lit(False)
    for work in works:
        known = known | ((t["work"] == work) & t["book"].isin(*BOOKS[work]))
    return F.coalesce(t.isNotNull() & known & (F.coalesce(t["end_verse"], t["verse"]) >= t["verse"]), F.lit(False))
