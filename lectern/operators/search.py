"""Full-text search: tokens, blocks of postings, phrases, boolean and proximity queries, BM25, the best hits.

A query compiles on the driver to a small table of pieces and their tokens (a
query has at most 512 characters); everything else is DataFrame operations that
touch only the lists of the query's tokens. Many queries run as one job: each
row of the table carries its query's id.

An index holds, for each term and each range of canonical orders, one block:
its documents with their sorted positions, and the greatest factor by which a
document in it can weigh the term. ``best`` bounds a range's scores by the
blocks of all terms there, scores the most promising ranges first, and then
reads only those whose bound reaches what the last of them got.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.errors import InvalidQueryError
from lectern.functions.text import plain_tokens, tokens

MODES = ("phrase", "terms", "prefix", "near")
#: BM25's parameters and the floor of its inverse document frequency; fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_CHARS = 512
DISTANCE = 5
#: Canonical orders that a block covers; ranges scored first, in growing batches; what sums in another order may differ by.
SPAN, BATCHES, SLACK = 256, (4, 64, 1024), 1e-9


@dataclass(frozen=True)
class Query:
    """A query as phrases of tokens; the last token of a phrase may be a prefix."""

    pieces: tuple[tuple[str, ...], ...]
    prefix: bool = False
    distance: int | None = None

    @property
    def empty(self) -> bool:
        """A query that matches nothing: no pieces, or one without a token where all must match."""
        return not self.pieces or not all(self.pieces)


def compiled(text: str, mode: str = "terms", distance: int | None = None) -> Query:
    text = text.strip()
    if not 1 <= len(text) <= MOST_CHARS:
        raise InvalidQueryError(f"a query has 1 to {MOST_CHARS} characters")
    if mode not in MODES:
        raise InvalidQueryError(f"unknown mode {mode}")
    if distance is not None and (mode != "near" or not 1 <= distance <= 20):
        raise InvalidQueryError("a distance of 1 to 20 goes with near only")
    if mode == "phrase":
        return Query((tuple(plain_tokens(text)),))
    pieces = tuple(tuple(plain_tokens(p)) for p in text.split())
    if mode == "near":
        return Query(tuple(p for p in pieces if p), distance=distance or DISTANCE)
    return Query(pieces, prefix=mode == "prefix")


def tokenized(units: DataFrame) -> DataFrame:
    """(doc, toks, dl): each unit's tokens under its canonical order."""
    return units.select(F.col("canonical_order").alias("doc"), tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks").cast("long"))


def statistics(tokenized_units: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl) over the whole corpus; filters of a search don't change it."""
    return tokenized_units.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def factor(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a document's frequency of a piece and its length make of the piece's weight."""
    return (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * dl / avgdl))


def lists(tokenized_units: DataFrame, wanted=None) -> DataFrame:
    """(term, doc, dl, pos): the sorted positions of each term of each unit; wanted, a condition on a term, chooses terms before any row is made."""
    toks = F.col("toks") if wanted is None else F.filter("toks", wanted)
    places = lambda t: F.filter(F.transform("toks", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    if wanted is not None:  # a few terms: each looks for its places
        return tokenized_units.select("doc", "dl", F.inline(F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("term"), places(t).alias("pos"))))).select("term", "doc", "dl", "pos")
    each = tokenized_units.select("doc", "dl", F.floor(F.col("doc") / SPAN).alias("block"), F.posexplode("toks").alias("p", "term"))
    return each.repartition("term", "block").groupBy("term", "block", "doc", "dl").agg(F.sort_array(F.collect_list("p")).alias("pos"))


def blocks(tokenized_units: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, block, n, best, docs): the index. A block has a term's n documents of SPAN canonical orders, sorted, and the greatest factor among them."""
    best = F.max(factor(F.size("pos").cast("double"), F.col("dl"), F.col("avgdl"))).alias("best")
    found = lists(tokenized_units).crossJoin(F.broadcast(stats.select("avgdl")))
    return found.groupBy("term", "block").agg(F.count("*").alias("n"), best, F.sort_array(F.collect_list(F.struct("doc", "dl", "pos"))).alias("docs"))


def _wanted(term: Column, queries: dict[int, Query]) -> Column:
    whole = {t for q in queries.values() for p in q.pieces for t in (p[:-1] if q.prefix else p)}
    begun = {p[-1] for q in queries.values() if q.prefix for p in q.pieces}
    found = term.isin(*sorted(whole)) if whole else F.lit(False)
    for prefix in sorted(begun):
        found = found | term.startswith(prefix)
    return found


def hits(source: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """Lists (term, doc, dl, pos) of the queries' tokens, from an index or straight from tokenized units."""
    if "toks" in source.columns:
        return lists(source, lambda t: _wanted(t, queries))
    return source.where(_wanted(F.col("term"), queries)).select("term", F.inline("docs"))


PIECES = T.StructType([T.StructField(n, k) for n, k in (("query_id", T.IntegerType()), ("piece", T.IntegerType()), ("idx", T.IntegerType()), ("token", T.StringType()), ("prefix", T.BooleanType()), ("len", T.IntegerType()))])


def _pieces(spark: SparkSession, queries: dict[int, Query]) -> DataFrame:
    rows = [(i, k, j, t, q.prefix and j == len(p) - 1, len(p)) for i, q in queries.items() for k, p in enumerate(q.pieces) for j, t in enumerate(p)]
    return F.broadcast(spark.createDataFrame(rows, PIECES))


def instances(source: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(query_id, piece, len, doc, dl, starts): where all tokens of a piece follow each other, a row for each piece and document."""
    same = F.col("term") == F.col("token")
    if any(q.prefix for q in queries.values()):
        same = F.when(F.col("prefix"), F.col("term").startswith(F.col("token"))).otherwise(same)
    met = hits(source, queries).join(_pieces(source.sparkSession, queries), same)
    key = ["query_id", "piece", "len", "doc", "dl"]
    if all(len(p) == 1 and not q.prefix for q in queries.values() for p in q.pieces):
        return met.select(*key, F.col("pos").alias("starts"))
    whole = met.groupBy(*key).agg(F.collect_list(F.struct("idx", "pos")).alias("x"))
    # A prefix has several terms' lists at its place.
    begun = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.flatten(F.transform(F.filter("x", lambda x: x["idx"] == i), lambda x: F.transform(x["pos"], lambda p: p - i))))
    starts = F.array_sort(F.aggregate(F.slice(begun, F.lit(2), F.col("len")), begun[0], F.array_intersect))
    return whole.select(*key, starts.alias("starts")).where(F.size("starts") > 0)


def _close(found: DataFrame, distances: DataFrame, pieces: int) -> DataFrame:
    """(query_id, piece, doc, dl, tf): instances that take part in a choice of one of each piece, none of which starts more than the distance after another's end.

    One sweep over a document's instances in order: a choice stands by its last
    start, so going up, each instance sees whether the latest of every other
    piece still reaches it; going down, each sees the next one that closes a choice.
    Distances: (query_id, distance, k), where k is the number of pieces, at most ``pieces``.
    """
    doc = ["query_id", "doc", "dl"]
    met = found.join(distances, "query_id").groupBy(*doc, "distance", "k").agg(F.collect_list(F.struct("piece", "len", "starts")).alias("x")).where(F.size("x") == F.col("k"))
    rows = met.select(*doc, "distance", "k", F.inline("x")).select(*doc, "distance", "k", "piece", "len", F.explode("starts").alias("start"))
    here = W.partitionBy(*doc)
    up, down = here.orderBy("start").rangeBetween(W.unboundedPreceding, 0), here.orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)
    end = F.col("start") + F.col("len") + F.col("distance")
    reached = [(F.col("k") <= q) | (F.col("piece") == q) | F.coalesce(F.max(F.when(F.col("piece") == q, end)).over(up) >= F.col("start"), F.lit(False)) for q in range(pieces)]
    rows = rows.withColumn("closes", reduce(and_, reached))
    follows = [(F.col("piece") != q) & F.coalesce(F.min(F.when(F.col("closes") & (F.col("piece") == q), F.col("start"))).over(down) <= end, F.lit(False)) for q in range(pieces)]
    return rows.withColumn("part", F.col("closes") | reduce(or_, follows)).where("part").groupBy(*doc, "piece").agg(F.count("*").alias("tf"))


def weight(df: Column, n_docs: Column) -> Column:
    """A piece's inverse document frequency."""
    idf = F.ln((n_docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)


def score(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column) -> Column:
    """A piece's part of BM25, negated: lower is better."""
    return -weight(df, n_docs) * factor(tf, dl, avgdl)


def _frequencies(source: DataFrame, queries: dict[int, Query], found: DataFrame) -> DataFrame:
    """(query_id, piece, df): documents of each piece; those of single terms are known from an index's blocks without their documents."""
    spark = source.sparkSession
    if "toks" in source.columns or any(q.prefix or any(len(p) > 1 for p in q.pieces) for q in queries.values()):
        return F.broadcast(found.groupBy("query_id", "piece").agg(F.count("*").alias("df")))
    known = {r.term: r.df for r in source.where(_wanted(F.col("term"), queries)).groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a token of the queries
    rows = [(i, k, known[p[0]]) for i, q in queries.items() for k, p in enumerate(q.pieces) if p[0] in known]
    return F.broadcast(spark.createDataFrame(rows, "query_id int, piece int, df long"))


def search_all(source: DataFrame, stats: DataFrame, queries: dict[int, Query], frequencies: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, raw_score) of all matches of all queries, unfiltered.

    Parts are added up in the order of the pieces, so equal documents get equal
    bits and ties go to the canonical order. Frequencies (query_id, piece, df)
    are those of the whole corpus, where source is a part of it.
    """
    spark = source.sparkSession
    live = {i: q for i, q in queries.items() if not q.empty}
    if not live:
        return spark.createDataFrame([], "query_id int, doc long, raw_score double")
    found = instances(source, live)
    near = {i: q for i, q in live.items() if q.distance is not None and len(q.pieces) > 1}
    freq = _frequencies(source, live, found) if frequencies is None else frequencies
    counted = found.select("query_id", "piece", "doc", "dl", F.size("starts").cast("long").alias("tf"))
    if near:
        table = F.broadcast(spark.createDataFrame([(i, q.distance, len(q.pieces)) for i, q in near.items()], "query_id int, distance int, k int"))
        close = _close(found, table, max(len(q.pieces) for q in near.values())).select(*counted.columns)
        counted = close if len(near) == len(live) else counted.join(table, "query_id", "left_anti").unionByName(close)
    sizes = F.broadcast(spark.createDataFrame([(i, len(q.pieces)) for i, q in live.items()], "query_id int, n_pieces int"))
    scored = counted.join(freq, ["query_id", "piece"]).crossJoin(F.broadcast(stats))
    scored = scored.withColumn("part", score(F.col("tf").cast("double"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl")))
    whole = scored.groupBy("query_id", "doc").agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    whole = whole.join(sizes, "query_id").where(F.size("parts") == F.col("n_pieces"))
    return whole.select("query_id", "doc", F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"]).alias("raw_score"))


@dataclass(frozen=True)
class Read:
    """How many blocks of a query's terms there are, and how many were read for its best hits."""

    blocks: int
    read: int


def best(index: DataFrame, stats: DataFrame, text: str, limit: int, keep=lambda found: found) -> tuple[DataFrame, Read]:
    """All-terms hits (doc, raw_score), of which the first limit + 1 of keep(hits) are surely there, and what was read for them.

    keep filters hits and may join them with units; it keeps raw_score. Ranges of orders in which all terms have blocks are scored
    in growing batches, best bound first, until limit + 1 hits are kept; what
    no remaining range can beat is then the answer. A score's last digits may
    differ from its bound's by the order of additions; SLACK makes up for it.
    Queries with phrases are bounded by nothing here and read all their blocks.
    """
    query = compiled(text)
    spark = index.sparkSession
    whole = {0: query}
    if query.empty:
        return spark.createDataFrame([], "doc long, raw_score double"), Read(0, 0)
    mine = index.where(_wanted(F.col("term"), whole))
    if any(len(p) > 1 for p in query.pieces):
        n = mine.count()
        return search_all(index, stats, whole).drop("query_id"), Read(n, n)
    frequencies = _frequencies(index, whole, mine)
    times = spark.createDataFrame([(p[0], k) for k, p in enumerate(query.pieces)], "term string, piece int")
    weights = F.broadcast(times.join(frequencies, "piece").crossJoin(F.broadcast(stats)).groupBy("term").agg(F.sum(weight(F.col("df"), F.col("n_docs"))).alias("w")))
    terms = len({p[0] for p in query.pieces})
    ranges = mine.select("term", "block", "best").join(weights, "term").groupBy("block").agg((-F.sum(F.col("w") * F.col("best"))).alias("bound"), F.count("*").alias("n")).where(F.col("n") == terms)
    total = mine.count()

    def scored(where: Column | DataFrame) -> DataFrame:
        part = index.where(where) if isinstance(where, Column) else index.join(where, "block", "left_semi")
        return search_all(part, stats, whole, frequencies).drop("query_id")

    done = 0
    for size in BATCHES:
        first = ranges.orderBy("bound", "block").limit(size + 1).collect()
        if len(first) <= size:  # these are all
            return scored(F.col("block").isin([r.block for r in first]) if first else F.lit(False)), Read(total, terms * len(first))
        kept = keep(scored(F.col("block").isin([r.block for r in first[:size]]))).select("raw_score").orderBy("raw_score").limit(limit + 1).collect()
        done = size
        if len(kept) > limit:
            last = kept[-1].raw_score + SLACK
            if first[size].bound > last:
                return scored(F.col("block").isin([r.block for r in first[:size]])), Read(total, terms * done)
            left = ranges.where(F.col("bound") <= last)
            n = left.count()
            if n <= BATCHES[-1]:
                return scored(F.col("block").isin([r.block for r in left.select("block").collect()])), Read(total, terms * n)
            return scored(left.select("block")), Read(total, terms * n)
    n = ranges.count()
    return scored(ranges.select("block")), Read(total, terms * n)


def search(source: DataFrame, stats: DataFrame, text: str, mode: str = "terms", distance: int | None = None) -> DataFrame:
    """(doc, raw_score) of one query's matches."""
    return search_all(source, stats, {0: compiled(text, mode, distance)}).drop("query_id")


def with_units(found: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with their units."""
    return found.join(units, found.doc == units.canonical_order).drop("doc")


def in_books(hits_: DataFrame, books: list[str]) -> DataFrame:
    return hits_.where(F.col("book").isin(*books))


def range_bounds(units: DataFrame, ranges: list[tuple[str, str]]) -> DataFrame:
    """(lo, hi): canonical orders of the ends of reference ranges; at most as many rows as ranges."""
    ends = {r for pair in ranges for r in pair}
    orders = units.where(F.col("reference").isin(*ends)).select("reference", "canonical_order")
    wanted = units.sparkSession.createDataFrame(ranges, "lo_reference string, hi_reference string")
    lo = orders.select(F.col("reference").alias("lo_reference"), F.col("canonical_order").alias("lo"))
    hi = orders.select(F.col("reference").alias("hi_reference"), F.col("canonical_order").alias("hi"))
    return wanted.join(lo, "lo_reference", "left").join(hi, "hi_reference", "left").select("lo_reference", "hi_reference", "lo", "hi")


def in_ranges(hits_: DataFrame, bounds: DataFrame) -> DataFrame:
    """Hits within any of the ranges (a request has a few)."""
    b = F.broadcast(bounds.select("lo", "hi"))
    return hits_.join(b, F.col("canonical_order").between(F.col("lo"), F.col("hi")), "left_semi")


def after(hits_: DataFrame, raw_score: float, canonical_order: int) -> DataFrame:
    """Hits behind a position of the order (raw_score, canonical_order)."""
    s, o = F.col("raw_score"), F.col("canonical_order")
    return hits_.where((s > raw_score) | ((s == raw_score) & (o > canonical_order)))


def top(hits_: DataFrame, limit: int) -> DataFrame:
    """The first hits in order, and one more that tells whether others follow."""
    return hits_.orderBy("raw_score", "canonical_order").limit(limit + 1)
