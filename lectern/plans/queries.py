"""Every operator as a query over the driver's tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import references as R
from lectern.functions import text as X
from lectern.operators import digests as D
from lectern.operators import evaluate as E
from lectern.operators import graph as G
from lectern.operators import ingest as I
from lectern.operators import layout as L
from lectern.operators import lookup as K
from lectern.operators import search as S
from lectern.operators import validate as V
from lectern.operators.digests import FAN
from lectern.plans import tables as T
from lectern.shared import kept
from lectern.sources.markup import PROFILE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UNITS = """u0 AS (SELECT doc_id, text, lang AS book, CAST(substr(source, 4) AS INT) + 1 AS chapter FROM documents),
u1 AS (SELECT *, row_number() OVER (PARTITION BY book, chapter ORDER BY doc_id) AS verse, row_number() OVER (ORDER BY book, chapter, doc_id) - 1 AS canonical_order FROM u0),
units AS (SELECT *, 'doc/' || book || '/' || chapter || '/' || verse AS reference FROM u1)"""
POSTINGS = UNITS + r""",
toks AS (SELECT canonical_order AS doc, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM units),
post AS (SELECT doc, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks)"""

# Units, lookups, context


@query(f"WITH {UNITS} SELECT reference, canonical_order, book, chapter, verse, sha256(text) AS content_hash FROM units")
def scan_units(spark: SparkSession, sf: str) -> DataFrame:
    return T.hashed_units(spark, sf).select("reference", "canonical_order", "book", "chapter", "verse", "content_hash")


@query(f"WITH {UNITS} SELECT reference, canonical_order, text FROM units WHERE reference = 'doc/en/3/2'")
def get_passage(spark, sf):
    return K.get_passage(T.units(spark, sf), "doc/en/3/2").select("reference", "canonical_order", "text")


@query(f"WITH {UNITS} SELECT reference, canonical_order, text FROM units WHERE canonical_order = 77")
def get_passage_by_id(spark, sf):
    return K.get_passage_by_id(T.units(spark, sf), 77).select("reference", "canonical_order", "text")


@query(f"WITH {UNITS} SELECT canonical_order, reference FROM units WHERE canonical_order BETWEEN 2 AND 8 AND canonical_order <> 5")
def get_context(spark, sf):
    return K.get_context(T.units(spark, sf), 5, 3, 3).select("canonical_order", "reference")


@query(f"""WITH {UNITS} SELECT a.canonical_order, b.canonical_order AS context_order, b.reference FROM units a JOIN units b
ON b.canonical_order BETWEEN a.canonical_order - 2 AND a.canonical_order + 1 AND b.canonical_order <> a.canonical_order""")
def get_context_batch(spark, sf):
    units = T.units(spark, sf)
    return K.get_context_batch(units, units, 2, 1)


@query("SELECT count(*) AS n FROM documents")
def passage_count(spark, sf):
    return T.table(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return I.with_hash(T.table(spark, sf, "documents")).select("doc_id", "content_hash")


@query(r"SELECT turn, conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def normalize_ws(spark, sf):
    return T.table(spark, sf, "conversations").select("turn", "conv_id", X.collapse(F.col("text")).alias("text"))


@query(r"""SELECT item_id, len(regexp_split_to_array(text, ' ')) AS n_words, position('the' IN text) AS first_the, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]+', '', 'g') AS heading,
rtrim(replace(replace(base64(encode(text)), '+', '-'), '/', '_'), '=') AS url64, substr(text, 1, 20) AS head, split_part(text, ' ', -1) AS last_word FROM benchmark""")
def scalar_functions(spark, sf):
    t = F.col("text")
    return T.table(spark, sf, "benchmark").select(
        "item_id", F.size(F.split(t, " ")).cast("long").alias("n_words"), F.instr(t, "the").cast("long").alias("first_the"), X.heading_key(t).alias("heading"),
        X.base64url(F.encode(t, "UTF-8")).alias("url64"), F.substring(t, 1, 20).alias("head"), F.element_at(F.split(t, " "), -1).alias("last_word"),
    )


# Index and search


@query(f"WITH {POSTINGS} SELECT DISTINCT term FROM post")
def index_vocab(spark, sf):
    return T.index(spark, sf)["blocks"].select("term").distinct()


@query(f"WITH {POSTINGS} SELECT term, count(DISTINCT doc) AS df, count(*) AS cf, max(n_docs) AS n_docs, round(max(avgdl), 9) AS avgdl FROM post, stats GROUP BY term")
def bm25_stats(spark, sf):
    index = T.index(spark, sf)
    cf = F.aggregate("docs", F.lit(0).cast("long"), lambda acc, d: acc + F.size(d["pos"]))
    return index["blocks"].groupBy("term").agg(F.sum("n").alias("df"), F.sum(cf).alias("cf")).crossJoin(F.broadcast(index["stats"])).withColumn("avgdl", F.round("avgdl", 9))


def _sql_search(pieces: list[list[str]], prefix: bool = False, distance: int | None = None) -> str:
    """CTEs up to hits(doc, raw_score) for literal pieces."""
    parts = []
    for k, piece in enumerate(pieces):
        on = " ".join(f"JOIN post p{i} ON p{i}.doc = p0.doc AND p{i}.pos = p0.pos + {i}" for i in range(1, len(piece)))
        last = len(piece) - 1
        where = " AND ".join(f"starts_with(p{i}.term, '{t}')" if prefix and i == last else f"p{i}.term = '{t}'" for i, t in enumerate(piece))
        parts.append(f"SELECT {k} AS piece, {len(piece)} AS l, p0.doc, p0.dl, p0.pos AS s FROM post p0 {on} WHERE {where}")
    near = ""
    if distance is not None:  # two pieces
        near = f" WHERE EXISTS (SELECT 1 FROM inst b WHERE b.doc = a.doc AND b.piece <> a.piece AND b.s <= a.s + a.l + {distance} AND a.s <= b.s + b.l + {distance})"
    return f"""{POSTINGS}, inst AS ({" UNION ALL ".join(parts)}),
dfs AS (SELECT piece, count(DISTINCT doc) AS df FROM inst GROUP BY piece),
tfs AS (SELECT piece, doc, dl, count(*) AS tf FROM inst a{near} GROUP BY piece, doc, dl),
sc AS (SELECT doc, piece, -(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tfs JOIN dfs USING (piece), stats),
hits AS (SELECT doc, sum(part ORDER BY piece) AS raw_score FROM sc GROUP BY doc HAVING count(*) = {len(pieces)})"""


def _hits(spark, sf, text, mode="terms", distance=None):
    index = T.index(spark, sf)
    return S.with_units(S.search(index["blocks"], index["stats"], text, mode, distance), index["units"].select("canonical_order", "reference", "book"))


def _best(spark, sf, text, limit, keep=lambda hits: hits):
    """The best hits of a query, scores rounded as their order is; only blocks that can reach them are read."""
    index = T.index(spark, sf)
    at = lambda hits: keep(hits.select(F.col("doc").alias("canonical_order"), F.round("raw_score", 12).alias("raw_score")))
    return S.top(at(S.best(index["blocks"], index["stats"], text, limit, at)[0]), limit)


def _rounded(found):
    return found.select("reference", "canonical_order", F.round("raw_score", 9).alias("raw_score"))


_HITS = "SELECT reference, canonical_order, round(raw_score, 9) AS raw_score FROM hits JOIN units ON doc = canonical_order"


@query(f"WITH {_sql_search([['erin'], ['thing']])} {_HITS}")
def search_terms(spark, sf):
    return _rounded(_hits(spark, sf, "erin thing"))


@query(f"WITH {_sql_search([['of', 'the']])} {_HITS}")
def search_phrase(spark, sf):
    return _rounded(_hits(spark, sf, "Of THE", "phrase"))


@query(f"WITH {_sql_search([['erin'], ['thi']], prefix=True)} {_HITS}")
def search_prefix(spark, sf):
    return _rounded(_hits(spark, sf, "erin thi", "prefix"))


@query(f"WITH {_sql_search([['erin'], ['thing']], distance=5)} {_HITS}")
def search_near(spark, sf):
    return _rounded(_hits(spark, sf, "erin thing", "near", 5))


@query(f"WITH {_sql_search([['le'], ['que']])} {_HITS} WHERE book IN ('fr', 'es')")
def search_filter_books(spark, sf):
    return _rounded(S.in_books(_hits(spark, sf, "le que"), ["fr", "es"]))


_RANGES = [("doc/en/1/1", "doc/en/3/2"), ("doc/fr/2/1", "doc/fr/5/1"), ("doc/en/2/1", "doc/en/2/3")]


@query(f"""WITH {UNITS}, r AS (SELECT unnest(['{"','".join(a for a, _ in _RANGES)}']) AS lo_reference, unnest(['{"','".join(b for _, b in _RANGES)}']) AS hi_reference)
SELECT lo_reference, hi_reference, a.canonical_order AS lo, b.canonical_order AS hi FROM r LEFT JOIN units a ON a.reference = lo_reference LEFT JOIN units b ON b.reference = hi_reference""")
def range_bounds(spark, sf):
    return S.range_bounds(T.units(spark, sf), _RANGES)


@query(f"""WITH {_sql_search([["the"], ["of"]])}, r AS (SELECT unnest(['{"','".join(a for a, _ in _RANGES)}']) AS x, unnest(['{"','".join(b for _, b in _RANGES)}']) AS y)
{_HITS} WHERE EXISTS (SELECT 1 FROM r JOIN units a ON a.reference = x JOIN units b ON b.reference = y WHERE units.canonical_order BETWEEN a.canonical_order AND b.canonical_order)""")
def search_filter_ranges(spark, sf):
    return _rounded(S.in_ranges(_hits(spark, sf, "the of"), S.range_bounds(T.units(spark, sf), _RANGES)))


_TOP = "SELECT reference, canonical_order, round(raw_score, 9) AS raw_score, row_number() OVER (ORDER BY round(raw_score, 12), canonical_order) AS rank FROM hits JOIN units ON doc = canonical_order"


@query(f"WITH {_sql_search([['the'], ['thing']])} SELECT * FROM ({_TOP}) WHERE rank <= 21")
def search_topk(spark, sf):
    return _placed(spark, sf, _best(spark, sf, "the thing", 20))


def _placed(spark, sf, top, before=0):
    """Top hits with their references and ranks."""
    units = T.index(spark, sf)["units"].select("canonical_order", "reference")
    rank = F.row_number().over(W.orderBy("raw_score", "canonical_order")).cast("long") + before
    return _rounded(top.join(units, "canonical_order")).withColumn("rank", rank)


@query(f"WITH {_sql_search([['the'], ['thing']])}, t AS ({_TOP}) SELECT * FROM t WHERE rank BETWEEN 11 AND 21")
def search_keyset_page(spark, sf):
    last = _best(spark, sf, "the thing", 9).collect()
    if not last:
        return _placed(spark, sf, _best(spark, sf, "the thing", 10))
    return _placed(spark, sf, _best(spark, sf, "the thing", 10, lambda hits: S.after(hits, last[-1].raw_score, last[-1].canonical_order)), 10)


# References, lists of them, edges

#: Lines of orders, one for each key.
LI = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

_LISTS = LI + """, lists AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 9
WHEN 0 THEN a || '; ' || b WHEN 1 THEN a || ', ' || b WHEN 2 THEN a || ' and ' || b WHEN 3 THEN a || ';' || a WHEN 4 THEN '  ' || b || ' ; ' || a || '.  '
WHEN 5 THEN a || '-1' WHEN 6 THEN a || ' trailing' WHEN 7 THEN a || ';;' || b ELSE a END AS list FROM (SELECT *,
'bofm/1-ne/' || (l_partkey % 45 + 1) || '/' || (l_suppkey % 9 + 1) AS a, CASE WHEN l_linenumber % 2 = 0 THEN 'bible/john/3/' ELSE 'bofm/1-ne/2/' END || (l_partkey % 8 + 1) AS b FROM li))"""


def _lists(spark, sf):
    line = T.lines(spark, sf)
    a = F.concat(F.lit("bofm/1-ne/"), F.col("l_partkey") % 45 + 1, F.lit("/"), F.col("l_suppkey") % 9 + 1)
    b = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "bible/john/3/").otherwise("bofm/1-ne/2/"), F.col("l_partkey") % 8 + 1)
    forms = [F.concat(a, F.lit("; "), b), F.concat(a, F.lit(", "), b), F.concat(a, F.lit(" and "), b), F.concat(a, F.lit(";"), a), F.concat(F.lit("  "), b, F.lit(" ; "), a, F.lit(".  ")), F.concat(a, F.lit("-1")), F.concat(a, F.lit(" trailing")), F.concat(a, F.lit(";;"), b)]
    made = a  # a row's own form alone is made
    for k, form in reversed(list(enumerate(forms))):
        made = F.when(F.col("l_suppkey") % 9 == k, form).otherwise(made)
    return line.select("l_orderkey", "l_linenumber", made.alias("list"))


_PARSED = rf"""{_LISTS}, c AS (SELECT *, CASE WHEN ends_with(trim(list), '.') THEN rtrim(left(trim(list), -1)) ELSE trim(list) END AS c FROM lists),
m AS (SELECT l_orderkey, l_linenumber, unnest(list_transform(string_split(c, ';'), lambda x: trim(x))) AS member, unnest(range(len(string_split(c, ';')))) AS k FROM c),
t AS (SELECT *, regexp_full_match(member, '[a-z][a-z0-9-]*/[a-z0-9-]+/[1-9][0-9]*/[1-9][0-9]*(?:-[1-9][0-9]*)?') AS ok, split_part(member, '/', 1) AS work, TRY_CAST(split_part(member, '/', 3) AS BIGINT) AS chapter,
TRY_CAST(split_part(split_part(member, '/', 4), '-', 1) AS BIGINT) AS verse, TRY_CAST(nullif(split_part(split_part(member, '/', 4), '-', 2), '') AS BIGINT) AS e FROM m),
p AS (SELECT *, CASE WHEN NOT ok OR work NOT IN ('bofm', 'bible', 'dc', 'pgp') THEN 'official_reference_unsupported_syntax'
WHEN coalesce(e, verse) < verse OR (work = 'bofm' AND (split_part(member, '/', 2) <> '1-ne' OR chapter > 40 OR coalesce(e, verse) > 8)) THEN 'official_reference_invalid_canonical_target'
WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber, member ORDER BY k) > 1 THEN 'official_reference_duplicate_target' END AS problem FROM t),
g AS (SELECT l_orderkey, l_linenumber, arg_min(problem, k) FILTER (problem IS NOT NULL) AS problem, bool_or(work IN ('bible', 'dc', 'pgp')) AS ext, string_agg(member, '; ' ORDER BY k) AS norm, count(*) AS n, bool_or(member = '') AS hole FROM p GROUP BY ALL),
codes AS (SELECT l_orderkey, l_linenumber, list, norm, n, CASE WHEN c = '' THEN 'official_reference_unsupported_syntax' WHEN regexp_matches(c, '(?i),|\s+(?:and|or)\s+') THEN 'official_reference_ambiguous_syntax'
WHEN hole THEN 'official_reference_unsupported_syntax' WHEN problem IS NOT NULL THEN problem WHEN ext THEN 'official_reference_unresolved_external_target' ELSE 'official_reference_parsed' END AS code FROM c JOIN g USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, list, code, CASE code WHEN 'official_reference_parsed' THEN 'parsed' WHEN 'official_reference_unresolved_external_target' THEN 'unresolved_external' WHEN 'official_reference_unsupported_syntax' THEN 'unsupported'
WHEN 'official_reference_ambiguous_syntax' THEN 'ambiguous' ELSE 'invalid' END AS state, CASE WHEN code IN ('official_reference_parsed', 'official_reference_unresolved_external_target') THEN norm END AS normalized_text,
CASE WHEN code IN ('official_reference_parsed', 'official_reference_unresolved_external_target') THEN n ELSE 0 END AS n_targets FROM codes"""


@query(f"WITH {_PARSED}")
def grammar_parse(spark, sf):
    return I.grammar_parse(_lists(spark, sf), "list", T.nodes(spark))


@query(f"WITH {_PARSED} WHERE code IN ('official_reference_parsed', 'official_reference_unresolved_external_target')")
def grammar_strict(spark, sf):
    lists = _lists(spark, sf)
    good = I.grammar_parse(lists, "list", T.nodes(spark)).where("n_targets > 0").select(*lists.columns)
    return I.grammar_strict(good, "list", T.nodes(spark))


@query(f"""WITH {_LISTS} SELECT l_orderkey, l_linenumber, CAST(unnest(range(len(string_split(list, ';')))) AS INT) AS member_ord, unnest(list_transform(string_split(list, ';'), lambda x: trim(x))) AS member FROM lists""")
def edge_expand(spark, sf):
    return I.edge_expand(_lists(spark, sf).withColumnRenamed("list", "target")).select("l_orderkey", "l_linenumber", "member_ord", "member")


EDGES = LI + """,
edges AS (SELECT printf('e%09d-%d', l_orderkey, l_linenumber) AS edge_id, 'bofm/1-ne/' || (l_orderkey % 40 + 1) || '/' || (l_partkey % 7 + 1) AS origin_reference, l_suppkey % 11 = 0 AS ext,
l_partkey % 40 + 1 AS chapter, l_suppkey % 7 + 1 AS verse, CASE WHEN l_linenumber = 2 THEN l_suppkey % 7 + 2 END AS end_verse FROM li),
nodes AS (SELECT 'bofm/1-ne/' || (i // 8 + 1) || '/' || (i % 8 + 1) AS reference, i AS canonical_order FROM range(320) r(i)),
keyed AS (SELECT *, CASE WHEN ext THEN 'bible/john/' ELSE 'bofm/1-ne/' END || chapter || '/' || verse || CASE WHEN end_verse IS NULL THEN '' ELSE '-' || end_verse END AS target_key FROM edges),
ordered AS (SELECT e.*, n.canonical_order AS origin_order FROM keyed e JOIN nodes n ON n.reference = origin_reference),
adj AS (SELECT edge_id, origin_order, origin_reference AS src, CASE WHEN NOT ext THEN 'bofm/1-ne/' || chapter || '/' || unnest(range(verse, coalesce(end_verse, verse) + 1)) END AS dst, unnest(range(coalesce(end_verse, verse) - verse + 1)) AS tgt_ord, NULL AS external_key FROM ordered WHERE NOT ext
UNION ALL SELECT edge_id, origin_order, origin_reference, NULL, 0, target_key FROM ordered WHERE ext)"""


@query(f"WITH {EDGES} SELECT edge_id, target_key FROM keyed")
def target_key(spark, sf):
    return T.edges(spark, sf).select("edge_id", R.target_key(F.col("target")).alias("target_key"))


@query(f"WITH {EDGES} SELECT edge_id, left(sha256(origin_reference || chr(31) || 'a' || chr(31) || target_key || chr(31) || 'official-footnote' || chr(31) || 'official-reference-v1' || chr(31) || '[]'), 32) AS stable_id FROM keyed")
def stable_edge_id(spark, sf):
    rows = T.edges(spark, sf).withColumnRenamed("edge_id", "line_id").withColumns({"origin_anchor": F.lit("a"), "source_attribution": F.lit("official-footnote"), "spans_json": F.lit("[]")})
    return I.edge_ids(rows).select(F.col("line_id").alias("edge_id"), F.col("edge_id").alias("stable_id"))


@query(f"WITH {EDGES} SELECT edge_id, origin_reference, origin_order, target_key FROM ordered")
def all_edges(spark, sf):
    return G.ordered_edges(T.edges(spark, sf), T.nodes(spark)).select("edge_id", "origin_reference", "origin_order", R.target_key(F.col("target")).alias("target_key"))


@query(f"WITH {EDGES}, notes AS (SELECT o_orderkey AS note_id, 'bofm/1-ne/' || (o_custkey % 45 + 1) || '/' || (o_orderkey % 9 + 1) AS origin_reference FROM orders) SELECT note_id, origin_reference, canonical_order FROM notes JOIN nodes ON reference = origin_reference")
def all_notes(spark, sf):
    return K.with_origins(_notes(spark, sf), T.nodes(spark)).select("note_id", "origin_reference", "canonical_order")


def _notes(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("bofm/1-ne/"), F.col("o_custkey") % 45 + 1, F.lit("/"), F.col("o_orderkey") % 9 + 1).alias("origin_reference"), F.array(F.lit("s")).alias("source_spans"))


# Traversal

_ORIGIN = "bofm/1-ne/1/3"


def _adjacent(spark, sf):
    return G.adjacency(G.ordered_edges(T.edges(spark, sf), T.nodes(spark)))


def _sql_reach(depth: int, out: bool, back: bool) -> str:
    pairs = " UNION ALL ".join(x for x, on in (("SELECT src AS a, dst AS b, edge_id, external_key FROM adj", out), ("SELECT dst AS a, src AS b, edge_id, NULL AS external_key FROM adj WHERE dst IS NOT NULL", back)) if on)
    return f"""{EDGES}, pairs AS ({pairs}), reach AS (SELECT node, min(depth) AS depth FROM (WITH RECURSIVE r(node, depth) AS (SELECT '{_ORIGIN}', 0 UNION SELECT b, depth + 1 FROM r JOIN pairs ON a = node WHERE depth < {depth} AND b IS NOT NULL) SELECT * FROM r) GROUP BY node)"""


def _nodes_of(spark, sf, direction, depth):
    seeds = spark.createDataFrame([(0, _ORIGIN)], "seed int, node string")
    return G.expanded(_adjacent(spark, sf), seeds, direction, depth)


@query(f"WITH {_sql_reach(2, True, False)} SELECT node, depth FROM reach")
def traverse_outbound(spark, sf):
    return _nodes_of(spark, sf, "outbound", 2)[0].select("node", "depth")


@query(f"WITH {_sql_reach(2, False, True)} SELECT node, depth FROM reach")
def traverse_inbound(spark, sf):
    return _nodes_of(spark, sf, "inbound", 2)[0].select("node", "depth")


@query(f"WITH {_sql_reach(2, True, True)} SELECT node, depth FROM reach")
def traverse_both(spark, sf):
    return _nodes_of(spark, sf, "both", 2)[0].select("node", "depth")


@query(f"WITH {_sql_reach(2, True, False)} SELECT DISTINCT external_key FROM reach JOIN pairs ON a = node WHERE depth < 2 AND external_key IS NOT NULL")
def traverse_external(spark, sf):
    return G.traverse(_adjacent(spark, sf), _ORIGIN, "outbound", 2, 320)["externals"].select("external_key")


@query(f"WITH {_sql_reach(2, True, False)} SELECT DISTINCT edge_id FROM reach JOIN pairs ON a = node WHERE depth < 2")
def traverse_edges(spark, sf):
    return G.traverse(_adjacent(spark, sf), _ORIGIN, "outbound", 2, 320)["edges"].select("edge_id")


#: A capped walk by levels: in each, what is met first takes the room that is left.
_CAPPED = f"""WITH {EDGES}, l1 AS (SELECT dst, min((origin_order, edge_id, tgt_ord)) AS place FROM adj WHERE src = '{_ORIGIN}' AND dst IS NOT NULL AND dst <> '{_ORIGIN}' GROUP BY dst),
t1 AS (SELECT *, row_number() OVER (ORDER BY place) AS r FROM l1), k1 AS (SELECT dst AS node, r FROM t1 WHERE r <= 11),
l2 AS (SELECT a.dst, min((k.r, origin_order, edge_id, tgt_ord)) AS place FROM adj a JOIN k1 k ON a.src = k.node WHERE a.dst IS NOT NULL AND a.dst <> '{_ORIGIN}' AND a.dst NOT IN (SELECT node FROM k1) GROUP BY a.dst),
t2 AS (SELECT *, row_number() OVER (ORDER BY place) AS r FROM l2), k2 AS (SELECT dst AS node, r FROM t2 WHERE r <= 11 - (SELECT count(*) FROM k1)),
visited AS (SELECT '{_ORIGIN}' AS node, 0 AS depth, CAST(0 AS BIGINT) AS rank UNION ALL SELECT node, 1, r FROM k1 UNION ALL SELECT node, 2, r + (SELECT count(*) FROM k1) FROM k2)"""


@query(_CAPPED + " SELECT DISTINCT dst AS node FROM (SELECT dst FROM l1 UNION ALL SELECT dst FROM l2) WHERE dst NOT IN (SELECT node FROM visited)")
def traverse_frontier(spark, sf):
    return G.traverse(_adjacent(spark, sf), _ORIGIN, "outbound", 2, 12)["frontier"]


@query(_CAPPED + " SELECT node AS reference, depth, rank, canonical_order, CASE WHEN depth = 0 THEN 'traversal_origin' ELSE 'official_reference' END AS match_kind FROM visited JOIN nodes ON reference = node")
def traverse_records(spark, sf):
    nodes = G.traverse(_adjacent(spark, sf), _ORIGIN, "outbound", 2, 12)["nodes"]
    kind = F.when(F.col("depth") == 0, "traversal_origin").otherwise("official_reference")
    return nodes.join(T.nodes(spark).withColumnRenamed("reference", "node"), "node").select(F.col("node").alias("reference"), "depth", "rank", "canonical_order", kind.alias("match_kind"))


# Evidence: lexical hits and what they cite, over documents that cite by sharing a source and a word count

_CITES = """cites AS (SELECT a.canonical_order AS src, b.canonical_order AS dst FROM units a JOIN units b ON b.canonical_order = (a.canonical_order * 7 + 3) % (SELECT count(*) FROM units))"""


def _cites(units):
    n = units.agg(F.count("*")).first()[0]
    return units.select(F.col("canonical_order").alias("src"), ((F.col("canonical_order") * 7 + 3) % max(1, n)).alias("dst"))


def _candidates(spark, sf, text="erin thing"):
    units = T.index(spark, sf)["units"].select("canonical_order", "reference")
    pool = _best(spark, sf, text, 99)
    seeds = pool.withColumn("seed_rank", F.row_number().over(W.orderBy("raw_score", "canonical_order")))
    cited = seeds.join(_cites(units), F.col("canonical_order") == F.col("src")).where("dst <> src").select(F.col("dst").alias("canonical_order"), "seed_rank", F.array(F.col("src").cast("string")).alias("path"))
    return G.merged(pool, cited), units


_EVIDENCE = f"""WITH {_sql_search([["erin"], ["thing"]])}, {_CITES}, pool AS (SELECT doc, round(raw_score, 12) AS raw_score, row_number() OVER (ORDER BY round(raw_score, 12), doc) AS rank FROM hits QUALIFY rank <= 100),
both_ AS (SELECT doc, raw_score, 1 AS lex FROM pool UNION ALL SELECT dst, NULL, 0 FROM pool JOIN cites ON src = doc WHERE dst <> src),
cand AS (SELECT doc AS canonical_order, CASE WHEN max(lex) = 1 THEN 0 ELSE 1 END AS lane_priority, coalesce(min(raw_score), 0.0) AS best_score, count(*) AS n_basis FROM both_ GROUP BY doc),
ranked AS (SELECT *, row_number() OVER (ORDER BY lane_priority, best_score, canonical_order) AS rank FROM cand)"""


@query(_EVIDENCE + " SELECT reference, lane_priority, round(best_score, 9) AS best_score, n_basis FROM ranked JOIN units USING (canonical_order)")
def search_evidence(spark, sf):
    found, units = _candidates(spark, sf)
    return found.join(units.select("canonical_order", "reference"), "canonical_order").select("reference", "lane_priority", F.round("best_score", 9).alias("best_score"), F.size("basis").cast("long").alias("n_basis"))


@query(_EVIDENCE + " SELECT canonical_order, lane_priority, round(best_score, 9) AS best_score, rank FROM ranked WHERE rank <= 31")
def rank_candidates(spark, sf):
    first = G.page_after(_candidates(spark, sf)[0], None, 30)
    return first.select("canonical_order", "lane_priority", F.round("best_score", 9).alias("best_score"), F.row_number().over(W.orderBy("lane_priority", "best_score", "canonical_order")).cast("long").alias("rank"))


@query(_EVIDENCE + " SELECT canonical_order, lane_priority, round(best_score, 9) AS best_score FROM ranked WHERE rank BETWEEN 21 AND 41")
def evidence_page(spark, sf):
    found, _ = _candidates(spark, sf)
    last = G.rank_candidates(found).limit(20).collect()
    page = G.page_after(found, (last[-1].lane_priority, last[-1].best_score, last[-1].canonical_order), 20) if last else found.limit(0)
    return page.select("canonical_order", "lane_priority", F.round("best_score", 9).alias("best_score"))


# Normalizing and validating

_STRUCTURE = "(VALUES (0, '1-ne', [3, 2]), (1, '2-ne', [4]), (2, 'jacob', [1, 1, 5])) s(o, book, counts)"
EXPECTED = f"""ex0 AS (SELECT o, book, unnest(range(len(counts))) + 1 AS chapter, unnest(counts) AS n FROM {_STRUCTURE}),
expected AS (SELECT 'bofm/' || book || '/' || chapter || '/' || v AS reference, row_number() OVER (ORDER BY o, chapter, v) - 1 AS canonical_order FROM (SELECT *, unnest(range(1, n + 1)) AS v FROM ex0))"""
PASSAGES = """passages AS (SELECT o_orderkey, 'bofm/' || CASE o_custkey % 3 WHEN 0 THEN '1-ne/' WHEN 1 THEN '2-ne/' ELSE 'jacob/' END || (o_custkey % 4 + 1) || '/' || (o_orderkey % 5 + 1) AS reference, o_orderpriority AS text,
o_orderkey % 17 AS canonical_order, sha256(CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END) AS content_hash, o_orderkey % 13 <> 0 AS spans FROM orders)"""


def _structure(spark):
    return spark.createDataFrame([(0, "1-ne", [3, 2]), (1, "2-ne", [4]), (2, "jacob", [1, 1, 5])], "book_ord int, book string, counts array<int>")


def _passages(spark, sf):
    o = T.table(spark, sf, "orders")
    book = F.when(F.col("o_custkey") % 3 == 0, "1-ne/").when(F.col("o_custkey") % 3 == 1, "2-ne/").otherwise("jacob/")
    hashed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    spans = F.when(F.col("o_orderkey") % 13 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", F.concat(F.lit("bofm/"), book, F.col("o_custkey") % 4 + 1, F.lit("/"), F.col("o_orderkey") % 5 + 1).alias("reference"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 17).alias("canonical_order"), F.sha2(hashed, 256).alias("content_hash"), spans.alias("source_spans"))


def _expected(spark):
    return I.expected_references(_structure(spark))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (ORDER BY lang) AS b, row_number() OVER (PARTITION BY lang ORDER BY source) AS chapter FROM c),
e AS (SELECT *, unnest(range(1, n + 1)) AS verse FROM k) SELECT 'doc/' || coalesce(lang, 'none') || '/' || chapter || '/' || verse AS reference, row_number() OVER (ORDER BY b, chapter, verse) - 1 AS canonical_order FROM e""")
def expected_references(spark, sf):
    """The structure that documents make: languages as books, sources as chapters, as many verses as documents."""
    chapters = T.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").cast("int").alias("n"))
    structure = chapters.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: x["n"]).alias("counts"))
    return I.expected_references(structure.select(F.col("lang").alias("book_ord"), F.coalesce("lang", F.lit("none")).alias("book"), "counts"), "doc")


@query(f"WITH {EXPECTED}, {PASSAGES} SELECT o_orderkey, p.reference, coalesce(e.canonical_order, (SELECT count(*) FROM expected)) AS canonical_order FROM passages p LEFT JOIN expected e USING (reference)")
def canonical_order(spark, sf):
    return I.canonical_order(_passages(spark, sf).drop("canonical_order"), _expected(spark)).select("o_orderkey", "reference", "canonical_order")


_VALID = {
    "validate_missing": "SELECT DISTINCT 'missing_passage' AS code, reference FROM expected WHERE reference NOT IN (SELECT reference FROM passages)",
    "validate_extra": "SELECT DISTINCT 'unexpected_passage' AS code, reference FROM passages WHERE reference NOT IN (SELECT reference FROM expected)",
    "validate_duplicates": "SELECT 'duplicate_passage' AS code, reference FROM passages GROUP BY reference HAVING count(*) > 1",
    "validate_orphans": "SELECT 'orphan_apparatus' AS code, origin_reference AS reference FROM notes WHERE origin_reference NOT IN (SELECT reference FROM nodes)",
    "validate_broken_edges": "SELECT DISTINCT 'broken_local_edge' AS code, dst AS reference FROM adj WHERE dst IS NOT NULL AND dst NOT IN (SELECT reference FROM nodes WHERE canonical_order % 8 < 6)",
}


@query(f"WITH {EXPECTED}, {PASSAGES} {_VALID['validate_missing']}")
def validate_missing(spark, sf):
    return V.missing(_passages(spark, sf), _expected(spark))


@query(f"WITH {EXPECTED}, {PASSAGES} {_VALID['validate_extra']}")
def validate_extra(spark, sf):
    return V.unexpected(_passages(spark, sf), _expected(spark))


@query(f"WITH {EXPECTED}, {PASSAGES} {_VALID['validate_duplicates']}")
def validate_duplicates(spark, sf):
    return V.duplicates(_passages(spark, sf), "reference")


@query(f"WITH {EDGES}, notes AS (SELECT 'bofm/1-ne/' || (o_custkey % 45 + 1) || '/' || (o_orderkey % 9 + 1) AS origin_reference FROM orders) {_VALID['validate_orphans']}")
def validate_orphans(spark, sf):
    return V.orphan_notes(_notes(spark, sf), T.nodes(spark))


@query(f"WITH {EDGES} {_VALID['validate_broken_edges']}")
def validate_broken_edges(spark, sf):
    return V.broken_edges(T.edges(spark, sf), T.nodes(spark).where("canonical_order % 8 < 6")).distinct()


_ALL = f"""{EXPECTED}, {PASSAGES}, notes AS (SELECT 'bofm/1-ne/1/' || (o_orderkey % 9 + 1) AS origin_reference, o_orderkey % 5 <> 0 AS spans FROM orders),
vedges AS (SELECT 'e' || (l_orderkey % 20) AS edge_id, 'bofm/1-ne/1/' || (l_partkey % 5 + 1) AS origin_reference, l_linenumber % 3 <> 0 AS spans, CASE WHEN l_suppkey % 4 = 0 THEN 'v0' ELSE 'official-reference-v1' END AS grammar, 'bofm/jacob/3/' || (l_suppkey % 7 + 1) AS target FROM lineitem),
findings AS (SELECT DISTINCT 'missing_passage' AS code, reference FROM expected WHERE reference NOT IN (SELECT reference FROM passages)
UNION ALL SELECT DISTINCT 'unexpected_passage', reference FROM passages WHERE reference NOT IN (SELECT reference FROM expected)
UNION ALL SELECT 'duplicate_passage', reference FROM passages GROUP BY reference HAVING count(*) > 1
UNION ALL SELECT 'wrong_canonical_order', reference FROM passages JOIN expected USING (reference) WHERE passages.canonical_order <> expected.canonical_order
UNION ALL SELECT 'content_hash_mismatch', reference FROM passages WHERE sha256(text) <> content_hash
UNION ALL SELECT 'missing_source_span', reference FROM passages WHERE NOT spans
UNION ALL SELECT 'orphan_apparatus', origin_reference FROM notes WHERE NOT spans OR origin_reference NOT IN (SELECT reference FROM passages)
UNION ALL SELECT 'duplicate_official_edge', edge_id FROM vedges GROUP BY edge_id HAVING count(*) > 1
UNION ALL SELECT 'orphan_edge', origin_reference FROM vedges WHERE origin_reference NOT IN (SELECT reference FROM passages)
UNION ALL SELECT 'official_edge_missing_source_span', origin_reference FROM vedges WHERE NOT spans
UNION ALL SELECT 'unsupported_official_reference_grammar', origin_reference FROM vedges WHERE grammar <> 'official-reference-v1'
UNION ALL SELECT code, target FROM (SELECT DISTINCT 'broken_local_edge' AS code, edge_id, target FROM vedges WHERE target NOT IN (SELECT reference FROM passages)))"""


def _validated(spark, sf):
    spans = lambda ok: F.when(ok, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    notes = T.table(spark, sf, "orders").select(F.concat(F.lit("bofm/1-ne/1/"), F.col("o_orderkey") % 9 + 1).alias("origin_reference"), spans(F.col("o_orderkey") % 5 != 0).alias("source_spans"))
    line = T.table(spark, sf, "lineitem")
    null = F.lit(None).cast("long")
    target = F.struct(F.lit("internal").alias("kind"), F.lit("bofm").alias("work"), F.lit("jacob").alias("book"), F.lit(3).cast("long").alias("chapter"), (F.col("l_suppkey") % 7 + 1).alias("verse"), null.alias("end_verse"))
    edges = line.select(F.concat(F.lit("e"), F.col("l_orderkey") % 20).alias("edge_id"), F.concat(F.lit("bofm/1-ne/1/"), F.col("l_partkey") % 5 + 1).alias("origin_reference"), spans(F.col("l_linenumber") % 3 != 0).alias("source_spans"), F.when(F.col("l_suppkey") % 4 == 0, "v0").otherwise(R.GRAMMAR).alias("grammar_version"), target.alias("target"))
    return V.validate_corpus(_passages(spark, sf), notes, edges, _expected(spark))


@query(f"WITH {_ALL} SELECT code, reference, count(*) AS n FROM findings GROUP BY ALL")
def validate_corpus(spark, sf):
    return _validated(spark, sf).groupBy("code", "reference").agg(F.count("*").alias("n"))


@query(f"WITH {_ALL} SELECT CASE WHEN sum(n) > 0 THEN 'blocked' ELSE 'accepted' END AS status, CAST(sum(n) AS BIGINT) AS n_findings, string_agg(code || '=' || n, ',' ORDER BY code) AS codes FROM (SELECT code, count(*) AS n FROM findings GROUP BY code)")
def finding_report(spark, sf):
    return V.finding_report(_validated(spark, sf))


@query("""SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'absent' ELSE 'extra' END AS side, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus ELSE 'X' END AS o_orderstatus FROM orders WHERE o_orderkey % 50 IN (0, 1) AND NOT (o_orderkey % 50 = 1 AND o_orderstatus = 'X')
UNION ALL SELECT 'absent', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 50 = 1 AND o_orderstatus <> 'X'""")
def reconcile(spark, sf):
    wanted = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    stored = wanted.where("o_orderkey % 50 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 1, "X").otherwise(F.col("o_orderstatus")))
    return V.reconcile(stored, wanted).select("side", "o_orderkey", "o_orderstatus")


@query(r"""WITH s AS (SELECT d.doc_id, 'r' || doc_id AS reference, CASE WHEN doc_id % 10 = 0 THEN 'pdf' ELSE 'epub' END AS kind, text AS content, substr(text, 5, 20) AS cited, CASE WHEN doc_id % 10 = 1 THEN 'absent words' ELSE substr(text, 7, 8) END AS part, CASE WHEN doc_id % 10 = 2 THEN 30 ELSE 4 END AS s FROM documents d)
SELECT reference, CASE WHEN kind <> 'epub' THEN 'source_span_kind_mismatch' WHEN s > 24 OR doc_id % 10 = 3 OR coalesce(length(content), 0) < 24 THEN 'source_span_unreadable' ELSE 'source_span_mismatch' END AS code FROM s
WHERE kind <> 'epub' OR s > 24 OR doc_id % 10 = 3 OR coalesce(length(content), 0) < 24 OR NOT contains(trim(regexp_replace(cited, '\s+', ' ', 'g')), trim(regexp_replace(part, '\s+', ' ', 'g')))""")
def reconcile_spans(spark, sf):
    d = T.table(spark, sf, "documents")
    i = F.col("doc_id")
    spans = d.select(
        F.concat(F.lit("r"), i).alias("reference"), F.when(i % 10 == 0, "pdf").otherwise("epub").alias("kind"), F.when(i % 10 == 3, -1).otherwise(i).alias("source_id"),
        F.when(i % 10 == 2, 30).otherwise(4).alias("start"), F.lit(24).alias("end"), F.when(i % 10 == 1, "absent words").otherwise(F.substring("text", 7, 8)).alias("text"),
    )
    return V.reconcile_spans(spans, d.select(i.alias("source_id"), F.col("text").alias("content"))).select("reference", "code")


#: A unit's fields as JSON text, in SQL.
_JSON_TEXT = "coalesce(CAST(to_json(text) AS VARCHAR), 'null')"


@query(f"""WITH {UNITS} SELECT canonical_order, sha256('{{"canonical_order":' || canonical_order || ',"content_hash":"' || sha256(text) || '","reference":"' || reference || '","text":' || {_JSON_TEXT} || '}}') AS line FROM units""")
def canonical_projection(spark, sf):
    return I.canonical_projection(T.hashed_units(spark, sf)).withColumn("line", F.sha2("line", 256))


def _sql_rolled(rows: str, by: str = "") -> str:
    """CTEs up to rolled(by, n, digest) over rows (by, pos, line)."""
    keys, group = (f"{by}, ", f"{by}, ") if by else ("", "")
    up = lambda out, of, i, d, n: f"{out} AS (SELECT {keys}{i} // {FAN} AS nth, {n} AS n, sha256(string_agg({i} || ':' || {d}, chr(10) ORDER BY {i}, {d})) AS digest FROM {of} GROUP BY {group}{i} // {FAN})"
    tail = f" GROUP BY {by}" if by else ""
    return f"""d0 AS ({rows}), d1 AS (SELECT {keys}pos, sha256(coalesce(line, '')) AS h FROM d0), {up("d2", "d1", "pos", "h", "count(*)")}, {up("d3", "d2", "nth", "digest", "sum(n)")},
rolled AS (SELECT {keys}CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(nth || ':' || digest, chr(10) ORDER BY nth), '')) AS digest FROM d3{tail})"""


@query(f"""WITH {UNITS}, {_sql_rolled("SELECT canonical_order AS pos, sha256(text) AS line FROM units")} SELECT digest AS normalized_digest FROM rolled""")
def normalized_digest(spark, sf):
    return I.rolled_digest(T.hashed_units(spark, sf).select("canonical_order", "content_hash"), "canonical_order", "content_hash")


@query(f"""WITH {UNITS}, {EDGES} SELECT 0 AS kind_ord, CAST(0 AS BIGINT) AS key_ord, '' AS key, sha256('{{"normalized_digest":"x","source_format":"table","source_profile":"driver","type":"corpus"}}') AS line
UNION ALL SELECT 1, canonical_order, reference, sha256('{{"canonical_order":' || canonical_order || ',"content_hash":"' || sha256(text) || '","reference":"' || reference || '","text":' || {_JSON_TEXT} || ',"type":"passage"}}') FROM units
UNION ALL SELECT 2, 0, 'n' || doc_id, sha256('{{"anchor":null,"note_id":"n' || doc_id || '","type":"note"}}') FROM units
UNION ALL SELECT 3, 0, edge_id, sha256('{{"edge_id":"' || edge_id || '","origin_reference":"' || origin_reference || '","target":"' || target_key || '","type":"edge"}}') FROM keyed""")
def serialize_jsonl(spark, sf):
    units = T.hashed_units(spark, sf)
    head = spark.createDataFrame([("table", "driver", "x")], "source_format string, source_profile string, normalized_digest string")
    notes = units.select(F.concat(F.lit("n"), F.col("doc_id")).alias("note_id"), F.lit(None).cast("string").alias("anchor"))
    lines = I.serialize_jsonl(head, units.select("reference", "text", "canonical_order", "content_hash"), notes, T.edges(spark, sf).withColumn("target", R.target_key(F.col("target"))))
    return lines.withColumn("line", F.sha2("line", 256))


_LINES = """SELECT 'EPUB member `' || chapter || '.xhtml`' AS location, canonical_order AS pos, '- `' || reference || '` — ' || text || chr(10) || '  - content SHA-256: `' || sha256(text) || '`' AS line FROM units"""


@query(f"""WITH {UNITS}, {_sql_rolled(_LINES, "location")} SELECT location, n AS n_passages, digest AS body FROM rolled""")
def review_groups(spark, sf):
    return I.review_groups(T.hashed_units(spark, sf), F.concat(F.lit("EPUB member `"), F.col("chapter"), F.lit(".xhtml`")))


@query("SELECT 'r' || l_orderkey AS reference, count(*) FILTER (l_linenumber % 2 = 0) AS n_spans FROM lineitem GROUP BY l_orderkey")
def overlays(spark, sf):
    span = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "pdf").otherwise("epub").alias("kind"), F.col("l_linenumber").alias("order"))
    rows = T.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("r"), F.col("l_orderkey")).alias("reference")).agg(F.collect_list(span).alias("source_spans"))
    return I.overlays(rows).select("reference", F.size("spans").cast("long").alias("n_spans"))


@query(f"""WITH {EXPECTED} SELECT p.reference, p.text, coalesce(e.canonical_order, (SELECT count(*) FROM expected)) AS canonical_order, sha256(p.text) AS content_hash FROM
(SELECT 'bofm/2-ne/1/' || (o_orderkey % 6 + 1) AS reference, o_orderstatus || ' ' || o_orderpriority AS text FROM orders) p LEFT JOIN expected e USING (reference)""")
def normalize(spark, sf):
    raw = T.table(spark, sf, "orders").select(F.concat(F.lit("bofm/2-ne/1/"), F.col("o_orderkey") % 6 + 1).alias("reference"), F.concat_ws("  ", "o_orderstatus", "o_orderpriority").alias("text"))
    return I.with_hash(I.canonical_order(raw.withColumn("text", X.collapse(F.col("text"))), _expected(spark))).select("reference", "text", "canonical_order", "content_hash")


# Evaluation

_RANKED = f"""{POSTINGS}, cases(case_id, split, a, b) AS (VALUES ('c1', 'locked', 'the', 'of'), ('c2', 'development', 'erin', 'thing'), ('c3', 'locked', 'que', 'le'), ('c4', 'development', NULL, NULL)),
inst AS (SELECT case_id, 0 AS piece, doc, dl FROM cases JOIN post ON term = a UNION ALL SELECT case_id, 1, doc, dl FROM cases JOIN post ON term = b),
dfs AS (SELECT case_id, piece, count(DISTINCT doc) AS df FROM inst GROUP BY ALL), tfs AS (SELECT case_id, piece, doc, dl, count(*) AS tf FROM inst GROUP BY ALL),
sc AS (SELECT case_id, doc, piece, -(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tfs JOIN dfs USING (case_id, piece), stats),
hits AS (SELECT case_id, doc, sum(part ORDER BY piece) AS raw_score FROM sc GROUP BY case_id, doc HAVING count(*) = 2),
ranking AS (SELECT case_id, reference, row_number() OVER (PARTITION BY case_id ORDER BY round(raw_score, 12), canonical_order) AS rank FROM hits JOIN units ON doc = canonical_order),
judged AS (SELECT case_id, reference, max(quality * 2 + 1 - toxic) AS grade FROM labels JOIN units USING (doc_id), cases GROUP BY ALL),
graded AS (SELECT r.*, coalesce(grade, 0) AS grade, grade IS NOT NULL AS judged FROM ranking r LEFT JOIN judged j USING (case_id, reference)),
depths AS (SELECT unnest([1, 3, 5, 10, 20]) AS depth)"""


def _evaluated(spark, sf):
    """Cases, graded rankings of all of them from one job, stored, and judgments."""
    index = T.index(spark, sf)

    def make(put):
        queries = {i: S.compiled(q) for i, (_, _, q) in enumerate(T.CASES)}
        ids = F.broadcast(spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(T.CASES)], "query_id int, case_id string"))
        found = S.with_units(S.search_all(index["blocks"], index["stats"], queries), index["units"].select("canonical_order", "reference")).join(ids, "query_id")
        ranking = E.ranked(found.withColumn("raw_score", F.round("raw_score", 12)), ["raw_score", "canonical_order"]).select("case_id", "reference", "rank")
        judged = put("judged", T.judgments(spark, sf, index["units"]))
        put("graded", E.grades(ranking, judged))

    tables = kept(spark, "graded", [f"{sf}/documents.parquet", f"{sf}/labels.parquet"], make)
    return T.cases(spark), tables["graded"], tables["judged"]


@query(f"WITH {_RANKED} SELECT case_id, reference, rank, CAST(grade AS INT) AS grade, judged FROM graded")
def eval_grades(spark, sf):
    return _evaluated(spark, sf)[1].select("case_id", "reference", "rank", "grade", "judged")


_PR = """SELECT case_id, depth, count(*) FILTER (grade > 0 AND rank <= depth) / depth AS precision, coalesce(count(*) FILTER (grade > 0 AND rank <= depth) / nullif((SELECT count(*) FROM judged j WHERE j.case_id = c.case_id AND j.grade > 0), 0), 0.0) AS recall
FROM cases c CROSS JOIN depths LEFT JOIN graded g USING (case_id) GROUP BY case_id, depth"""
_NDCG = """SELECT case_id, depth, CASE WHEN ideal > 0 THEN actual / ideal ELSE 0.0 END AS ndcg FROM (SELECT c.case_id, depth, coalesce((SELECT sum((2 ** grade - 1) / log2(rank + 1)) FROM graded g WHERE g.case_id = c.case_id AND rank <= depth), 0.0) AS actual,
coalesce((SELECT sum((2 ** grade - 1) / log2(r + 1)) FROM (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC) AS r FROM judged) i WHERE i.case_id = c.case_id AND r <= depth), 0.0) AS ideal FROM cases c CROSS JOIN depths)"""
_MRR = "SELECT case_id, coalesce(1.0 / min(rank) FILTER (grade > 0), 0.0) AS mrr FROM cases LEFT JOIN graded USING (case_id) GROUP BY case_id"
_COVER = "SELECT case_id, count(rank) AS n_returned, CASE WHEN count(rank) = 0 THEN 1.0 ELSE count(*) FILTER (judged) / count(rank) END AS judgment_coverage FROM cases LEFT JOIN graded USING (case_id) GROUP BY case_id"


@query(f"WITH {_RANKED} SELECT case_id, depth, round(precision, 9) AS precision, round(recall, 9) AS recall FROM ({_PR})")
def eval_precision_recall(spark, sf):
    return E.precision_recall(*_evaluated(spark, sf)).select("case_id", "depth", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_RANKED} SELECT case_id, depth, round(ndcg, 9) AS ndcg FROM ({_NDCG})")
def eval_ndcg(spark, sf):
    return E.ndcg(*_evaluated(spark, sf)).select("case_id", "depth", F.round("ndcg", 9).alias("ndcg"))


@query(f"WITH {_RANKED} SELECT case_id, round(mrr, 9) AS mrr FROM ({_MRR})")
def eval_mrr(spark, sf):
    return E.mrr(*_evaluated(spark, sf)[:2]).select("case_id", F.round("mrr", 9).alias("mrr"))


@query(f"WITH {_RANKED} SELECT case_id, n_returned, round(judgment_coverage, 9) AS judgment_coverage FROM ({_COVER})")
def eval_coverage(spark, sf):
    return E.coverage(*_evaluated(spark, sf)[:2]).select("case_id", "n_returned", F.round("judgment_coverage", 9).alias("judgment_coverage"))


@query(f"WITH {_RANKED} SELECT reference, bool_or(split = 'locked') AS in_locked FROM graded JOIN cases USING (case_id) WHERE NOT judged GROUP BY reference")
def eval_unjudged(spark, sf):
    return E.unjudged(*_evaluated(spark, sf)[:2])


@query(f"""WITH {_RANKED}, f AS (SELECT bool_or(grade > 0) AS hit, bool_or(NOT judged) AS open FROM graded JOIN cases USING (case_id) WHERE split = 'locked')
SELECT unnest(list_filter(['no_baseline_comparison', CASE WHEN NOT hit THEN 'no_locked_relevant_hits' END, CASE WHEN open THEN 'incomplete_locked_judgments' END], lambda x: x IS NOT NULL)) AS reason FROM f""")
def eval_eligibility(spark, sf):
    return E.eligibility(*_evaluated(spark, sf)[:2])


@query(f"WITH {_RANKED} SELECT case_id, split, round(mrr, 9) AS mrr, n_returned, round(judgment_coverage, 9) AS judgment_coverage, round(ndcg, 9) AS ndcg_at_10, round(precision, 9) AS precision_at_10, round(recall, 9) AS recall_at_10 FROM cases JOIN ({_MRR}) USING (case_id) JOIN ({_COVER}) USING (case_id) JOIN ({_NDCG}) n USING (case_id) JOIN ({_PR}) p USING (case_id, depth) WHERE depth = 10")
def eval_report(spark, sf):
    cases, graded, judged = _evaluated(spark, sf)
    out = cases.select("case_id", "split").join(E.mrr(cases, graded), "case_id").join(E.coverage(cases, graded), "case_id").join(E.ndcg(cases, graded, judged, [10]), "case_id").join(E.precision_recall(cases, graded, judged, [10]), ["case_id", "depth"])
    r = lambda c, name=None: F.round(c, 9).alias(name or c)
    return out.select("case_id", "split", r("mrr"), "n_returned", r("judgment_coverage"), r("ndcg", "ndcg_at_10"), r("precision", "precision_at_10"), r("recall", "recall_at_10"))


@query("SELECT 'c' || doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'locked' ELSE 'development' END AS split, 'doc ' || doc_id AS query, max(quality) AS grade FROM labels GROUP BY doc_id")
def load_cases(spark, sf):
    """A case for each labelled document, written as a line of JSON and read again, among lines that are blank."""
    from lectern.sources.cases import cases_from_lines

    labels = T.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("grade"))
    judgment = F.array(F.struct(F.concat(F.lit("bofm/1-ne/1/"), F.col("doc_id") % 20 + 1).alias("reference"), F.col("grade").alias("grade")))
    split = F.when(F.col("doc_id") % 3 == 0, "locked").otherwise("development")
    line = F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("case_id"), F.lit(1).alias("schema_version"), split.alias("split"), F.concat(F.lit("doc "), "doc_id").alias("query"), F.lit("r").alias("curator_rationale"), judgment.alias("judgments")))
    lines = labels.select(line.alias("value")).unionByName(labels.where("doc_id % 5 = 0").select(F.lit("   ").alias("value")))
    return cases_from_lines(lines).select("case_id", "split", "query", F.col("judgments")[0]["grade"].cast("long").alias("grade"))


@query("""WITH ret AS (SELECT event_type AS path, event_id AS pos, 'r' || (user_id % 50) AS reference FROM events), pool AS (SELECT DISTINCT 'r' || (l_partkey % 70) AS reference FROM lineitem)
SELECT path, count(DISTINCT reference) AS n_returned, count(DISTINCT reference) FILTER (reference IN (SELECT reference FROM pool)) AS n_covered, round(count(DISTINCT reference) FILTER (reference IN (SELECT reference FROM pool)) / (SELECT count(*) FROM pool), 9) AS coverage FROM ret GROUP BY path""")
def probe_coverage(spark, sf):
    returned = T.table(spark, sf, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("pos"), F.concat(F.lit("r"), F.col("user_id") % 50).alias("reference"))
    pool = T.table(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.col("l_partkey") % 70).alias("reference"))
    return E.pool_coverage(returned, pool).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {UNITS} SELECT CASE WHEN doc_id % 10 = 0 THEN reference || 'x' ELSE reference END AS reference, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM units WHERE doc_id % 10 IN (0, 1)")
def probe_citations(spark, sf):
    units = T.hashed_units(spark, sf)
    returned = units.withColumn("reference", F.when(F.col("doc_id") % 10 == 0, F.concat("reference", F.lit("x"))).otherwise(F.col("reference"))).withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return E.citations(returned, units)


@query("SELECT event_type AS lane, count(*) AS n, event_type IN ('click', 'view') AS allowed FROM events GROUP BY event_type")
def probe_classes(spark, sf):
    return E.class_audit(T.table(spark, sf, "events").select(F.col("event_type").alias("lane")), ["click", "view"])


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return E.latency_percentiles(T.table(spark, sf, "events"), "event_type", "value")


# The registry of corpora, from orders


def _registry(spark, sf):
    return T.table(spark, sf, "orders").select(F.concat(F.lit("corpus-"), F.col("o_orderkey")).alias("corpus_version"), F.col("o_orderdate").alias("accepted_at"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "rejected").otherwise("building").alias("state"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def registry_count(spark, sf):
    return _registry(spark, sf).where("state = 'accepted'").agg(F.count("*").alias("n"))


@query("SELECT 'corpus-' || o_orderkey AS corpus_version FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def registry_latest(spark, sf):
    return _registry(spark, sf).where("state = 'accepted'").orderBy(F.desc("accepted_at"), F.desc("o_orderkey")).limit(1).select("corpus_version")


@query("SELECT 'corpus-' || o_orderkey AS corpus_version, 'baseline-' || l_linenumber AS retrieval_config FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def registry_join(spark, sf):
    configs = T.table(spark, sf, "lineitem").select(F.concat(F.lit("corpus-"), F.col("l_orderkey")).alias("corpus_version"), F.concat(F.lit("baseline-"), F.col("l_linenumber")).alias("retrieval_config"))
    return K.compatible(configs, _registry(spark, sf).where("state = 'accepted'")).select("corpus_version", "retrieval_config")


@query(f"""WITH {_sql_rolled("SELECT doc_id AS pos, coalesce(sha256(text), '') AS line FROM documents")} SELECT n AS n_units, digest, 100 AS candidate_pool_size, 'fts5-bm25' AS algorithm FROM rolled""")
def corpus_metadata(spark, sf):
    line = F.coalesce(X.digest(F.col("text")), F.lit(""))
    rolled = D.rolled(T.table(spark, sf, "documents"), F.col("doc_id"), line)
    return rolled.withColumnRenamed("n", "n_units").withColumns({"candidate_pool_size": F.lit(100), "algorithm": F.lit("fts5-bm25")})


#: Of each document, one in 97 changed, one in 211 gone.
_CHANGED = "SELECT doc_id, sha256(coalesce(text, '')) AS old, CASE WHEN doc_id % 211 <> 0 THEN sha256(coalesce(text, '') || '!') END AS new FROM documents WHERE doc_id % 97 = 0 OR doc_id % 211 = 0"


@query(_CHANGED)
def digest_descent(spark, sf):
    old = T.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = old.where("doc_id % 211 <> 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return D.changed_rows(old, new, "doc_id", F.col("doc_id"), F.col("text"))


# Layout

BLOCKS = LI + """, blocks AS (SELECT l_orderkey AS page, l_linenumber AS ord, ['Text', 'Text', 'SectionHeader', 'Footnote', 'Table'][l_partkey % 5 + 1] AS block_type, l_returnflag AS html, CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 13 * 15 AS DOUBLE) AS top,
l_partkey % 60 + l_quantity AS x1 FROM li)"""


@query(f"WITH {BLOCKS} SELECT page, ord FROM blocks WHERE block_type IN ('Footnote', 'Table') OR (block_type = 'Text' AND (x1 - x0) / 100 < 0.35 AND top > 130)")
def apparatus_blocks(spark, sf):
    return L.apparatus_blocks(T.blocks(spark, sf)).select("page", "ord")


@query(f"WITH {BLOCKS} SELECT page, ord, CAST(least(2, floor((x0 + x1) / 2 * 3 / 100)) AS INT) AS \"column\", CAST(row_number() OVER (PARTITION BY page ORDER BY least(2, floor((x0 + x1) / 2 * 3 / 100)), top, x0, ord) AS INT) AS seq FROM blocks")
def apparatus_order(spark, sf):
    return L.apparatus_order(T.blocks(spark, sf)).select("page", "ord", "column", "seq")


@query(f"""WITH {BLOCKS}, b AS (SELECT *, x0 < 42 AND x1 > 58 AS across FROM blocks WHERE block_type IN ('Text', 'SectionHeader')), s AS (SELECT *, CASE WHEN across THEN (SELECT count(*) FROM b o WHERE o.page = b.page AND o.across AND (o.top < b.top OR (o.top = b.top AND o.ord < b.ord)))
ELSE (SELECT count(*) FROM b o WHERE o.page = b.page AND o.across AND o.top <= b.top) END AS stretch FROM b)
SELECT page, ord, CAST(row_number() OVER (PARTITION BY page ORDER BY stretch, CASE WHEN across THEN 2 WHEN x0 < 50 THEN 0 ELSE 1 END, top, ord) AS INT) AS seq FROM s""")
def visual_order(spark, sf):
    return L.visual_order(T.blocks(spark, sf)).select("page", "ord", "seq")


@query("SELECT l_orderkey, l_linenumber, greatest(0.0, -3 + l_quantity * 0.5) AS x0, greatest(0.0, 1 * 2.0) AS top, least(20.0, l_quantity * 1.0 * 0.5) AS x1, least(40.0, l_tax * 100 * 2.0) AS bottom FROM lineitem")
def bbox_rescale(spark, sf):
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 6).alias("x0"), F.lit(1.0).alias("top"), F.col("l_quantity").alias("x1"), (F.col("l_tax") * 100).alias("bottom"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"), F.lit(20.0).alias("source_width"), F.lit(40.0).alias("source_height"))
    return L.bbox_rescale(rows).select("l_orderkey", "l_linenumber", "x0", "top", "x1", "bottom")


WORDS = """words AS (SELECT l_orderkey AS page, l_returnflag || l_linenumber AS text, CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 100 AS DOUBLE) AS top, CAST(l_partkey % 97 + 3 AS DOUBLE) AS x1, CAST(l_suppkey % 100 + 8 AS DOUBLE) AS bottom FROM lineitem)"""


@query(f"""WITH {WORDS} SELECT page, CAST(round_even(top / 2, 0) AS BIGINT) AS bucket, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM words WHERE top >= 30 AND bottom <= 90 GROUP BY ALL""")
def line_assembly(spark, sf):
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey") % 100
    words = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat("l_returnflag", "l_linenumber").alias("text"), x.cast("double").alias("x0"), y.cast("double").alias("top"), (x + 3).cast("double").alias("x1"), (y + 8).cast("double").alias("bottom"), F.lit(120.0).alias("page_height"))
    return L.line_assembly(words)


@query(r"""WITH l AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '1 Nephi ' WHEN 1 THEN 'JACOB ' ELSE 'Other ' END || (o_custkey % 9 + 1) || ':' || (o_orderkey % 12) || ' ' || o_orderpriority AS line FROM orders)
SELECT o_orderkey, 'bofm/' || CASE WHEN starts_with(line, '1') THEN '1-ne' ELSE 'jacob' END || '/' || regexp_extract(line, ' (\d+):', 1) || '/' || regexp_extract(line, ':(\d+) ', 1) AS reference, regexp_extract(line, ':\d+ (.*)$', 1) AS text FROM l WHERE regexp_matches(line, '^(?:1 Nephi|JACOB) [1-9]\d*:[1-9]')""")
def scan_line_pattern(spark, sf):
    book = F.when(F.col("o_custkey") % 3 == 0, "1 Nephi ").when(F.col("o_custkey") % 3 == 1, "JACOB ").otherwise("Other ")
    lines = T.table(spark, sf, "orders").select("o_orderkey", F.concat(book, F.col("o_custkey") % 9 + 1, F.lit(":"), F.col("o_orderkey") % 12, F.lit(" "), F.col("o_orderpriority")).alias("line"))
    return L.line_pattern(lines, {"1 nephi": "1-ne", "jacob": "jacob"})


GLYPHS = LI + """, glyphs AS (SELECT l_orderkey AS page, l_linenumber AS ord, chr(CAST(97 + l_partkey % 14 AS INT)) AS text, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE 10 + l_suppkey % 2 END AS DOUBLE) AS size, CAST(l_partkey % 90 AS DOUBLE) AS x0, CAST(l_suppkey % 9 * 4 AS DOUBLE) AS top,
CAST(l_partkey % 90 + 5 AS DOUBLE) AS x1, CAST(l_suppkey % 9 * 4 + 8 AS DOUBLE) AS bottom FROM li),
boxes AS (SELECT o_orderkey AS box_id, CAST(o_custkey % 40 AS DOUBLE) AS bx0, 5.0 AS btop, CAST(o_custkey % 40 + 50 AS DOUBLE) AS bx1, 25.0 AS bbottom FROM orders),
near AS (SELECT * FROM glyphs JOIN boxes ON page = box_id WHERE x0 >= bx0 - 1 AND x1 <= bx1 + 1 AND top >= btop - 8 AND bottom <= bbottom + 8)"""


@query(f"WITH {GLYPHS} SELECT box_id, ord, text FROM near")
def glyph_box_join(spark, sf):
    return L.glyph_box_join(T.glyphs(spark, sf), T.boxes(spark, sf)).select("box_id", "ord", "text")


# Of each box a text that is there, one that isn't, a span of another kind, or a source of no known format.
_PAGE_SPANS = GLYPHS + """, cr AS (SELECT box_id, string_agg(text, '' ORDER BY round_even(top / 2, 0), x0, ord) AS content FROM glyphs JOIN boxes ON page = box_id WHERE x0 < bx1 AND x1 > bx0 AND top < bbottom AND bottom > btop GROUP BY box_id),
sp AS (SELECT 'r' || box_id AS reference, box_id, content, CASE box_id % 5 WHEN 1 THEN 'epub' ELSE 'pdf' END AS kind, CASE box_id % 5 WHEN 2 THEN 'djvu' ELSE 'pdf' END AS source_format, CASE WHEN box_id % 5 = 3 THEN 'xyz' ELSE substr(coalesce(content, 'abc'), 1, 2) END AS text FROM boxes LEFT JOIN cr USING (box_id))"""


@query(f"""WITH {_PAGE_SPANS} SELECT reference, CASE WHEN source_format <> 'pdf' THEN 'unsupported_source' WHEN kind <> 'pdf' THEN 'source_span_kind_mismatch' WHEN content IS NULL THEN 'source_span_unreadable' ELSE 'source_span_mismatch' END AS code FROM sp
WHERE source_format <> 'pdf' OR kind <> 'pdf' OR content IS NULL OR NOT contains(content, text)""")
def reconcile_page_spans(spark, sf):
    boxes = T.boxes(spark, sf)
    content = L.cropped_text(T.glyphs(spark, sf), boxes)
    case = F.col("box_id") % 5
    text = F.when(case == 3, "xyz").otherwise(F.substring(F.coalesce("content", F.lit("abc")), 1, 2))
    spans = boxes.select("box_id").join(content, "box_id", "left").select(F.concat(F.lit("r"), "box_id").alias("reference"), F.col("box_id").alias("source_id"), F.when(case == 1, "epub").otherwise("pdf").alias("kind"), F.when(case == 2, "djvu").otherwise("pdf").alias("source_format"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), text.alias("text"))
    return V.reconcile_sources(spans, {"pdf": content.withColumnRenamed("box_id", "source_id")}).select("reference", "code")


@query(f"WITH {GLYPHS} SELECT page, arg_max(size, (n, -f)) AS mode FROM (SELECT page, size, count(*) AS n, min(ord) AS f FROM glyphs GROUP BY ALL) GROUP BY page")
def dominant_mode(spark, sf):
    return L.dominant_mode(T.glyphs(spark, sf), ["page"], F.bround("size", 1), "ord").select("page", F.col("mode").cast("double").alias("mode"))


@query(f"""WITH {GLYPHS}, m AS (SELECT box_id, arg_max(size, (n, -f)) AS mode FROM (SELECT box_id, size, count(*) AS n, min(ord) AS f FROM near GROUP BY ALL) GROUP BY box_id), x AS (SELECT * FROM near JOIN m USING (box_id))
SELECT box_id, count(*) AS n FROM x WHERE text <= 'k' AND size < mode * 0.8 AND EXISTS (SELECT 1 FROM x b WHERE b.box_id = x.box_id AND b.size >= b.mode * 0.9 AND b.top BETWEEN b.btop - 2 AND b.bbottom + 2 AND abs(b.top - x.top) <= 8) GROUP BY box_id""")
def superscript_count(spark, sf):
    return L.superscript_count(L.glyph_box_join(T.glyphs(spark, sf), T.boxes(spark, sf)))


@query("""WITH l AS (SELECT l_orderkey AS reference, list_sort(list_distinct(list(chr(CAST(96 + l_linenumber - (l_orderkey % 7 = 0)::INT AS INT))))) AS have FROM lineitem GROUP BY l_orderkey)
SELECT 'r' || reference AS reference, len(have) AS n, have = list_transform(range(1, len(have) + 1), lambda k: chr(CAST(96 + k AS INT))) AS sequential FROM l""")
def label_sequence(spark, sf):
    label = F.char(F.lit(96) + F.col("l_linenumber") - (F.col("l_orderkey") % 7 == 0).cast("int"))
    return L.label_sequence(T.table(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey")).alias("reference"), label.alias("label")))


@query(f"""WITH {LI}, m AS (SELECT l_orderkey AS reference, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth, chr(CAST(97 + l_suppkey % 3 AS INT)) AS observed FROM li)
SELECT reference, nth, observed, chr(CAST(96 + nth AS INT)) AS canonical, observed <> chr(CAST(96 + nth AS INT)) AS changed FROM m""")
def inline_labels(spark, sf):
    text = F.concat(F.lit("word [[marker:"), F.char(F.lit(97) + F.col("l_suppkey") % 3), F.lit("]] more"))
    return L.inline_labels(T.lines(spark, sf).select(F.col("l_orderkey").alias("reference"), F.col("l_linenumber").alias("ord"), text.alias("text"))).drop("ord")


@query(f"""WITH {LI}, b AS (SELECT l_orderkey % 50 AS doc, l_orderkey AS page, l_linenumber AS seq, CASE WHEN l_suppkey % 10 = 0 THEN 'JACOB' WHEN l_suppkey % 10 = 1 THEN 'ENOS' WHEN l_suppkey % 10 < 4 THEN 'CHAPTER ' || (l_partkey % 20 + 1) END AS head FROM li),
o AS (SELECT *, CASE WHEN head IN ('JACOB', 'ENOS') THEN lower(head) END AS bk, CASE WHEN head = 'ENOS' THEN 1 WHEN head = 'JACOB' THEN 0 WHEN head LIKE 'CHAPTER%' THEN CAST(split_part(head, ' ', 2) AS INT) END AS ch FROM b),
c AS (SELECT *, last_value(bk IGNORE NULLS) OVER w AS book, nullif(last_value(ch IGNORE NULLS) OVER w, 0) AS chapter FROM o WINDOW w AS (PARTITION BY doc ORDER BY page, seq ROWS UNBOUNDED PRECEDING))
SELECT page, seq, book, CASE WHEN book IS NOT NULL THEN chapter END AS chapter FROM c""")
def carry_forward(spark, sf):
    line = T.lines(spark, sf)
    s = F.col("l_suppkey") % 10
    head = F.when(s == 0, "Jacob").when(s == 1, "Enos").when(s < 4, F.concat(F.lit("CHAPTER "), F.col("l_partkey") % 20 + 1))
    blocks = line.select((F.col("l_orderkey") % 50).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), F.when(head.isNotNull(), "SectionHeader").otherwise("Text").alias("block_type"), F.coalesce(head, F.lit("text")).alias("text"))
    titles = spark.createDataFrame([("JACOB", "jacob", 7), ("ENOS", "enos", 1)], "title_key string, book string, n_chapters int")
    return L.carry_forward(blocks, titles).select("page", "seq", "book", "chapter")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a href="[^"]*"')) AS n_links, list_extract(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS first_link FROM pages""")
def attr_extract(spark, sf):
    from lectern.sources.markup import attribute

    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return T.table(spark, sf, "pages").select("page_id", attribute(F.regexp_extract("html", "<html[^>]*>", 0), "lang").alias("lang"), F.size(links).cast("long").alias("n_links"), F.get(links, F.lit(0)).alias("first_link"))


@query("SELECT page_id, greatest(0, position('<article>' IN html) - 1) AS start, greatest(0, position('<article>' IN html) - 1) + 9 AS \"end\" FROM pages")
def span_locate(spark, sf):
    from lectern.sources.markup import located

    return T.table(spark, sf, "pages").select("page_id", F.inline(F.array(located(F.col("html"), F.lit("<article>")))))


# Sources and grouped functions over what Spark makes of the tables


_BODY = ['<html><body><section data-scripture-profile="' + PROFILE + '">', "</section></body></html>"]


# Page files of a thousand order numbers, a page for each fifty, a line for each order, every ninth of which names no unit.
@query("""WITH o AS (SELECT o_orderkey // 1000 AS a, o_orderkey % 1000 // 50 + 1 AS c, o_orderkey % 50 + 1 AS v, o_orderkey % 9 AS other, o_orderkey || ' ' || o_orderpriority AS t FROM orders),
p AS (SELECT *, dense_rank() OVER (PARTITION BY a ORDER BY c) AS page FROM o)
SELECT 'a' || a AS path, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY a ORDER BY c, v) - 1 AS INT) AS ord, 'bofm/2-ne/' || c || '/' || v AS reference, t AS text, 72.0::DOUBLE AS x0, round(51.57 + 12.5 * v, 2)::DOUBLE AS top FROM p WHERE other > 0""")
def scan_page_text(spark, sf):
    """Page files made by Spark and read again: objects, glyphs, words, lines, units."""
    from lectern.sources import pages

    key = F.col("o_orderkey")
    rows = T.table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("a"), F.expr("o_orderkey % 1000 div 50 + 1").alias("c"), (key % 50 + 1).alias("v"), F.when(key % 9 == 0, "Order ").otherwise("2 Nephi ").alias("title"), F.concat(key, F.lit(" "), "o_orderpriority").alias("t"))
    line = F.struct("v", F.concat("title", "c", F.lit(":"), "v", F.lit(" "), "t").alias("line"))
    leaves = rows.groupBy("a", "c").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    files = leaves.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("c", "lines"))).alias("leaves"))

    def printed(frames):
        import pandas as pd

        for pdf in frames:
            made = [pages.document_of([[(72, 740, 10, pages.MARKER), *((72, 720 - 12.5 * x["v"] + 12.5, 10, x["line"]) for x in leaf["lines"])] for leaf in leaves]) for leaves in pdf["leaves"]]
            yield pd.DataFrame({"path": [f"a{a}" for a in pdf["a"]], "content": made})

    leaves = pages.page_rows(files.mapInPandas(printed, "path string, content binary")).repartition("path", "page")
    span = F.col("source_spans")[0]
    return pages.units(pages.lines(pages.glyph_rows(leaves))).select("path", span["page"].cast("int").alias("page"), span["order"].cast("int").alias("ord"), "reference", "text", span["bbox"]["x0"].alias("x0"), F.round(span["bbox"]["top"], 2).alias("top"))


# A chapter is fifty orders, each a unit, every seventh with a citation behind it.
@query(f"""WITH o AS (SELECT o_orderkey // 1000 AS a, o_orderkey % 1000 // 50 + 1 AS c, o_orderkey % 50 + 1 AS v, o_orderkey % 7 = 0 AS cites, 'bofm/1-ne/' || (o_orderkey % 1000 // 50 + 1) || '/' || (o_orderkey % 50 + 1) AS r, 'Order ' || o_orderkey || ' ' || o_orderpriority AS t, o_custkey % 50 + 1 AS k FROM orders),
h AS (SELECT *, '<a data-origin="' || r || '" data-anchor="a" data-target="bofm/1-ne/1/' || k || '" data-source="s">' AS tag FROM o),
b AS (SELECT a, c, '{_BODY[0]}' || string_agg('<p data-reference="' || r || '">' || t || '</p>' || CASE WHEN cites THEN tag || 'x</a>' ELSE '' END, '' ORDER BY v) || '{_BODY[1]}' AS body FROM h GROUP BY a, c),
u AS (SELECT a, c, v, 0 AS n, 'passage' AS kind, r AS id, t AS text, NULL AS target, t AS piece FROM h UNION ALL SELECT a, c, v, 1, 'edge', NULL, NULL, 'bofm/1-ne/1/' || k, tag FROM h WHERE cites)
SELECT 'a' || a AS path, kind, CAST(row_number() OVER (PARTITION BY a ORDER BY c, v, n) - 1 AS INT) AS ord, 'OPS/c' || c || '.xhtml' AS member, id, target, text, position(piece IN body) - 1 AS start, position(piece IN body) - 1 + length(piece) AS "end" FROM u JOIN b USING (a, c)""")
def scan_markup_units(spark, sf):
    """Archives of a thousand order numbers each, made by Spark and read again."""
    from lectern.sources.markup import archive_of, markup_units

    key, r = F.col("o_orderkey"), F.col("r")
    rows = T.table(spark, sf, "orders").select(F.expr("o_orderkey div 1000").alias("a"), F.expr("o_orderkey % 1000 div 50 + 1").alias("c"), (key % 50 + 1).alias("v"), (key % 7 == 0).alias("cites"), F.concat(F.lit("Order "), key, F.lit(" "), "o_orderpriority").alias("t"), (F.col("o_custkey") % 50 + 1).alias("k"))
    rows = rows.withColumn("r", F.concat_ws("/", F.lit("bofm/1-ne"), "c", "v"))
    cite = F.concat(F.lit('<a data-origin="'), r, F.lit('" data-anchor="a" data-target="bofm/1-ne/1/'), "k", F.lit('" data-source="s">x</a>'))
    html = F.concat(F.lit('<p data-reference="'), r, F.lit('">'), "t", F.lit("</p>"), F.when(F.col("cites"), cite).otherwise(""))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["html"]), "")
    chapters = rows.groupBy("a", "c").agg(F.concat(F.lit(_BODY[0]), joined(F.struct("v", html.alias("html"))), F.lit(_BODY[1])).alias("body"))
    archives = chapters.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("c", "body"))).alias("chapters"))

    def packed(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"path": [f"a{a}" for a in pdf["a"]], "content": [archive_of({f"c{x['c']}.xhtml": x["body"] for x in chapters}) for chapters in pdf["chapters"]]})

    found = markup_units(archives.mapInPandas(packed, "path string, content binary"))
    return found.select("path", "kind", F.col("ord").cast("int").alias("ord"), "member", "id", "target", "text", "start", "end")


@query(f"""WITH {LI} SELECT 'd' || (l_orderkey // 100) AS doc, dense_rank() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey) - 1 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ord,
['Text', 'Text', 'SectionHeader', 'Footnote', 'Table'][l_partkey % 5 + 1] AS block_type, '<p>' || l_returnflag || '</p>' AS html, CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 13 AS DOUBLE) AS top, CAST(l_partkey % 60 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 13 + 5 AS DOUBLE) AS bottom,
0.0 AS page_x0, 0.0 AS page_top, 100.0 AS page_x1, 200.0 AS page_bottom FROM li""")
def scan_layout_blocks(spark, sf):
    """Exports of a hundred orders each: an order is a page, its lines are blocks."""
    from lectern.sources.layout_json import blocks

    kind = F.element_at(F.array(*map(F.lit, ("Text", "Text", "SectionHeader", "Footnote", "Table"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    x0, top = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 13).cast("double")
    block = F.struct(kind.alias("block_type"), F.concat(F.lit("<p>"), "l_returnflag", F.lit("</p>")).alias("html"), F.array(x0, top, x0 + F.col("l_quantity"), top + 5).alias("bbox"))
    body = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["b"])
    pages = T.lines(spark, sf).groupBy("l_orderkey").agg(body(F.struct("l_linenumber", block.alias("b"))).alias("children"))
    page = F.struct(F.lit("Page").alias("block_type"), F.array(*map(F.lit, (0.0, 0.0, 100.0, 200.0))).alias("bbox"), "children")
    exports = pages.groupBy(F.concat(F.lit("d"), F.expr("l_orderkey div 100")).alias("doc")).agg(F.to_json(F.struct(body(F.struct("l_orderkey", page.alias("b"))).alias("children"))).alias("json"))
    return blocks(exports)


#: Fragments of chapters of eight orders: numbers that lead, are marked, follow each other or are only shown, at or near the one that is due.
_FRAGMENTS = LI + """, fr AS (SELECT CAST(l_orderkey // 8 AS INT) AS chapter, l_orderkey % 8 * 8 + l_linenumber AS k, l_orderkey AS page, l_partkey AS w, l_quantity % 5 = 0 AS narrow, l_linenumber % 4 = 0 AS italic, (l_orderkey % 8 * 8 + l_linenumber) // 3 + l_partkey % 3 AS n, l_suppkey % 8 AS form FROM li),
f AS (SELECT *, CASE WHEN w % 2 = 0 THEN n END AS shown, CASE form WHEN 0 THEN n || ' Word' || w WHEN 1 THEN 'Some [[verse:' || n || ']] more text' WHEN 2 THEN 'Plain words' WHEN 3 THEN n || ' First ' || (n + 1) || ' second ' || (n + 2) || ' third'
WHEN 4 THEN 'A b ' || n || ' c' WHEN 5 THEN '[[verse:' || n || ']] Lead ' || (n + 1) || ' x' WHEN 6 THEN 'An account of W' || w ELSE 'lower words' END AS text FROM fr)"""

# Words are read one after the other, with the verse and the last place where one began as state.
_VERSES = _FRAGMENTS + r""", wd AS (SELECT chapter, k, narrow, italic, shown, string_split(text, ' ') AS ws, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM f),
nu AS (SELECT *, len(ws) - 1 AS last, starts_with(word, '[[') AS marked, CAST(regexp_extract(word, '[0-9]+') AS INT) AS n FROM wd WHERE regexp_full_match(word, '\[\[verse:[0-9]{1,3}\]\]|[0-9]{1,3}')),
fa AS (SELECT chapter, k, min(i) FILTER (marked) AS mark, bool_or(i = 0 AND last >= 1) AND bool_or(narrow) AS closed FROM nu GROUP BY ALL),
x AS (SELECT nu.*, mark, closed, row_number() OVER (PARTITION BY chapter ORDER BY k, i) AS t FROM nu JOIN fa USING (chapter, k)),
st AS (WITH RECURSIVE s(chapter, t, v, ek, ei, ok) AS (SELECT DISTINCT chapter, CAST(0 AS BIGINT), 1, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), false FROM x
UNION ALL SELECT chapter, t, CASE WHEN ok THEN n ELSE v END, CASE WHEN ok THEN k ELSE ek END, CASE WHEN ok THEN i ELSE ei END, ok FROM (SELECT x.chapter, x.t, x.n, x.k, x.i, s.v, s.ek, s.ei,
x.n = s.v + 1 AND CASE WHEN x.k = s.ek THEN i >= s.ei + 2 AND i < last ELSE (i = 0 AND last >= 1) OR (NOT closed AND marked AND i = mark) OR (NOT closed AND mark IS NULL AND i < last AND coalesce(shown = n, false)) END AS ok
FROM s JOIN x ON x.chapter = s.chapter AND x.t = s.t + 1)) SELECT * FROM s),
acc AS (SELECT x.chapter, x.k, x.i, x.n, NOT marked AND i > 0 AND mark IS NULL AND lag(x.k) OVER (PARTITION BY x.chapter ORDER BY x.k, x.i) IS DISTINCT FROM x.k AS recovered FROM x JOIN st USING (chapter, t) WHERE st.ok),
now AS (SELECT f.chapter, f.k, (SELECT max(n) FROM acc WHERE acc.chapter = f.chapter AND acc.k < f.k) AS v, (SELECT count(*) FROM acc WHERE acc.chapter = f.chapter AND acc.k = f.k) AS cuts FROM f),
own AS (SELECT wd.chapter, wd.k, wd.i, wd.word, wd.italic, cuts, v, wd.narrow, max(acc.i) AS c, max(acc.n) AS n, bool_or(acc.i = wd.i) AS is_cut FROM wd JOIN now ON now.chapter = wd.chapter AND now.k = wd.k LEFT JOIN acc ON acc.chapter = wd.chapter AND acc.k = wd.k AND acc.i <= wd.i GROUP BY ALL),
pc AS (SELECT chapter, k, coalesce(c, -1) AS piece, coalesce(max(n), max(v)) AS verse, bool_or(italic) AS italic, string_agg(word, ' ' ORDER BY i) AS text FROM own WHERE coalesce(NOT is_cut, true) AND (cuts > 0 OR NOT narrow) GROUP BY chapter, k, coalesce(c, -1)),
pe AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY k, piece) AS j, regexp_matches(text, '^(?:\p{Ll}|An account |WHO IS )|—|\b(?:B\.C\.|A\.D\.)') AS s FROM pc WHERE verse IS NULL),
hd AS (SELECT *, min(j) FILTER (s OR (j = 1 AND italic)) OVER (PARTITION BY chapter) AS h, max(j) OVER (PARTITION BY chapter) AS z FROM pe),
sa AS (SELECT *, coalesce(min(j) FILTER (NOT s AND j > h) OVER (PARTITION BY chapter), z) AS b FROM hd),
am AS (SELECT chapter FROM sa GROUP BY chapter HAVING bool_or(j = b - 1 AND NOT s) AND bool_or(j < b AND NOT italic AND NOT s)),
al AS (SELECT chapter, k, piece, verse, text FROM pc WHERE verse IS NOT NULL UNION ALL SELECT chapter, k, piece, 1, text FROM sa WHERE j >= b)
SELECT chapter, verse, CAST(row_number() OVER (PARTITION BY chapter ORDER BY k, piece) - 1 AS INT) AS ord, k, text, NULL AS finding FROM al
UNION ALL SELECT chapter, n, NULL, NULL, NULL, 'inline_verse_marker_recovered' FROM acc WHERE recovered UNION ALL SELECT chapter, 1, NULL, NULL, NULL, 'ambiguous_verse_one_boundary' FROM am"""


@query(f"WITH {_VERSES}")
def verse_fsm(spark, sf):
    k = (F.col("l_orderkey") % 8 * 8 + F.col("l_linenumber")).cast("long")
    n, w = (F.floor(k / 3) + F.col("l_partkey") % 3).cast("int"), F.col("l_partkey")
    lines = T.lines(spark, sf).select(F.expr("l_orderkey div 8").cast("int").alias("chapter"), k.alias("k"), F.col("l_orderkey").cast("int").alias("page"), w.alias("w"), F.when(F.col("l_quantity") % 5 == 0, 0.2).otherwise(0.8).alias("width_ratio"), (F.col("l_linenumber") % 4 == 0).alias("italic"), n.alias("n"), (F.col("l_suppkey") % 8).alias("form"))
    forms = ["{n} Word{w}", "Some [[verse:{n}]] more text", "Plain words", "{n} First {n1} second {n2} third", "A b {n} c", "[[verse:{n}]] Lead {n1} x", "An account of W{w}", "lower words"]
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("form") + 1).cast("int"))
    for name, value in (("{n}", F.col("n")), ("{n1}", F.col("n") + 1), ("{n2}", F.col("n") + 2), ("{w}", F.col("w"))):
        text = F.replace(text, F.lit(name), value.cast("string"))
    fragments = lines.withColumns({"doc": F.lit("d"), "book": F.lit("b"), "text": text, "shown": F.when(F.col("w") % 2 == 0, F.array("n"))})
    return L.verse_fsm(fragments).select("chapter", "verse", "ord", "k", "text", "finding")


@query(f"""WITH {LI}, e AS (SELECT l_orderkey AS page, l_linenumber AS l, l_partkey AS w, l_linenumber % 2 = 1 AS explicit, CASE WHEN l_linenumber % 2 = 1 THEN chr(CAST(97 + l_suppkey % 3 AS INT)) ELSE chr(CAST(98 + l_suppkey % 4 AS INT)) END AS anchor FROM li),
v AS (SELECT *, last_value(CASE WHEN explicit THEN l END IGNORE NULLS) OVER (PARTITION BY page ORDER BY l ROWS UNBOUNDED PRECEDING) AS verse FROM e)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY l) - 1 AS INT) AS ord, verse, anchor, 'note p' || w AS text, explicit FROM v WHERE verse IS NOT NULL""")
def parse_apparatus(spark, sf):
    """An order is a page, its lines are footnotes of one block: odd ones with a number, even ones that go on with a letter."""
    odd = F.col("l_linenumber") % 2 == 1
    label = F.when(odd, F.concat("l_linenumber", F.char(F.lit(97) + F.col("l_suppkey") % 3))).otherwise(F.char(F.lit(98) + F.col("l_suppkey") % 4))
    item = F.struct("l_linenumber", F.concat(label, F.lit(" note p"), "l_partkey").alias("t"))
    pages = T.lines(spark, sf).groupBy(F.col("l_orderkey").cast("int").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), " ").alias("t"))
    blocks = pages.select(F.lit("d").alias("doc"), "page", F.lit(0).alias("ord"), F.lit(1).alias("seq"), F.concat(F.lit("<p>"), "t", F.lit("</p>")).alias("html"))
    return L.parse_apparatus(blocks).select("page", "ord", F.col("verse").cast("long").alias("verse"), "anchor", "text", "explicit")


# Notes choose one after the other among what is left of their verse and anchor.
_LINKS = LI + """, m AS (SELECT l_orderkey // 400 AS doc, l_orderkey || '-' || l_linenumber AS note_id, l_orderkey // 20 AS chapter, l_linenumber AS verse, chr(CAST(97 + l_suppkey % 4 AS INT)) AS anchor, l_orderkey // 4 AS page, CASE WHEN l_partkey % 3 = 0 THEN [l_orderkey // 4, l_orderkey // 4 + 1] ELSE [l_orderkey // 4] END AS pages, l_orderkey * 8 + l_linenumber AS nth FROM li),
e AS (SELECT l_orderkey // 400 AS doc, l_orderkey // 4 + (l_partkey % 5 = 0)::INT AS page, l_orderkey % 4 * 16 + l_linenumber * 2 + (l_partkey % 5 = 0)::INT AS ord, l_linenumber + (l_suppkey % 7 = 0)::INT AS verse, chr(CAST(97 + (l_suppkey + (l_partkey % 11 = 0)::INT) % 4 AS INT)) AS anchor, 't' || l_orderkey || '-' || l_linenumber AS text FROM li),
en AS (SELECT *, page * 1048576 + ord AS entry FROM e), g AS (SELECT doc, verse, anchor, list({'e': entry, 'p': page} ORDER BY entry) AS free FROM en GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, verse, anchor ORDER BY nth) AS t FROM m),
st AS (WITH RECURSIVE s(doc, verse, anchor, t, free, note_id, took, how) AS (SELECT DISTINCT r.doc, r.verse, r.anchor, CAST(0 AS BIGINT), g.free, '', CAST(NULL AS BIGINT), '' FROM r JOIN g ON g.doc = r.doc AND g.verse = r.verse AND g.anchor = r.anchor
UNION ALL SELECT doc, verse, anchor, t, list_filter(free, lambda x: coalesce(x.e <> took, true)), note_id, took, how FROM (SELECT *, CASE WHEN len(same) > 0 THEN same[1].e WHEN len(near) = 1 THEN near[1].e END AS took, CASE WHEN len(same) > 0 THEN 'page' WHEN len(near) = 1 THEN 'pages' END AS how FROM (SELECT r.doc, r.verse, r.anchor, r.t, s.free, r.note_id,
list_filter(s.free, lambda x: x.p = r.page) AS same, list_filter(s.free, lambda x: list_contains(r.pages, x.p)) AS near FROM s JOIN r ON r.doc = s.doc AND r.verse = s.verse AND r.anchor = s.anchor AND r.t = s.t + 1))) SELECT * FROM s WHERE took IS NOT NULL),
ln AS (SELECT *, count(*) OVER w AS n, min(chapter) OVER w = max(chapter) OVER w AS one, row_number() OVER (PARTITION BY doc, page, verse ORDER BY anchor, nth) AS i FROM m WHERE note_id NOT IN (SELECT note_id FROM st) WINDOW w AS (PARTITION BY doc, page, verse)),
le AS (SELECT *, count(*) OVER (PARTITION BY doc, page, verse) AS n, row_number() OVER (PARTITION BY doc, page, verse ORDER BY anchor, entry) AS i FROM en WHERE (doc, entry) NOT IN (SELECT (doc, took) FROM st)),
found AS (SELECT note_id, took AS entry, how FROM st UNION ALL SELECT note_id, entry, 'order' FROM ln JOIN le USING (doc, page, verse, n, i) WHERE one)
SELECT m.note_id, found.entry, text, how FROM m LEFT JOIN found USING (note_id) LEFT JOIN en ON en.doc = m.doc AND en.entry = found.entry"""


@query(f"WITH {_LINKS}")
def link_apparatus(spark, sf):
    """Lines of orders as markers, and again, moved in part, as footnotes; a source is 400 orders."""
    line = T.lines(spark, sf)
    own = lambda on: F.when(on, 1).otherwise(0)
    page = F.expr("l_orderkey div 4").cast("int")
    doc = F.expr("l_orderkey div 400").cast("string").alias("doc")
    pages = F.when(F.col("l_partkey") % 3 == 0, F.array(page, page + 1)).otherwise(F.array(page))
    notes = line.select(doc, F.concat_ws("-", "l_orderkey", "l_linenumber").alias("note_id"), F.concat_ws("/", F.lit("b"), F.expr("l_orderkey div 20"), "l_linenumber").alias("reference"), F.char(F.lit(97) + F.col("l_suppkey") % 4).alias("anchor"), page.alias("page"), pages.alias("pages"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    moved = own(F.col("l_partkey") % 5 == 0)
    entries = line.select(
        doc, (page + moved).alias("page"), (F.col("l_orderkey") % 4 * 16 + F.col("l_linenumber") * 2 + moved).cast("int").alias("ord"), (F.col("l_linenumber") + own(F.col("l_suppkey") % 7 == 0)).cast("int").alias("verse"),
        F.char(F.lit(97) + (F.col("l_suppkey") + own(F.col("l_partkey") % 11 == 0)) % 4).alias("anchor"), F.concat(F.lit("t"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("text"),
    )
    return L.link_apparatus(notes, entries).select("note_id", "entry", "text", "how")


@query(f"""WITH {LI}, e AS (SELECT l_orderkey AS r, chr(CAST(96 + l_linenumber AS INT)) AS anchor FROM li WHERE l_linenumber <= 2), p AS (SELECT l_orderkey AS r, chr(CAST(96 + l_linenumber AS INT)) AS anchor FROM li WHERE l_linenumber BETWEEN 3 AND 5 AND l_suppkey % 4 <> 0),
g AS (SELECT r, count(*) AS n FROM p GROUP BY r), h AS (SELECT r, list_sort(list_distinct(list(anchor))) AS a FROM (SELECT * FROM e UNION ALL SELECT * FROM p) GROUP BY r)
SELECT 'r' || p.r AS reference, anchor, 't' AS text FROM p JOIN h USING (r) WHERE a = list_transform(range(1, len(a) + 1), lambda k: chr(CAST(96 + k AS INT)))""")
def recover_labels(spark, sf):
    line = T.lines(spark, sf).select(F.concat(F.lit("r"), F.col("l_orderkey")).alias("reference"), F.char(F.lit(96) + F.col("l_linenumber")).alias("anchor"), "l_linenumber", "l_suppkey")
    proposed = line.where("l_linenumber BETWEEN 3 AND 5 AND l_suppkey % 4 <> 0").select("reference", "anchor", F.lit("t").alias("text"), F.lit(True).alias("explicit"))
    return L.recover_labels(line.where("l_linenumber <= 2").select("reference", "anchor"), proposed)
