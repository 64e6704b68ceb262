"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lectern.llm import merkle

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = rf"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS x FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = word.doc_id AND g.p = word.p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP8 = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i + 1, i + 8) AS x FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
s AS (SELECT sum(f) / sum(host_docs) AS m, sum(f * f / host_docs) / sum(host_docs) - (sum(f) / sum(host_docs)) ** 2 AS v FROM h),
p AS (SELECT m, CASE WHEN v <= m * (1 - m) / 10001 THEN 10000 ELSE greatest(1, m * (1 - m) / v - 1) END AS k FROM s),
g AS (SELECT source, host_docs, (f + m * k) / (host_docs + k) > 0.5 AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_docs, host_rejected FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source"""


def _cut(text: str, pattern: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda x: x <> '')"


def _fingerprint(tree: str) -> str:
    """From a tree of sections, of paragraphs, of pieces' hashes."""
    paragraph = "sha256(array_to_string(p, ''))"
    section = f"sha256(array_to_string(list_transform(s, lambda p: {paragraph}), ''))"
    pieces = "array_to_string(list_transform(p, lambda x: left(x, 12)), '')"
    paragraphs = f"array_to_string(list_transform(s, lambda p: left({paragraph}, 12) || '.' || {pieces}), ',')"
    return f"left(sha256(array_to_string(list_transform({tree}, lambda s: {section}), '')), 32) || ':' || array_to_string(list_transform({tree}, lambda s: left({section}, 12) || '=' || {paragraphs}), ';')"


def _tree(text: str) -> str:
    pieces = f"list_transform({_cut('p', merkle.PIECE)}, lambda x: sha256(x))"
    return f"list_transform({_cut(text, merkle.SECTION)}, lambda s: list_transform({_cut('s', merkle.PARAGRAPH)}, lambda p: {pieces}))"


def _same(x: str, y: str) -> str:
    """Number of equal elements at the start of two lists."""
    unlike = f"list_transform(range(1, greatest(len({x}), len({y})) + 1), lambda i: coalesce(left({x}[i], 12) <> left({y}[i], 12), true))"
    return f"coalesce(nullif(list_position({unlike}, true), 0) - 1, len({x}))"


def _between(out: str, of: str, x: str, y: str, keep: str) -> str:
    """CTEs that leave, of the lists x and y of each row of a table, what lies between equal ends, as x and y; h: equal ones before."""
    cut = lambda c: f"CASE WHEN h + t >= len({c}) THEN [] ELSE {c}[h + 1 : len({c}) - t] END"
    return f"""{out}0 AS (SELECT {keep}, {x} AS x, {y} AS y FROM {of}), {out}1 AS (SELECT *, {_same("x", "y")} AS h FROM {out}0),
{out}2 AS (SELECT *, {_same("list_reverse(x[h + 1 :])", "list_reverse(y[h + 1 :])")} AS t FROM {out}1),
{out} AS (SELECT * EXCLUDE (x, y, t), {cut("x")} AS x, {cut("y")} AS y FROM {out}2)"""


def _pieces(fp: str) -> str:
    body = f"substr({fp}, 34)"
    return f"(length(translate({body}, ';=,.', '')) // 12 - length({body}) + length(translate({body}, '=.', '')))"


_SECTIONS = "list_filter(string_split(substr({}, 34), ';'), lambda z: z <> '')"
_CHILDREN = "flatten(list_transform({}, lambda z: string_split(substr(z, 14), ',')))"
_LEAVES = "flatten(list_transform({}, lambda z: regexp_extract_all(substr(z, 14), '[0-9a-f]{{12}}')))"

OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, length(t) AS n_chars FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, n_chars - n_chars // 3) || left(nt, n_chars // 3) AS ed FROM n),
r AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_tree("t")} AS a, {_tree("ed")} AS b, {_tree("nt")} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_fingerprint("a")} AS fingerprint, {_fingerprint("b")} AS edited_fingerprint, {_fingerprint("c")} AS nf FROM r),
pairs AS (SELECT doc_id, 'e' AS k, fingerprint AS a, edited_fingerprint AS b FROM f UNION ALL SELECT doc_id, 'n', fingerprint, nf FROM f),
{_between("s", "pairs", _SECTIONS.format("a"), _SECTIONS.format("b"), "doc_id, k, a, b")},
{_between("p", "s", _CHILDREN.format("x"), _CHILDREN.format("y"), "doc_id, k, a, b, h AS section")},
{_between("l", "p", _LEAVES.format("x"), _LEAVES.format("y"), "doc_id, k, a, b, section, h AS paragraph, len(y) AS n")},
g AS (SELECT doc_id, k, left(a, 32) = left(b, 32) AS same, {_pieces("a")} AS na, {_pieces("b")} AS nb, section, paragraph, n, x, y FROM l),
o AS (SELECT doc_id, k, CASE WHEN same THEN 1.0 WHEN na + nb = 0 THEN 0.0 ELSE 2.0 * (na - len(x) + len(list_intersect(list_distinct(x), list_distinct(y)))) / (na + nb) END AS near,
CASE WHEN same THEN 0 ELSE section END AS section, CASE WHEN same THEN 0 ELSE paragraph END AS paragraph, CASE WHEN same THEN 0 ELSE n END AS n FROM g)
SELECT f.doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, o.near AS near_edited, o2.near AS near_next, o.section AS edited_section, o.paragraph AS edited_paragraph, o.n AS n_edited
FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = 'e' JOIN o o2 ON o2.doc_id = f.doc_id AND o2.k = 'n'"""

_BASE32 = "array_to_string(list_transform(range(8), lambda k: list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS BIGINT) + 1, 1)).array_to_string('')), '')"

OP9 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM h"""


#: CRC-32 by a table made from its polynomial, as SQL doesn't have it: crc.t, and of a text.
CRC = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS t)"""


def _crc(text: str) -> str:
    raw = f"hex(encode({text}))"
    data = f"list_transform(range(length({raw}) // 2), lambda k: CAST('0x' || substr({raw}, 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Near words by patterns: of one length with one letter left open, or the longer one without a letter.
OP12 = f"""WITH {CRC},
r0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
r1 AS (SELECT doc_id, {_LOWER.format("r")} AS r, count(*) AS n FROM r0 WHERE length(r) >= 6 GROUP BY ALL),
r2 AS (SELECT r, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM r1, crc),
r3 AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM r2),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r3 WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
p AS (SELECT word, n, i, left(word, i) || '?' || substr(word, i + 2) AS open, left(word, i) || substr(word, i + 2) AS less FROM cut),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.open = b.open AND a.word <> b.word
UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.less = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.less = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS k, min(other) FILTER (other_n = m) AS best FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 5 * w.n THEN best END AS form, CASE WHEN k >= 5 * w.n THEN k END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (WITH RECURSIVE u(word, top) AS (SELECT word, word FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.top WHERE f.form IS NOT NULL) SELECT * FROM u)
SELECT f.word, f.form, up.top AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f g ON g.word = up.top AND g.form IS NULL"""


def _leaf(text: str = "text") -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(name: str, leaves: str, tree: str, count: int) -> str:
    """CTEs name0 ... with the nodes of each level, (tree, i, n, h); a level without a row less than 16 nodes wide ends in one."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(count):
        out.append(f"{name}{k + 1} AS (SELECT {tree}, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {tree}, i // 16)")
        out.append(f"{name}g{k} AS (SELECT {tree} AS g, i // 16 AS run, max(n) AS n, list(h ORDER BY i) AS m FROM {name}{k} GROUP BY ALL)")
    return ", ".join(out)


def _climb(out: str, of: str, name: str, tree: str, at: str, count: int) -> str:
    """CTEs that take acc and sib of each row of a table up the levels of a tree, from place at."""
    steps = [of] + [f"{out}{k}" for k in range(1, count + 1)]
    body = []
    for k in range(count):
        place = f"({at} // {16**k}) % 16"
        left, right = f"array_to_string(m[1 : {place}], '')", f"array_to_string(m[{place} + 2 :], '')"
        body.append(f"{out}{k + 1} AS (SELECT s.* EXCLUDE (acc, sib), CASE WHEN n = 1 THEN acc ELSE sha256({left} || acc || {right}) END AS acc, CASE WHEN n = 1 THEN sib ELSE sib || {left} || {right} END AS sib FROM {steps[k]} s JOIN {name}g{k} ON g IS NOT DISTINCT FROM s.{tree} AND run = s.{at} // {16 ** (k + 1)})")
    return ", ".join(body)


# Four levels over 65536 rows of a source, three over 4096 sources.
OP13 = f"""WITH {CRC}, d AS (SELECT doc_id, source AS src, {_leaf()} AS h, CASE WHEN {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 AND doc_id IS NOT NULL THEN {_leaf(_LOWER.format("text"))} END AS changed FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS place FROM d),
{_levels("a", "SELECT src, place AS i, count(*) OVER (PARTITION BY src) AS n, h FROM l", "src", 4)},
subs AS (SELECT src, h, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS rank FROM a4),
{_levels("b", "SELECT 0 AS t, rank AS i, count(*) OVER () AS n, h FROM subs", "t", 3)},
s AS (SELECT doc_id, l.src, l.h AS leaf, place, subs.h AS subroot, rank, 0 AS t, coalesce(changed, l.h) AS acc, '' AS sib FROM l JOIN subs ON subs.src IS NOT DISTINCT FROM l.src),
{_climb("x", "s", "a", "src", "place", 4)}, {_climb("y", "x4", "b", "t", "rank", 3)}
SELECT doc_id, leaf, subroot, b3.h AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = b3.h AS verified FROM y3, b3"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": OP3, "op7_merkle": OP7, "op8_quality": OP8, "op9_warc": OP9, "op12_spelling": OP12, "op13_manifest": OP13}
