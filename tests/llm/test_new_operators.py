"""Spelling variants, manifests and personal data against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest, pii, spelling, tagger
from lectern.llm import queries as Q


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def clashing(docs):
    """docs with columns named like those that operators add."""
    return docs.withColumns({c: F.lit("clash") for c in ("word", "n", "form", "root", "leaf", "subroot", "length", "band", "spans", "at")})


# Spelling variants


def edits(w, letters):
    """All strings one edit away from w."""
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def brute_words(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(words):
    letters = sorted({c for w in words for c in w})
    near = {w: [v for v in edits(w, letters) if v in words and v != w] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling(spark, docs, rows):
    import random

    rnd = random.Random(3)
    bases = ["".join(rnd.choices("abcdeéßÀ÷×ÿ", k=rnd.randint(6, 9))) for _ in range(40)]
    more = []
    for k, b in enumerate(bases):
        for j in range(30):
            at = rnd.randrange(len(b))
            word = rnd.choice([b, b.upper(), b[:at] + b[at + 1 :], b[:at] + "a" + b[at:], b[:at] + "z" + b[at + 1 :]])
            more.append((1000 + k * 30 + j, f"{word}, {word}! {word}\n{word} {b} {b} {b}", None, "s", 1))
    more += [(5000, "chains " * 700 + "chainz " * 120 + "chainzz " * 20 + "chainzzy " * 5, None, None, None), (5001, "long " * 5 + "sameword" * 4000, "en", "s", 1)]
    all_rows = [*rows, *more]
    df = spark.createDataFrame(all_rows, docs.schema)
    got = [tuple(r) for r in spelling.spelling_variants(clashing(df)).collect()]
    want = brute_variants(brute_words(all_rows))
    assert len(got) == len(set(got)) and set(got) == want
    roots = {g[0]: g[1:3] for g in got}
    assert roots["chainz"] == ("chains", "chains") and roots["chainzz"] == ("chainz", "chains")


def test_spelling_splits_hot_buckets(spark):
    """Words of one length and equal bands, more than a task's fair part."""
    words = ["".join(p) + "abc" for p in itertools.permutations("defghij", 6)][:1500]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_pairs(df).collect()}
    letters = sorted(set("".join(words)))
    known = set(words)
    assert got == {(a, b) for a in words for b in edits(a, letters) if b in known and a < b}


def test_spelling_without_words(spark, no_docs):
    assert spelling.spelling_variants(no_docs).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], no_docs.schema)).collect() == []


# Manifest


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of all rows, with whole trees in memory."""
    h = lambda *x: sha("".join(x))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i // 16 * 16
            out.append((nodes[run:i], nodes[i + 1 : run + 16]))
            i //= 16
        return out

    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda t: h(*map(field, (i, source, lang, n, t)))
        low = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        changed = leaf(low) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        by[source].append(((i is not None, i or 0), leaf(text), changed, i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for j, (_, leaf, changed, i) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            steps = path(trees[s], j) + path(top, k)
            acc = changed or leaf
            for left, right in steps:
                acc = h(*left, acc, *right)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h(*(x for st in steps for side in st for x in side)), acc, acc == top[-1][0]))
    return out


def verified(docs):
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return manifest.verified(docs, changed, [F.translate("text", spelling.UPPER, spelling.LOWER) if c == "text" else F.col(c) for c in manifest.COLUMNS])


def plain(found):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect())


def test_manifest(spark, docs, rows):
    assert plain(verified(clashing(docs))) == Counter(brute_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 300])
def test_manifest_of_one_source(spark, docs, n):
    """Full and short runs, a node alone in its run, a lone leaf; a very long text."""
    rows = [(i, f"Text {i}" if i else "A b " * 300_000, None, "s", i) for i in range(n)]
    assert plain(verified(spark.createDataFrame(rows, docs.schema).repartition(3))) == Counter(brute_manifest(rows))


def test_manifest_of_many_sources(spark, docs):
    rows = [(i, f"Text {i}", None, None if i % 300 == 299 else f"s{i % 300}", i) for i in range(700)] + [(9000 + i, "Hot", None, "s7", 1) for i in range(900)]
    assert plain(verified(spark.createDataFrame(rows, docs.schema))) == Counter(brute_manifest(rows))


def test_manifest_of_nothing(spark, no_docs):
    assert verified(no_docs).collect() == []


def test_manifest_finds_any_change(spark, docs):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(100)]
    df = spark.createDataFrame(rows, docs.schema)
    for column, other in (("doc_id", F.col("doc_id") + 1), ("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)):
        found = manifest.verified(df, F.col("doc_id") == 40, [other if c == column else F.col(c) for c in manifest.COLUMNS])
        assert {r.doc_id for r in found.where("not verified").collect()} == {40}


# Personal data


def brute_base(text):
    """Spans of the rules by plain patterns."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda n: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n))) % 10 == 0
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    for kind, (pattern, good) in checks.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out


def test_rules():
    rnd = np.random.default_rng(2)
    pieces = ["a", "b.c", "@", "@x.y", ".", "..", "1", "25", "256", "1.2.3.4", "+", "+1 ", "(40) ", "-", " ", "4111 1111 1111 1111", "4111", "\n", "é", "%", "_", "com", "0000000000000", "３"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces, rnd.integers(1, 14)))
        assert [(pii.KINDS[k], a, e) for k, a, e in pii.base(text)] == brute_base(text), text
    long = "a" * 200_000 + " " + "7" * 200_000 + " " + "+1" + " " * 200_000 + "a@b.c"  # in time that grows with the text
    assert [s[0] for s in pii.base(long)] == [0]


def test_gradients():
    rnd = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.new(2, 3, 1).items()}
    ids = rnd.integers(60, 70, (7, 4)).astype(np.uint16)
    ids[5:, 1] = tagger.PAD
    labels = np.zeros((7, 4), int)
    labels[2:4, 0], labels[1:3, 2], labels[6, 3] = [1, 2], [3, 4], 3
    args = ids, labels, ids != tagger.PAD
    _, g = tagger.gradients(p, *args)
    for k in p:
        for _ in range(5):
            i = tuple(rnd.integers(0, s) for s in p[k].shape) if k not in ("fx", "bx") else (ids[rnd.integers(5), rnd.integers(4)], rnd.integers(12))
            if p[k][i] < -1000:
                continue
            was, step = p[k][i], 1e-5
            p[k][i] = was + step
            above = tagger.gradients(p, *args)[0]
            p[k][i] = was - step
            below = tagger.gradients(p, *args)[0]
            p[k][i] = was
            assert abs((above - below) / (2 * step) - g[k][i]) < 1e-4, (k, i)


def test_decoding_and_what_is_skipped():
    """The best of all paths; windows that are skipped have no span on theirs."""
    rnd = np.random.default_rng(1)
    skipped = 0
    for seed in range(60):
        p = tagger.new(2, 4, seed)
        for k in ("bo", "step", "start", "end"):
            p[k] += rnd.normal(0, 1, p[k].shape).astype(np.float32)
        p["bo"][0] += rnd.uniform(0, 6)
        tagger.closed(p)
        ids = rnd.integers(60, 70, (5, 8)).astype(np.uint16)
        f, b = tagger.hidden(p, ids)
        e = tagger.scores(p, f, b)
        labels = tagger.decoded(p, e)
        out = tagger.outside(p, f, b)
        skipped += out.sum()
        assert not labels[:, out].any()
        for col in range(3):
            def total(path):
                return p["start"][path[0]] + p["end"][path[-1]] + sum(e[s, col, k] for s, k in enumerate(path)) + sum(p["step"][x, y] for x, y in zip(path, path[1:]))
            best = max(map(total, itertools.product(range(5), repeat=5)))
            assert abs(total(labels[:, col]) - best) < 1e-3 * max(1, abs(best))
    assert 0 < skipped < 480


def test_padding_changes_nothing():
    p = tagger.new(4, 6, 3)
    ids = np.random.default_rng(3).integers(40, 120, (30, 2)).astype(np.uint16)
    ids[20:, 1] = tagger.PAD
    f, b = tagger.hidden(p, ids)
    f1, b1 = tagger.hidden(p, ids[:20, 1:])
    assert np.allclose(f[:20, 1:], f1, atol=1e-5) and np.allclose(b[:20, 1:], b1, atol=1e-5)


def test_reconciling():
    text = "x" * 1000
    # A span cut by windows' ends is put together, of two that overlap the better one stays, rules' spans win.
    found = [(0, 100, 160, 9.0, True), (0, 150, 200, 8.0, True), (1, 300, 310, 5.0, False), (2, 305, 320, 7.0, False), (3, 400, 410, 9.0, False), (3, 600, 610, 0.5, False)]
    kept, pii.plausible = pii.plausible, lambda *_: True
    try:
        assert pii.reconciled(text, [(0, 405, 408)], found) == [(0, 100, 200), (2, 305, 320)]
    finally:
        pii.plausible = kept


@pytest.fixture(scope="module")
def model(spark, sf):
    return pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_tagger_on_texts_it_has_not_seen(spark, sf, model):
    rnd = np.random.default_rng(99)
    plain = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text not rlike '[0-9@]' and length(text) > 300").orderBy("doc_id").limit(40).collect()]
    assert sum(len(added) for _, added in pii.found_in(plain, model)) == 0  # clean texts are left alone
    known = right = other = 0
    for kind in range(4):
        for k in range(60):
            value = pii.altered(rnd, kind, pii.made_up(rnd, kind))
            text = plain[k % len(plain)][:150] + " " + value + " " + plain[k % len(plain)][150:300]
            a, e = len(plain[k % len(plain)][:150]) + 1, len(plain[k % len(plain)][:150]) + 1 + len(value)
            (rules, added), = pii.found_in([text], model)
            known += any(s < e and t > a for _, s, t in rules)
            right += any(k == kind and s < e and t > a for k, s, t in added)
            other += any(t <= a or s >= e for _, s, t in added)
    assert right >= 0.5 * (240 - known) and other <= 5, (known, right, other)


def test_detection_on_hard_rows(spark, docs, rows, model):
    long = ("word " * 300_000) + "me@site.example.org " + "word " * 10
    more = [(700, long, None, None, None), (701, "mail me@site.example.org or\n+1 (407) 555-7710, 10.0.0.1", "en", "s", 1), (702, "4111111111111111 4111111111111112", None, "s", 1)]
    df = spark.createDataFrame([*rows, *more], docs.schema)
    got = clashing(df).withColumn("base", F.lit("clash"))
    found = pii.detect(got, model).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in found) == Counter((i, tuple(brute_base(t or ""))) for i, t, *_ in [*rows, *more])
    for r in found:
        for s in r.added:
            assert s.start < s.end and not any(b.start < s.end and b.end > s.start for b in r.base)


def test_detection_without_texts(spark, no_docs):
    assert pii.fit(no_docs) is None
    assert pii.detect(no_docs, None).collect() == []
    assert [r.base for r in pii.detect(spark.createDataFrame([(1, None, None, None, None), (2, "10.0.0.1", None, None, None)], no_docs.schema), None).collect()] == [[], [("ip", 0, 8)]]


def test_query_renders_spans(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op11_pii(spark, sf).collect():
        base = brute_base(texts[r.doc_id])
        line = lambda spans: ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
        assert r.base_sha256 == sha(line(base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        spans = [(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(base) <= set(spans) and len(spans) == len(base) + r.n_added


def test_states_are_those_of_training():
    """The layout in use gives what the layout of training does, to the last bit or nearly."""
    p = tagger.new(4, 12, 5)
    ids = np.random.default_rng(4).integers(40, 120, (50, 33)).astype(np.uint16)
    ids[30:, 3] = tagger.PAD
    for side, f in zip("fb", tagger.hidden(p, ids)):
        at = slice(None, None, 1 if side == "f" else -1)
        assert np.allclose(tagger._run(p[side + "x"], p[side + "h"], ids[at])[at], f, atol=1e-6)
        assert f.transpose(0, 2, 1)[0].flags.c_contiguous  # a gate's rows are side by side


def test_bound_is_the_nth_least_hash(spark, docs):
    hashes = sorted({r.h for r in docs.where(F.col("text").rlike("@|[0-9]{3}")).select(F.xxhash64("text").alias("h")).collect()})
    many = spark.range(3000).select(F.concat(F.lit("id "), F.col("id") + 100).alias("text"))
    of = sorted(r.h for r in many.select(F.xxhash64("text").alias("h")).collect())
    assert pii.bound(docs, 10**6) == (hashes[-1] if hashes else None)
    assert [pii.bound(many, n) for n in (1, 20, 2000, 5000)] == [of[0], of[19], of[1999], of[-1]]
    assert pii.bound(many.where("false"), 5) is None
