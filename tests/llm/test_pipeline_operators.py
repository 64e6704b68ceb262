"""The operators of the pipeline against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, quality, simhash, substrings
from lectern.llm.queries import byte_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# BPE


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_matches_the_library(spark, docs, rows, library):
    spec = byte_bpe()
    out = bpe.decode(bpe.encode(docs, spec), spec).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") == library.decode(r.ids, skip_special_tokens=False)
    got = bpe.digests(docs.withColumn("n_tokens", F.lit("clash")), spec).collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r.text or ""))


def test_bpe_on_odd_texts(library):
    own = bpe.Bpe(bpe.tables(byte_bpe()))
    rnd = np.random.default_rng(1)
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endof", "aaaa" * 3000, "\x00\x01\x1c\x1d\x1e\x1f\x85᠎​  x", "'s'LL 't it's", "  \n\n  a 　 b", "²½Ⅷ٣", "👩‍👩‍👧 ok", "abcdefghij" * 2000]
    texts += ["".join(chr(c) for c in rnd.choice([*range(32, 127), 9, 10, 0xE9, 0xA0, 0x4E00, 0x1F600], 200)) for _ in range(200)]
    texts += ["".join(rnd.choice(list("the ing of an re"), 300)) for _ in range(100)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == t


def test_suffix_automaton():
    """Every text inside of a string is found, nothing else, and a state's string is its longest."""
    import random

    rnd = random.Random(4)
    for _ in range(40):
        strings = list({bytes(rnd.choices(b"abc", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 12))})
        auto = bpe.Automaton()
        for s in strings:
            auto.add(s)
        inside = {s[i:j] for s in strings for i in range(len(s)) for j in range(i, len(s) + 1)}
        found = {b""}
        for x in sorted(inside, key=len):
            found.add(x)
            for c in b"abc":
                try:
                    auto.state(x + bytes([c]))
                    there = True
                except KeyError:
                    there = False
                assert there == (x + bytes([c]) in inside)
        assert found == inside
        for s in strings:
            assert auto.length[auto.state(s)] == len(s)
        for x in inside - {b""}:  # the link is the longest end with other ends
            places = lambda y: {(s, i) for s in strings for i in range(len(s)) if s[: i + 1].endswith(y)}
            ends = [x[k:] for k in range(1, len(x) + 1) if places(x[k:]) != places(x)] or [b""]
            assert auto.length[auto.link[auto.state(x)]] == len(ends[0])
        assert len(auto.next) <= 2 * sum(map(len, strings)) + 1


# Substrings


def brute_substrings(rows, window):
    """Results by (id, text): words, removed, kept."""
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    split = {r: WORD.findall(r[1] or "") for r in distinct}
    order = {r: r[0] if r[0] is not None else -1 for r in distinct}
    for r in distinct:
        for i in range(len(split[r]) - window + 1):
            first.setdefault(tuple(split[r][i : i + window]), (order[r], i, r))
            first[tuple(split[r][i : i + window])] = min(first[tuple(split[r][i : i + window])], (order[r], i, r), key=lambda x: x[:2])
    out = {}
    for r in distinct:
        w, gone = split[r], set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])][::2] != (order[r], r) or first[tuple(w[i : i + window])][1] < i:
                gone |= set(range(i, i + window))
        out[r] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def unambiguous(rows):
    """Without ids that have several texts, whose order is by a hash."""
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    return [r for r in rows if len(texts[r[0]]) == 1]


def substring_results(df):
    return Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_texts_without_id_that_share_a_short_hash(spark):
    """Two texts without an id whose 32-bit hashes are equal are two documents."""
    made = spark.range(400_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("".join(f" y{k}" for k in range(30)))).alias("text"))
    same = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").orderBy("h").first().t[:2]
    texts = [same[0], same[1]]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").coalesce(1)
    got = {r.text: r.n_removed for r in substrings.dedup_substrings(docs).collect()}
    assert len(set(texts)) == 2 and sorted(v > 0 for v in got.values()) == [False, True]


@pytest.mark.parametrize("hot", [False, True])
def test_substrings_match_brute_force(spark, rows, monkeypatch, hot):
    rows = unambiguous(rows)
    want = brute_substrings(rows, 20)
    if hot:  # all minimisers count as too common, so that all windows travel singly
        def every(found, docs, buckets, window, gram):
            keys = [substrings.super_kmers([(r[1] or "").encode().split()], window, gram)[2][3] for r in rows]
            return np.unique(np.concatenate(keys))

        monkeypatch.setattr(substrings, "_common", every)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = substring_results(substrings.dedup_substrings(df.withColumn("n_words", F.lit("clash"))))
    assert got == Counter((r[0], r[1], *want[r[0], r[1]]) for r in rows)
    assert any(r[3] for r in got)


def test_substrings_under_one_id(docs, no_docs, rows):
    out = substrings.dedup_substrings(docs).collect()
    assert len(out) == len(rows)
    assert all(r.n_words - r.n_removed == len(r.kept_text.split(" ")) for r in out if r.kept_text)
    assert substrings.dedup_substrings(no_docs).count() == 0


def test_substrings_random(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("ab", k=rnd.randint(0, 60)))) for i in range(60)]
    want = brute_substrings(rows, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert substring_results(substrings.dedup_substrings(df, 8, 3)) == Counter((*r, *want[r]) for r in rows)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and open_:
        share = rest / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        rest = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.remove(s)
    return target


def test_mixing(spark, docs, rows, no_docs):
    out = mixing.mixed(docs.withColumn("target", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in out:
        assert r["size"] == size(r.text) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in again) == Counter((r.doc_id, r.text, r.taken) for r in out)
    assert mixing.sample(docs).count() == sum(r.copies for r in out)
    assert mixing.mixed(no_docs).count() == 0


def brute_copies(sizes, target, most=3):
    """Copies by size of one source: the root by halving, then running sums along falling sizes rounded."""
    count = Counter(s for s in sizes if s)
    total = sum(s * n for s, n in count.items())
    if not total or not target:
        return {}
    rate = lambda m, s: min(float(most), math.exp(min(m * s, 50.0)))
    low, high = sorted((0.0, math.log(target / total)))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(n * s * rate(mid, s) for s, n in count.items()) > target else (mid, high)
    out, e, before = {}, 0.0, 0
    for s in sorted(count, reverse=True):
        e += count[s] * rate((low + high) / 2, s)
        now = math.floor(round(e, 5) + 0.5)
        out[s], before = now - before, now
    return out


def test_mixing_recomputed(spark, docs, rows):
    """Copies by source and size as plain Python has them, and the same documents at any partitioning."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(list)
    for r in rows:
        sizes[r[3]].append(size(r[1]))
    target = brute_targets({s: sum(x) for s, x in sizes.items()})
    want = {(s, k): n for s, x in sizes.items() for k, n in brute_copies(x, target[s]).items()}
    got, results = Counter(), []
    for parts in ("4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(Counter((r.doc_id, r.text, r.copies) for r in mixing.mixed(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    for r in mixing.mixed(docs).collect():
        if r["size"]:
            got[r.source, r["size"]] += r.copies
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


def test_mixing_tilts_documents(spark):
    """A source that shrinks loses long documents first, one that grows repeats them first."""
    texts = [("a", 10), ("a", 1000)] * 200 + [("b", 10), ("b", 1000)] * 150
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(texts)], "doc_id long, text string, source string")
    rate = {(r.source, r["size"]): r.c for r in mixing.mixed(docs, weights=(1, 1)).groupBy("source", "size").agg(F.avg("copies").alias("c")).collect()}
    assert rate["a", 1000] < 1 and rate["a", 10] > 0.9 and 1.1 < rate["b", 1000] < 1.2 and rate["b", 10] < 1.05


def test_targets_reshare_the_excess(spark):
    for sizes in ({"a": 1, "b": 10, "c": 1000, None: 5}, {"a": 10}, {"a": 0, "b": 7}, {"a": 5, "b": 1, "c": 1, "d": 1, "e": 900}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)


# Quality


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, no_docs):
    out = quality.scores(docs.withColumn("kept", F.lit("clash"))).collect()
    texts = Counter((r[0], r[3], *brute_quality(r[1])) for r in rows)
    assert Counter((r.doc_id, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == texts
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    hosts = defaultdict(list)
    for r in out:
        hosts[r.source].append(r.base_failed)
    n = len(out)
    m = sum(r.base_failed for r in out) / n
    v = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - m * m
    k = 1e4 if v <= m * (1 - m) / 10001 else max(1.0, m * (1 - m) / v - 1)
    for r in out:
        rate = (sum(hosts[r.source]) + m * k) / (len(hosts[r.source]) + k)
        assert math.isclose(r.host_rate, rate, rel_tol=1e-9)
        assert r.kept == (not r.base_failed and rate <= 0.5)
    assert quality.keep(docs).count() == sum(r.kept for r in out)
    assert quality.keep(docs).columns == docs.columns
    assert quality.scores(no_docs).count() == 0


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(i, good if i % 10 else bad, f"h{i % 3}") for i in range(300)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(100)]
    out = quality.scores(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source for r in out if r.host_rejected} == {"spam"}
    assert not any(r.kept for r in out if r.source == "spam")
    assert all(r.kept == (r.n_words == 40) for r in out if r.source != "spam")


# SimHash


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    fps = list(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, docs, rows, no_docs):
    out = simhash.near_duplicates(docs).collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    of = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == Counter((i, f"{f:016x}", least.get(of[f])) for i, f in fps)
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_similar(texts, shingle=5, similarity=0.8):
    """Group of each different text: linked where shingle sets have the Jaccard similarity or more, all pairs compared."""
    grams = {}
    for t in set(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams[t] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)}
    group = {t: t for t in grams}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    ordered = sorted(grams, key=lambda t: t or "")
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            both = len(grams[a] & grams[b])
            if both >= similarity * (len(grams[a]) + len(grams[b]) - both):
                group[find(a)] = find(b)
    return {t: find(t) for t in grams}


def brute_heads(rows):
    """Ids (None where a group has none) of the first document of each group of similar texts; rows of (doc_id, text)."""
    of = brute_similar([t for _, t in rows])
    heads = {}
    for i, t in rows:
        heads.setdefault(of[t], []).append(i)
    return Counter(min((i for i in ids if i is not None), default=None) for ids in heads.values())


def test_keep_one(spark, docs, rows, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert set(map(tuple, kept)) <= set(rows)
    found, want = Counter(r.doc_id for r in kept), brute_heads([r[:2] for r in rows])
    assert not want - found  # nothing goes that is not similar to what stays
    removable = len(rows) - want.total()
    assert found.total() - want.total() <= removable / 10  # fingerprints of words find nearly all that goes
    assert simhash.keep_one(no_docs).count() == 0


def test_similar_is_exact(spark, docs, rows):
    texts = docs.select(F.xxhash64("text").alias("n"), "text").dropDuplicates(["n"])
    pairs = texts.select(F.col("n").alias("l")).crossJoin(texts.select("n")).filter("l < n")  # a small fixture: all pairs
    found = {tuple(r) for r in simhash.similar(pairs, texts).collect()}
    of = {r.n: r.text for r in texts.collect()}
    grams = {}
    for n, t in of.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    assert found == {(a, b) for a in of for b in of if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}


def test_keep_one_with_hot_groups(spark):
    """Copies, light edits of one text, and texts of the same words in another order, which are not similar."""
    import random

    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(4000)]
    base = rnd.choices(vocab, k=300)
    texts = [" ".join(base)] * 700
    for _ in range(300):
        edited = list(base)
        for at in rnd.sample(range(300), rnd.randint(1, 2)):
            edited[at] = rnd.choice(vocab)
        texts.append(" ".join(edited))
    texts += [" ".join(rnd.sample(base, 300)) for _ in range(20)]
    texts += [" ".join(rnd.choices(vocab, k=120)) for _ in range(100)]
    found = list(enumerate(texts))
    rnd.shuffle(found)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in found], "doc_id long, text string, n string, _lt_n long").repartition(5)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == brute_heads(found)


def test_keep_one_with_templates(spark):
    """Texts made from one another by 3 to 5 new words: few pairs of a template are similar, most similar ones are of inner members."""
    import random

    rnd = random.Random(13)
    vocab = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(3):
        base = rnd.choices(vocab, k=200)
        for _ in range(150):
            edited = list(base)
            for at in rnd.sample(range(200), rnd.randint(3, 5)):
                edited[at] = rnd.choice(vocab)
            texts.append(" ".join(edited))
    found = list(enumerate(texts))
    kept, want = Counter(r.doc_id for r in simhash.keep_one(spark.createDataFrame(found, "doc_id long, text string").repartition(5)).collect()), brute_heads(found)
    removable = len(texts) - want.total()
    assert not want - kept and removable > 50
    assert kept.total() - want.total() <= 0.05 * removable


def test_remaining_pairs_against_all_pairs(spark):
    """Once each: pairs of different classes with a part in which two bits differ at most, and few bits overall."""
    import random

    rnd = random.Random(3)
    base = [[rnd.getrandbits(20) for _ in range(3)] for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [x ^ sum(1 << b for b in rnd.sample(range(20), rnd.choice([0, 0, 1, 2, 3]))) for x in rnd.choice(base)]
        rows.append((k, parts, rnd.randrange(40)))
    got = [tuple(r) for r in simhash.remaining(spark.createDataFrame(rows, "_lt_text long, _lt_parts array<long>, _lt_class long"), 20, 3, 0.1).collect()]
    apart = lambda a, b: [bin(x ^ y).count("1") for x, y in zip(a, b)]
    want = {(a, b) for a, p, c in rows for b, q, d in rows if a < b and c != d and min(apart(p, q)) <= 2 and sum(apart(p, q)) <= 6}
    assert len(got) == len(set(got)) and set(got) == want


def test_leaders_are_those_of_all_balls(spark):
    """Candidates against the definition: ends of a value with its texts, and with the least text of the ends of each of its balls."""
    import random

    rnd = random.Random(7)
    texts = []
    for k in range(60):
        v = [rnd.getrandbits(6), rnd.getrandbits(40)]
        texts += [(10 * k + j, [x ^ (1 << rnd.randrange(42) if rnd.random() < 0.6 else 0) for x in v]) for j in range(rnd.randint(1, 5))]
    want = set()
    for p in (0, 1):
        nodes = defaultdict(list)
        for n, v in texts:
            nodes[v[p]].append(n)
        balls = defaultdict(set)
        for v in nodes:
            for m in [0] + [1 << b for b in range(42)]:
                balls[v ^ m].add(v)
        for ball in balls.values():
            for v in ball:
                for end in (min(ball), max(ball)):
                    want |= {(min(nodes[end]), f(nodes[v])) for f in (min, max) if end != v}
        want |= {(f(same), n) for same in nodes.values() for f in (min, max) for n in same}
    want = {(l, n) for l, n in want if l != n}
    found = simhash.candidates(spark.createDataFrame(texts, "_lt_text long, _lt_parts array<long>"), 42)
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_links_and_components_on_random_balls(spark):
    import random

    rnd = random.Random(2)
    fps = set()
    for _ in range(30):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            fps.add(f)
            for _ in range(rnd.randint(0, 3)):
                f ^= 1 << rnd.randrange(64)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "_lt_fp long"))
    found = {signed[r.n]: signed[r.l] for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == g) for g in {m.get(f, f) for f in fps}}
    assert groups(found) == groups(want)


def test_keep_one_compares_a_large_group_in_proportion(spark, monkeypatch):
    """A text's light edits, and as many heavier ones that are similar to few others: compared by their middle and by bounds, not pair by pair."""
    import random

    rnd = random.Random(17)
    vocab = [f"w{k}" for k in range(20000)]
    base = rnd.choices(vocab, k=200)
    texts = [" ".join(base)]
    for k in range(600):
        edited = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 4) if k % 2 else rnd.randint(5, 8)):
            edited[at] = rnd.choice(vocab)
        texts.append(" ".join(edited))
    found, compared, similar = list(enumerate(texts)), [], simhash.similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "similar", counted)
    kept = Counter(r.doc_id for r in simhash.keep_one(spark.createDataFrame(found, "doc_id long, text string").repartition(5)).collect())
    assert kept == brute_heads(found)
    assert sum(compared[1:]) <= 20 * len(texts)  # after the first step, which compares with ends only


def test_keep_one_meets_the_same_few_leaders_first(spark, monkeypatch):
    """Each text of a large group lies in many balls, but meets three leaders at most before it is known what they join."""
    import random

    rnd = random.Random(23)
    vocab = [f"w{k}" for k in range(20000)]
    texts = []
    for _ in range(2):
        base = rnd.choices(vocab, k=150)
        for k in range(200):
            edited = list(base)
            for at in rnd.sample(range(150), rnd.randint(1, 2) if k % 2 else rnd.randint(2, 6)):
                edited[at] = rnd.choice(vocab)
            texts.append(" ".join(edited))
    found, compared, similar = list(enumerate(texts)), [], simhash.similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "similar", counted)
    kept = Counter(r.doc_id for r in simhash.keep_one(spark.createDataFrame(found, "doc_id long, text string").repartition(5)).collect())
    assert kept == brute_heads(found)
    assert len(compared) == 3 and compared[0] <= 3 * len(texts)


def test_leading_takes_those_that_lead_most(spark):
    pairs = [(1, 10), (2, 10), (3, 10), (2, 11), (3, 11), (3, 12), (4, 13)]
    found = simhash.leading(spark.createDataFrame(pairs, "l long, n long"), 2)
    assert Counter(map(tuple, found.collect())) == Counter([(3, 10), (2, 10), (3, 11), (2, 11), (3, 12), (4, 13)])


def test_bounded_loses_no_similar_pair(spark):
    """Groups of edited, cut and lengthened texts in one ball, each a class of its own, rare shingles in two texts at most."""
    import random

    rnd = random.Random(19)
    vocab, texts = [f"w{k}" for k in range(3000)], []
    for _ in range(4):
        base = rnd.choices(vocab, k=120)
        for _ in range(25):
            edited = base[rnd.randrange(12) : 120 - rnd.randrange(12)] + rnd.choices(vocab, k=rnd.randrange(8))
            for at in rnd.sample(range(len(edited)), rnd.randint(0, 4)):
                edited[at] = rnd.choice(vocab)
            texts.append(" ".join(edited))
    texts += ["", "one", "two words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    known = simhash.profiles(rows, largest=2)
    some = rows.select("n", F.col("n").alias("c"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("ball"))
    found = [frozenset(r) for r in simhash.bounded(some, known).collect()]
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) or {tuple(t.split())} for t in texts]
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert len(want) > 50 and want <= set(found)
    assert len(set(found)) < len(texts) ** 2 / 4
    assert not simhash.bounded(some.withColumn("c", F.lit(1)), known).count()  # one class: nothing to compare


def shingled(texts):
    return [set(zip(*(t.split()[k:] for k in range(5)))) or {tuple(t.split())} for t in texts]


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_bounded_meets_few_of_a_group_without_similar_members(spark):
    """Three new words each in one text, which itself isn't there: nearly all is common, yet few are similar."""
    import random

    rnd = random.Random(29)
    vocab = [f"w{k}" for k in range(20000)]
    base, texts = rnd.choices(vocab, k=150), []
    for _ in range(300):
        edited = list(base)
        for at in rnd.sample(range(150), 3):
            edited[at] = rnd.choice(vocab)
        texts.append(" ".join(edited))
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    some = rows.select("n", F.col("n").alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("p"), F.lit(0).cast("long").alias("ball"))
    found = Counter(frozenset(r) for r in simhash.bounded(some, simhash.profiles(rows)).collect())
    grams = shingled(texts)
    want = {frozenset((i, j)) for i in range(300) for j in range(i) if alike(grams[i], grams[j])}
    assert want <= set(found) and max(found.values(), default=1) == 1
    assert len(found) <= len(want) + 4 * len(texts)


def odd_groups(rnd):
    """Texts (n, text) and their balls: edits of several texts, alone and on top of frequent edits, cut, and dealt to balls that groups share."""
    vocab, texts, balls = [f"w{k}" for k in range(3000)], [], []
    for k, words in enumerate((60, 110, 110, 180)):
        base = rnd.choices(vocab, k=words)
        frequent = [(at, rnd.choice(vocab)) for at in rnd.sample(range(words), 3)]
        for _ in range(40):
            edited = list(base)
            for at, w in frequent:
                if rnd.random() < 0.4:
                    edited[at] = w
            for at in rnd.sample(range(words), rnd.randint(0, 3)):
                edited[at] = rnd.choice(vocab)
            texts.append(" ".join(edited[rnd.randrange(3) : words - rnd.randrange(3)]))
            balls.append({rnd.randrange(3) + 2 * k for _ in range(rnd.randint(1, 3))} | ({50} if rnd.random() < 0.2 else set()))
    return texts, balls


@pytest.mark.parametrize("classes", [1000, 12])
def test_bounded_loses_no_pair_of_groups_that_share_balls(spark, classes):
    import random

    rnd = random.Random(31)
    texts, balls = odd_groups(rnd)
    of = list(range(len(texts))) if classes > len(texts) else [rnd.randrange(classes) for _ in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    some = spark.createDataFrame([(n, of[n], 0, b) for n, there in enumerate(balls) for b in sorted(there)], "n long, c long, p int, ball long")
    grams = shingled(texts)
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if of[i] != of[j] and balls[i] & balls[j] and alike(grams[i], grams[j])}
    for largest in (2, 8):
        found = {frozenset(r) for r in simhash.bounded(some, simhash.profiles(rows, largest=largest)).collect()}
        assert len(want) > 50 and want <= found
        assert all(of[i] != of[j] for i, j in found)


def test_certain_pairs_stand_for_all_of_their_kind(spark):
    """They are similar; with the classes that they give, what is left to meet links what all pairs do."""
    import random

    texts, balls = odd_groups(random.Random(37))
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    placed = spark.createDataFrame([(n, 0, b) for n, there in enumerate(balls) for b in sorted(there)], "n long, p int, ball long")
    known, grams = simhash.profiles(rows, largest=4), shingled(texts)

    def held(of):
        own = spark.createDataFrame(list(enumerate(of)), "n long, c long")
        return simhash.gathered(placed.join(own, "n"), "c")

    def classes(pairs):
        of = list(range(len(texts)))
        for i, j in pairs:
            a, b = sorted((of[i], of[j]))
            of = [a if c == b else c for c in of]
        return of

    apart = simhash.stored(simhash.differences(held(range(len(texts))), known), "apart")
    sure = [tuple(r) for r in simhash.certain(apart).collect()]
    assert len(sure) > 10 and all(alike(grams[i], grams[j]) for i, j in sure)
    rest = [tuple(r) for r in simhash.within_bounds(held(classes(sure)), known, apart).collect()]
    got = classes(sure + [(i, j) for i, j in rest if alike(grams[i], grams[j])])
    want = classes([(i, j) for i in range(len(texts)) for j in range(i) if balls[i] & balls[j] and alike(grams[i], grams[j])])
    assert all(len({got[n] for n in range(len(texts)) if want[n] == c}) == 1 for c in set(want))


def test_fingerprints_grow_with_the_rows():
    assert simhash.sizes(0) == simhash.sizes(1 << 16) == (6, 30)
    assert simhash.sizes(230_000) == (7, 32) and simhash.sizes(10**8) == (10, 41)
    per_row = [n * n * (1 + b + b * (b - 1) / 2) * parts / 2**b / n for n in (10**5, 10**6, 10**7, 10**8) for parts, b in [simhash.sizes(n)]]
    assert max(per_row) < 8 * min(per_row)  # chance meetings a row, for a thousand times the rows


def test_packed_ids_and_a_worker_s_encoder(spark, docs, rows):
    """Ids as bytes; the tasks of a worker share one encoder, made from the broadcast tables."""
    from array import array

    spec = byte_bpe()
    own = bpe.Bpe(bpe.tables(spec))
    for _, text, *_ in rows[:40]:
        assert own.packed(text) == array("I", own.encode(text)).tobytes()
    assert all(isinstance(ids, bytes) for ids in own.kept.values())  # nothing for garbage collection to follow
