"""Language, sharding, language model, Merkle and WARC operators against plain Python, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import language, lm, merkle, sharding, warc
from lectern.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Language


def test_language_on_held_out_texts(spark, sf):
    out = queries()["op1_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_with_many_copies(spark):
    """One text that fills nearly all rows of a language leaves its other texts in the sample."""
    text = F.when(F.col("id") < 20, F.concat(F.lit("wort nummer "), F.col("id").cast("string"), F.lit(" "), F.substring(F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop"), 1, 30))).otherwise("immer das gleiche")
    model = language.fit(spark.range(100_000).select(text.alias("text"), F.lit("de").alias("lang")))
    assert model.languages.count("de") == language.CENTROIDS


def plain_vector(text, idf):
    """Normalised TF-IDF of a text by n-gram, as a dictionary from hashed feature to weight."""
    mask = 2**64 - 1
    clean = " " + "".join(c if c.isalpha() or unicodedata.category(c).startswith("M") else " " for c in text.lower()) + " "
    clean = re.sub(" +", " ", clean)
    found = Counter()
    for n in language.GRAMS:
        for i in range(len(clean) - n + 1):
            h = n
            for c in clean[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 32
            found[h % language.FEATURES] += 1
    v = {k: (1 + math.log(c)) * float(idf[k]) for k, c in found.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()}


def test_language_matches_plain_nearest_centroids(spark, sf):
    """The model's own centroids, searched one by one with plain dictionaries, and its centroids from plain k-means steps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    assert len(model.languages) == len(set(model.languages)) * language.CENTROIDS
    rows = [r for r in language.identify(docs, model).collect() if language.has_letter(r.text)]
    mean = defaultdict(lambda: defaultdict(float))
    of = Counter()
    for r in rows[:60]:
        v = plain_vector(r.text, model.idf)
        likeness = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(likeness)
        assert math.isclose(r.score, best, rel_tol=1e-4)
        assert r.nearest in {x for x, y in zip(model.languages, likeness) if y >= best - 1e-6}
        assert r.rejected == (r.score < model.least)
    for r in rows:  # every text lies with the centroid that is the mean of its kind
        v = plain_vector(r.text, model.idf)
        k = max(range(len(model.centroids)), key=lambda j: sum(x * float(model.centroids[j][i]) for i, x in v.items()))
        of[k] += 1
        for i, x in v.items():
            mean[k][i] += x
    for k, total in mean.items():
        size = math.sqrt(sum(x * x for x in total.values()))
        assert sum(x / size * float(model.centroids[k][i]) for i, x in total.items()) > 0.97


def test_no_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_TEXTS", 20)
    monkeypatch.setattr(language, "MODEL_CENTROIDS", 20)
    rows = [("".join(chr(97 + (k * 7 + j * j) % 26) for j in range(12)) + f" {'abcdefgh'[i]}", f"l{k:02d}") for k in range(30) for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == [f"l{k:02d}" for k in range(30)]


def test_language_edges(spark, sf, docs, no_docs, rows):
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    out = language.identify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.nearest == "und") == (not any(c.isalpha() for c in r.text or ""))
    odd = spark.createDataFrame([(1, "Это совсем другой язык и другое письмо"), (2, "12345 !!"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert found[1].rejected and found[1].lang_pred == "und" and found[1].nearest != "und"
    assert found[2].lang_pred == found[3].lang_pred == "und" and found[3].score == 0
    assert language.identify(no_docs, model).count() == 0
    empty = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_language_counts_cover_whole_texts(monkeypatch):
    text = "abc déf " * 400
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 100)
    assert (language.counts(text) == whole).all()


# Sharding


def heap_schedule(groups, shards):
    heap, out = [(0, j) for j in range(shards)], []
    for size in sorted(groups, reverse=True):
        load, j = heapq.heappop(heap)
        out.append((size, j))
        heapq.heappush(heap, (load + size, j))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_schedule_is_the_heaps(seed):
    import random

    rnd = random.Random(seed)
    groups = [rnd.choice([1, 2, 3, rnd.randint(1, 50), rnd.randint(1, 2000)]) for _ in range(rnd.randint(0, 400))]
    shards = rnd.choice([1, 2, 3, 8])
    got = []
    for size, turns in sharding.schedule(sorted(Counter(groups).items(), reverse=True), shards):
        for r in range(Counter(groups)[size]):
            first, turn = [t for t in turns if t[0] <= r][-1]
            got.append((size, turn[(r - first) % len(turn)]))
    assert got == heap_schedule(groups, shards)


def test_sharding(docs, rows, no_docs):
    out = sharding.sharded(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r[0], size(r[1]), crc(r[1])) for r in rows)
    slots, place, loads = defaultdict(list), {}, Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        assert place.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in rows:
        groups[r[1] or ""] += size(r[1])
    want = Counter()
    for s, j in heap_schedule(groups.values(), 8):
        want[j] += s
    assert loads == want
    assert sharding.sharded(no_docs).count() == 0


# Language model


def lm_tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def counted(rows, keep):
    """Counts of words, pairs and contexts of the documents that keep lets in."""
    c1, c2, ctx = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if keep(i):
            w = lm_tokens(t)
            c1.update(w)
            c2.update(zip(["<s>", *w[:-1]], w))
            ctx.update(["<s>", *w[:-1]])
    return c1, c2, ctx


def plain_em(rows, fold):
    """Weights by EM over every single held-out token."""
    c1, c2, ctx = counted(rows, lambda i: fold(i) not in (2, 5))
    n, v = sum(c1.values()), len(c1)
    held = defaultdict(list)
    for i, t, *_ in rows:
        if fold(i) == 5:
            w = lm_tokens(t)
            for before, x in zip(["<s>", *w[:-1]], w):
                held[ctx[before].bit_length()].append((c2[before, x] / ctx[before] if ctx[before] else 0.0, c1[x] / n, 1 / (v + 1)))
    weights = {}
    for b, ps in held.items():
        w = [1 / 3] * 3 if b else [0.0, 0.5, 0.5]
        for _ in range(lm.ROUNDS):
            sums = [0.0] * 3
            for p in ps:
                parts = [x * y for x, y in zip(w, p)]
                for k in range(3):
                    sums[k] += parts[k] / sum(parts)
            w = [max(s / len(ps), 1e-6 * (b > 0 or k > 0)) for k, s in enumerate(sums)]
            w = [x / sum(w) for x in w]
        weights[b] = w
    return weights


@pytest.mark.parametrize("bucket_bytes, dense", [(16 << 20, 256), (16 << 20, 1), (50, 256)])
def test_language_model(spark, docs, rows, no_docs, monkeypatch, bucket_bytes, dense):
    monkeypatch.setattr(lm, "CELL_BYTES", 3000)  # several cells
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(lm, "DENSE", dense)
    monkeypatch.setattr(lm, "SETTLED", 0.0)
    out, weights = lm.scored(docs)
    out = out.collect()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    for b, w in plain_em(rows, fold).items():
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(weights[b], w))
    c1, c2, ctx = counted(rows, lambda i: fold(i) != 2)
    n, v = sum(c1.values()), len(c1)
    assert all(math.isclose(w.sum(), 1) for w in weights)

    def p(w, before):
        a = weights[ctx[before].bit_length()]
        return a[0] * (c2[before, w] / ctx[before] if ctx[before] else 0) + a[1] * c1[w] / n + a[2] / (v + 1)

    for before in ["<s>", *list(c1)[:5], "never seen"]:
        assert math.isclose(sum(p(w, before) for w in c1) + p("never seen", before), 1)
    want = []
    for i, t, *_ in rows:
        w = lm_tokens(t)
        want.append((i, fold(i) == 2, len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(x, y)) for x, y in zip(w, ["<s>", *w]))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = [tuple(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in out]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert lm.scored(no_docs)[0].count() == 0


def test_cells_ask_no_more_than_they_have(spark, docs, monkeypatch):
    """A hundred thousand buckets make no more rows, and no more work, than a cell has words and pairs."""
    import time

    import numpy as np

    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    counts = [np.ones(len(h), np.uint32)] * 2
    start = time.time()
    few = lm._sent(1, 0, h, counts, 10)
    many = lm._sent(1, 0, h, counts, 100_000)
    none = lm._sent(1, 0, h, counts, 10**12)
    assert (few.num_rows, none.num_rows) == (10, len(h)) and many.num_rows <= len(h)
    assert sum(map(len, none.column(4).to_pylist())) == 16 * len(h)
    assert time.time() - start < 5


def test_language_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = [r for r in queries()["op5_lm"](spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_without_training(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = lm.scored(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"))[0].collect()
    assert len(out) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


# Merkle


def plain_fingerprint(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cut = lambda s, p: [x for x in re.findall(p.replace(r"\z", r"\Z"), s) if x]
    tree, hashes = [], []
    for s in cut(text or "", merkle.SECTION):
        paragraphs = [[sha(x) for x in cut(q, merkle.PIECE)] for q in cut(s, merkle.PARAGRAPH)]
        own = [sha("".join(q)) for q in paragraphs]
        hashes.append(sha("".join(own)))
        tree.append(hashes[-1][:12] + "=" + ",".join(h[:12] + "." + "".join(x[:12] for x in q) for h, q in zip(own, paragraphs)))
    return sha("".join(hashes))[:32] + ":" + ";".join(tree)


def plain_between(x, y):
    h = 0
    while h < min(len(x), len(y)) and x[h][:12] == y[h][:12]:
        h += 1
    x, y = x[h:], y[h:]
    while x and y and x[-1][:12] == y[-1][:12]:
        x, y = x[:-1], y[:-1]
    return h, x, y


def plain_descent(a, b):
    """Likeness, first section and paragraphs before the edit, and how many of b's differ."""
    if a[:32] == b[:32]:
        return 1.0, 0, 0, 0
    section, x, y = plain_between(*([s for s in f[33:].split(";") if s] for f in (a, b)))
    paragraph, x, y = plain_between(*([p for s in z for p in s[13:].split(",")] for z in (x, y)))
    n = len(y)
    _, x, y = plain_between(*([q for p in z for q in re.findall("[0-9a-f]{12}", p[13:])] for z in (x, y)))
    count = lambda f: sum(len(re.findall("[0-9a-f]{12}", p[13:])) for s in f[33:].split(";") if s for p in s[13:].split(","))
    total = count(a) + count(b)
    return (2 * (count(a) - len(x) + len(set(x) & set(y))) / total if total else 0.0), section, paragraph, n


def test_merkle(spark, docs, rows, no_docs):
    out = merkle.compared(docs).collect()
    order = spark.createDataFrame([(r[0], r[1] or "") for r in rows], "i long, t string").withColumn("h", F.xxhash64("t")).orderBy(F.desc_nulls_last("i"), F.desc("h")).collect()
    want = Counter()
    for a, b in zip(order, [*order[1:], order[0]]):
        n = len(a.t)
        e = a.t[: n - n // 3] + b.t[: n // 3]
        f, g, h = plain_fingerprint(a.t), plain_fingerprint(e), plain_fingerprint(b.t)
        want[a.i, n, hashlib.sha256(e.encode()).hexdigest(), f, g, round(plain_descent(f, g)[0], 9), round(plain_descent(f, h)[0], 9), *plain_descent(f, g)[1:]] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.edited_section, r.edited_paragraph, r.n_edited) for r in out) == want
    one = merkle.compared(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert merkle.compared(no_docs).count() == 0


def test_merkle_locates_edits(spark):
    a = "First one. Same.\nSecond line.\n\nNext section here.\nLast."
    b = a.replace("Second", "Other").replace("Last", "Final")
    fps = lambda x, y: spark.createDataFrame([(x, y)], "x string, y string").select(merkle.fingerprint(F.col("x")).alias("x"), merkle.fingerprint(F.col("y")).alias("y"))
    of = lambda x, y: tuple(fps(x, y).select(merkle.descended(F.col("x"), F.col("y")).alias("d")).first().d)
    assert of(a, a) == (1.0, 0, 0, 0, 0)
    assert of(a, b) == (pytest.approx(5 / 9), 0, 1, 3, 3)  # from the second paragraph to the last; its first one is equal
    assert of(a, a.replace("Next", "Then"))[1:] == (1, 0, 1, 1)
    assert of(a, a + "\n\nA new section.")[1:] == (1, 1, 1, 2) and of(a, "")[0] == 0.0
    assert of("One. Two. Three.", "Two. One. Three.")[0] < 1.0  # order counts


def test_merkle_splits_hot_ids(spark, monkeypatch):
    """A third of all rows without an id, and as many under one id, are neighbours in the order of their hashes."""
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, f"own {i}") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).collect()
    got = Counter((r.doc_id, r.text, r._lt_next) for r in merkle.with_next(docs).collect())
    assert got == Counter((a.doc_id, a.text, b.text) for a, b in zip(order, [*order[1:], order[0]]))


# WARC

PAGES = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b/é z", None), (8, "http://c/", ""), (7, "http://d/", "<p>ünï</p>" * 300), (None, "http://n/", "<p>x</p>"), (11, "http://e/\r\nX: y", "solo"), (3, None, "<p>x</p>"), (7, "http://d/", "twice used id"), (2, "http://f/", "twice used id")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES * 1 + [(100 + i, f"http://h/{i}", f"<p>{i % 40}</p>" * 50) for i in range(200)], "page_id long, url string, html string")


def test_warc_rolls_within_shards(spark, tmp_path):
    """With the default proportions, a large table's shards hold many times what closes a file, so files are closed by their compressed size."""
    assert warc.n_shards(100 << 40, 10**10) == (100 << 40) // warc.SHARD_BYTES and warc.n_shards(512 << 20, 10**5) == 64 and warc.n_shards(30 << 30, 10**7) == warc.SPREAD
    assert warc.n_shards(0, 0) == 1 and warc.n_shards(1 << 30, 3) == 3
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://r/").alias("url"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(8)]).alias("html"))
    scale = 1 << 12
    folder, manifest = warc.write(many, f"file://{tmp_path}/r", shard_bytes=warc.SHARD_BYTES // scale, roll_bytes=warc.ROLL_BYTES // scale)
    files = manifest.collect()
    assert len({f.shard for f in files}) == 2 and len(files) >= 10
    for f in files:
        last = f.file == max(g.file for g in files if g.shard == f.shard)
        assert last or warc.ROLL_BYTES // scale <= f.bytes < warc.ROLL_BYTES // scale + 2000
    assert warc.read(manifest, folder).select("page_id").distinct().count() == 3000


def test_warc_round_trip(spark, pages, tmp_path):
    folder, manifest = warc.write(pages, f"file://{tmp_path}/w", shard_bytes=5000, roll_bytes=1500)
    out = warc.read(manifest, folder, payloads=True).collect()
    rows = [tuple(r) for r in pages.collect()]
    assert len(out) == len(rows)
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        first = p is None or least[h or ""] == p
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else least[h or ""], raw if first else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in out) == want
    files = manifest.orderBy("name").collect()
    assert len(files) > 4 and not list(tmp_path.glob("w/*.tmp"))
    ids = []
    for f in files:
        raw = (tmp_path / "w" / f["name"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
        ids += [r["page_id"] for r in warc.parse(gzip.open(tmp_path / "w" / f["name"]))]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    again = warc.write(pages.repartition(7), f"file://{tmp_path}/again", shard_bytes=5000, roll_bytes=1500)[1].orderBy("name").collect()
    assert [(f["name"], f["sha256"]) for f in again] == [(f["name"], f["sha256"]) for f in files]


def test_warc_shards_within_ranges(spark, pages, tmp_path, monkeypatch):
    """With few ranges, hot ids and repeated rows: the same records in order, ids of their own, and a place for every revisit."""
    monkeypatch.setattr(warc, "MOST_RANGES", 3)
    hot = spark.createDataFrame([(50, f"http://x/{i}", f"<p>hot {i}</p>" * 20) for i in range(150)] + [(None, None, f"none {i}" * 9) for i in range(80)], "page_id long, url string, html string")
    many = pages.unionByName(hot)
    folder, manifest = warc.write(many, f"file://{tmp_path}/w", shard_bytes=3000)
    out = warc.read(manifest, folder).collect()
    assert Counter(r.page_id for r in out) == Counter(r.page_id for r in many.collect())
    files = manifest.orderBy("name").collect()
    assert len(files) > 9 and max(f["records"] for f in files) < 150
    heads = {}
    for f in files:
        raw = gzip.decompress((tmp_path / "w" / f["name"]).read_bytes()).decode(errors="replace")
        for kind, name in re.findall(r"WARC-Type: (\w+)\r\nWARC-Record-ID: (\S+)", raw):
            assert name not in heads
            heads[name] = kind
        for name in re.findall(r"WARC-Refers-To: (\S+)", raw):
            heads.setdefault("refers", set()).add(name)
    refers = heads.pop("refers")
    assert len(heads) == len(out) and all(heads[name] == "response" for name in refers)


def test_warc_edges(spark, pages, tmp_path):
    folder, manifest = warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(manifest, folder).count() == 0
    folder, manifest = warc.write(pages, f"file://{tmp_path}/large", least=10**6)
    assert {r.record_type for r in warc.read(manifest, folder).collect()} == {"response"}
    raw = warc.record(1, "http://x/", b"abc")
    with pytest.raises(ValueError, match="damaged"):
        import io

        list(warc.parse(io.BytesIO(raw.replace(b"abc\r\n", b"abd\r\n"))))
