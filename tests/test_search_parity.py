"""Random full-text queries against SQLite's index, an independent implementation of the same rules."""

import random
import sqlite3

import pytest

from lectern.functions.text import plain_tokens, tokens
from lectern.operators import search as S

WORDS = ["faith", "hope", "faithful", "Ünder", "under", "naïve", "ǣon", "straße", "x1", "it's", "a-b", "the", "of", "thing", "ſet"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 14))) + rnd.choice(["", ".", " !"])) for i in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(i + 1, t) for i, t in rows])
    units = spark.createDataFrame(rows, "canonical_order long, text string")
    toks = S.tokenized(units).cache()
    return con, toks, S.statistics(toks).cache()


def match(text, mode, distance):
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    if mode == "phrase":
        return quote(text)
    parts = [quote(p) for p in text.split()]
    if mode == "near":
        return f"NEAR({' '.join(parts)}, {distance})"
    return " AND ".join(p + "*" * (mode == "prefix") for p in parts)


def test_random_queries(corpus):
    con, toks, stats = corpus
    rnd = random.Random(7)
    cases = []
    for _ in range(90):
        mode = rnd.choice(S.MODES)
        k = rnd.randint(2, 3) if mode == "near" else rnd.randint(1, 3)
        cases.append((" ".join(rnd.choices([*WORDS, "fai", "FAITH"], k=k)), mode, rnd.randint(1, 6) if mode == "near" else None))
    found = S.search_all(toks, stats, {i: S.compiled(*c) for i, c in enumerate(cases)}).collect()
    for i, c in enumerate(cases):
        want = {r[0] - 1: r[1] for r in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match(*c),))}
        got = {r.doc: r.raw_score for r in found if r.query_id == i}
        assert got.keys() == want.keys(), c
        assert all(abs(got[d] - want[d]) < 1e-9 for d in got), c


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "blocks")
    S.blocks(*corpus[1:]).write.parquet(path)
    return corpus[1].sparkSession.read.parquet(path)


@pytest.mark.parametrize(("text", "mode"), [("faith under", "prefix"), ("faith the", "terms"), ("it's the", "terms"), ("of the", "phrase"), ("faith of thing", "near"), ("a-b the it's", "near")])
def test_index_and_units_give_the_same(corpus, index, text, mode):
    _, toks, stats = corpus
    a, b = S.search(toks, stats, text, mode).collect(), S.search(index, stats, text, mode).collect()
    assert sorted(a) == sorted(b) and a


def test_near_reads_each_list_once(corpus, index):
    plan = S.search(index, corpus[2], "faith of thing", "near")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") == 1 and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def long_corpus(spark, tmp_path_factory):
    """20,000 units; a few ranges of orders have both rare words often."""
    rnd = random.Random(4)
    rows = []
    for i in range(20_000):
        rich = i // S.SPAN in (3, 40, 41, 77)
        words = rnd.choices(["the", "of", "thing", "word"], k=rnd.randint(5, 40))
        words += [w for w in ("alpha", "beta") for _ in range(rnd.randint(1, 5) if rich and rnd.random() < 0.2 else 0)]
        words += ["alpha"] * (rnd.random() < 0.05) + ["beta"] * (rnd.random() < 0.05)
        rows.append((i, " ".join(words)))
    path = str(tmp_path_factory.mktemp("long"))
    toks = S.tokenized(spark.createDataFrame(rows, "canonical_order long, text string"))
    S.statistics(toks).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    S.blocks(toks, stats).write.parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks"), stats


@pytest.mark.parametrize("text", ["alpha beta", "alpha", "beta alpha beta", "the of", "alpha nowhere", "!", "alpha !"])
def test_best_hits_without_all_blocks(long_corpus, text):
    index, stats = long_corpus
    order = lambda df: [tuple(r) for r in df.orderBy("raw_score", "doc").limit(11).collect()]
    found, read = S.best(index, stats, text, 10)
    assert order(found) == order(S.search(index, stats, text))
    assert read.read <= read.blocks
    if text in ("alpha beta", "beta alpha beta"):
        assert 0 < read.read < read.blocks / 4, read


def test_best_hits_behind_filters_and_keys(long_corpus):
    from pyspark.sql import functions as F

    index, stats = long_corpus
    whole = S.search(index, stats, "alpha beta").orderBy("raw_score", "doc").collect()
    odd = lambda hits: hits.where(F.col("doc") % 97 == 5)
    behind = lambda hits: hits.where((F.col("raw_score") > whole[30].raw_score) | ((F.col("raw_score") == whole[30].raw_score) & (F.col("doc") > whole[30].doc)))
    for keep, want in ((odd, [r for r in whole if r.doc % 97 == 5]), (behind, whole[31:])):
        found, _ = S.best(index, stats, "alpha beta", 10, keep)
        assert keep(found).orderBy("raw_score", "doc").limit(11).collect() == want[:11]


def test_driver_and_column_tokens_agree(spark):
    from pyspark.sql import functions as F

    texts = ["Ünder ǢON ſtraße", "a_b c-d x1²", "é́ naïve — “q”", "ÀÉÎÕÜ ŁØÐ Ǆ", "日本 語", "", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("x")).collect()
    assert all(r.x == plain_tokens(r.t) for r in rows)


def test_empty_queries(corpus):
    _, toks, stats = corpus
    assert S.search(toks, stats, "!").count() == 0
    assert S.search(toks, stats, "! faith", "terms").count() == 0
    assert S.search(toks, stats, "nothing-here").count() == 0
