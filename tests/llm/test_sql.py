"""Queries of the operators against their SQL, and the pipeline against plain Python."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import queries as Q
from tests.llm.test_pipeline_operators import brute_quality, brute_similar, brute_substrings, brute_targets
from tests.oracle import check, duck


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    check(Q.queries()[name](spark, sf), Q.oracle_sql()[name], duck(sf))


def test_registered():
    assert [n.partition("_")[0] for n in Q.queries()] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    stages = []
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, df, sf).collect(), stage(spark, df, sf).schema)
        stages.append(df.collect())
    good = [d for d in docs if (q := brute_quality(d.text))[0] >= 20 and 100 * q[4] <= 30 * q[0]]
    assert Counter(stages[0]) == Counter(good)  # no source of these tables fails as a whole
    of = brute_similar([d.text for d in good])
    first = {}
    for d in sorted(good, key=lambda d: d.doc_id):
        first.setdefault(of[d.text], d)
    assert Counter(stages[1]) == Counter(first.values())
    cut = brute_substrings([tuple(d) for d in first.values()], 20)
    left = {d.doc_id: (cut[d.doc_id, d.text][2] if cut[d.doc_id, d.text][1] else d.text) for d in first.values()}
    assert {d.doc_id: d.text for d in stages[2]} == left and all(d.n_chars == len(d.text) for d in stages[2])
    size = {d.doc_id: len(d.text.split()) for d in stages[2]}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d in stages[2]:
        sizes[d.source] += size[d.doc_id]
        largest[d.source] = max(largest[d.source], size[d.doc_id])
    for d in stages[3]:
        assert d.text == left[d.doc_id]
        taken[d.source] += size[d.doc_id]
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes) and max(Counter(d.doc_id for d in stages[3]).values()) <= 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in stages[4]) == Counter((d.doc_id, sha(d.text)) for d in stages[3])
