"""Snapshots and the service over a small corpus of our own: a harbor at night."""

import pytest
from pyspark.sql import functions as F

from lectern.errors import ConfigUnavailableError, CorpusUnavailableError, InvalidQueryError, LimitExceededError, PassageNotFoundError, VersionUnavailableError
from lectern.operators import ingest
from lectern.plans import requests as Q
from lectern.plans.service import Service
from lectern.plans.snapshots import FAULTS, BuildFault, Catalog, normalized

TEXTS = [
    ("enos/1/1", "The lantern burns above the quiet harbor."),
    ("enos/1/2", "A lantern is carried down to the boats."),
    ("enos/1/3", "Quiet harbor, cold water."),
    ("enos/1/4", "Nets are mended at dawn."),
    ("enos/1/5", "Gulls follow the last boat out."),
    ("jarom/1/1", "Lanterns glow in every window."),
    ("jarom/1/2", "The lantern and the harbor bell remain until morning comes again."),
]
#: A ring over two books, a range, and one target outside.
EDGES = [("enos/1/1", "bofm/enos/1/2"), ("enos/1/2", "bofm/jarom/1/2"), ("enos/1/2", "bible/ruth/2/3"), ("jarom/1/2", "bofm/enos/1/1"), ("enos/1/3", "bofm/enos/1/4-5")]
APPROVAL = {"edition": "e", "language": "en", "source_sha256": "0" * 64}


def golden(spark, texts=TEXTS):
    units = spark.createDataFrame([(f"bofm/{r}", t, ["s"]) for r, t in texts], "reference string, text string, source_spans array<string>")
    expected = ingest.expected_references(spark.createDataFrame([(0, "enos", [5]), (1, "jarom", [2])], "book_ord int, book string, counts array<int>"))
    edges = spark.createDataFrame([(f"bofm/{o}", "a", t, "official-footnote", "[]", ["s"]) for o, t in EDGES], "origin_reference string, origin_anchor string, target string, source_attribution string, spans_json string, source_spans array<string>")
    notes = spark.createDataFrame([("n1", "bofm/enos/1/1", ["s"])], "note_id string, origin_reference string, source_spans array<string>")
    return normalized(units, notes, edges, expected, units), expected


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    c = Catalog(spark, f"file://{tmp_path_factory.mktemp('catalog')}")
    with pytest.raises(CorpusUnavailableError):
        c.pin()
    corpus, expected = golden(spark)
    record = c.build(corpus, APPROVAL, "recipe", expected)
    assert c.build(corpus, APPROVAL, "recipe", expected) == record
    assert len(c.accepted()) == 1
    with pytest.raises(CorpusUnavailableError):
        c.pin()  # a build activates nothing
    c.activate(record["corpus_version"], record["retrieval_config"])
    return c


@pytest.fixture(scope="module")
def service(catalog):
    return Service(catalog)


def names(answer):
    return [r["passage"]["reference"].removeprefix("bofm/") for r in answer["records"]]


def test_lookup_and_context(service):
    assert names(service.get_passage(Q.PassageRequest(reference="bofm/jarom/1/1"))) == ["jarom/1/1"]
    answer = service.get_context(Q.ContextRequest(reference="bofm/enos/1/5", before=1, after=2))
    assert [c["reference"] for c in answer["records"][0]["context"]] == ["bofm/enos/1/4", "bofm/jarom/1/1", "bofm/jarom/1/2"]  # across books
    with pytest.raises(PassageNotFoundError):
        service.get_passage(Q.PassageRequest(reference="bofm/enos/4/1"))


@pytest.mark.parametrize(("query", "mode", "wanted"), [
    ("Quiet harbor", "phrase", ["enos/1/3", "enos/1/1"]),
    ("harbor quiet", "phrase", []),
    ("harbor lantern", "terms", ["enos/1/1", "jarom/1/2"]),
    ("boat", "prefix", ["enos/1/5", "enos/1/2"]),
    ("lan", "prefix", ["jarom/1/1", "enos/1/1", "enos/1/2", "jarom/1/2"]),
    ("lantern bell", "near", ["jarom/1/2"]),
    ("lighthouse", "terms", []),
    ("lantern ?", "terms", []),
    ("lantern ? bell", "near", ["jarom/1/2"]),
])
def test_search_modes(service, query, mode, wanted):
    answer = service.search_lexical(Q.LexicalRequest(query=query, mode=mode))
    assert names(answer) == wanted and not answer["completeness"]["truncated"]


def test_filters_keep_scores(service):
    scores = lambda **more: {r["passage"]["reference"]: r["basis"][0]["raw_score"] for r in service.search_lexical(Q.LexicalRequest(query="the lantern", **more))["records"]}
    whole, some = scores(), scores(books=["jarom"], reference_ranges=["bofm/jarom/1/1-2", "bofm/enos/1/1"])
    assert set(some) == {"bofm/jarom/1/2"} < set(whole) and some["bofm/jarom/1/2"] == whole["bofm/jarom/1/2"]
    with pytest.raises(InvalidQueryError):
        service.search_lexical(Q.LexicalRequest(query="lantern", reference_ranges=["bofm/enos/3/1-2"]))


def test_pages_join_to_the_whole(service):
    ask = lambda **more: service.search_lexical(Q.LexicalRequest(**{"query": "lan", "mode": "prefix", **more}))
    got, cursor, pages = [], None, 0
    while pages == 0 or cursor is not None:
        page = ask(limit=3, cursor=cursor)
        got, cursor, pages = got + names(page), page["completeness"]["cursor"], pages + 1
    assert got == names(ask()) and pages == 2
    first = ask(limit=1)["completeness"]["cursor"]
    for other in ({"query": "harb"}, {"mode": "terms"}, {"limit": 2}):
        with pytest.raises(InvalidQueryError):
            ask(**{"limit": 1, "cursor": first, **other})
    with pytest.raises(InvalidQueryError):
        ask(limit=1, cursor="x" + first[1:])


def test_traversal(service):
    walk = lambda at, **more: service.traverse_references(Q.TraversalRequest(reference=f"bofm/{at}", **more))
    answer = walk("enos/1/1", max_depth=2, max_nodes=2)
    assert names(answer) == ["enos/1/1", "enos/1/2"] and answer["external_targets"] == ["bible/ruth/2/3"]
    assert answer["completeness"] == {"truncated": True, "cursor": None, "frontier": ["bofm/jarom/1/2"]}
    assert [r["basis"][0]["match_kind"] for r in answer["records"]] == ["traversal_origin", "official_reference"]
    none = walk("enos/1/1", max_depth=0)
    assert names(none) == ["enos/1/1"] and not none["completeness"]["truncated"] and not none["official_edges"]
    both = walk("enos/1/1", direction="both", max_depth=1, include_external=False)
    assert names(both) == ["enos/1/1", "enos/1/2", "jarom/1/2"] and not both["external_targets"]
    assert names(walk("enos/1/1", direction="inbound", max_depth=3)) == ["enos/1/1", "jarom/1/2", "enos/1/2"]
    assert names(walk("enos/1/3")) == ["enos/1/3", "enos/1/4", "enos/1/5"]  # a range, in its order
    assert names(walk("enos/1/5", direction="inbound")) == ["enos/1/5", "enos/1/3"]


def test_evidence(service):
    ask = lambda **more: service.search_evidence(Q.EvidenceRequest(**{"query": "lantern harbor", **more}))
    answer = ask()
    assert names(answer) == ["enos/1/1", "jarom/1/2", "enos/1/2"]
    assert [[b["lane"] for b in r["basis"]] for r in answer["records"]] == [["lexical", "official"], ["lexical"], ["official"]]
    assert names(ask(books=["enos"], reference_ranges=["bofm/enos/1/1"])) == ["enos/1/1", "enos/1/2"]  # what hits cite is not filtered
    assert names(ask(lanes=["lexical"])) == ["enos/1/1", "jarom/1/2"]
    first = ask(limit=2)["completeness"]
    assert first["truncated"] and names(ask(limit=2, cursor=first["cursor"])) == ["enos/1/2"]
    assert names(ask(query="lighthouse")) == []


def test_metadata_and_pins(service, catalog):
    meta = service.get_corpus()
    assert meta["enabled_lanes"] == ["lexical", "official"] and meta["bounds"]["traversal_nodes"] == 200
    with pytest.raises(VersionUnavailableError):
        service.get_corpus(Q.Pinned(corpus_version="corpus-x", retrieval_config="baseline-x"))
    with pytest.raises(ConfigUnavailableError):
        service.get_corpus(Q.Pinned(corpus_version=meta["corpus_version"], retrieval_config="baseline-x"))
    with pytest.raises(InvalidQueryError):
        Q.Pinned(corpus_version="x")
    with pytest.raises(ValueError, match="accepted"):
        catalog.activate(meta["corpus_version"], "baseline-x")
    assert catalog.latest()["corpus_version"] == meta["corpus_version"]


@pytest.mark.parametrize(("error", "make"), [
    (LimitExceededError, lambda: Q.ContextRequest(reference="bofm/enos/1/1", before=21)),
    (LimitExceededError, lambda: Q.LexicalRequest(query="x", limit=101)),
    (LimitExceededError, lambda: Q.LexicalRequest(query="x" * 513)),
    (InvalidQueryError, lambda: Q.LexicalRequest(query="  ")),
    (InvalidQueryError, lambda: Q.LexicalRequest(query="x", near_distance=3)),
    (InvalidQueryError, lambda: Q.LexicalRequest(query="x", books=["nowhere"])),
    (InvalidQueryError, lambda: Q.PassageRequest(reference="bofm/enos/1/02")),
    (InvalidQueryError, lambda: Q.PassageRequest(reference="nt/mark/2/1")),
    (InvalidQueryError, lambda: Q.PassageRequest(reference="bofm/enos/1/9-8")),
    (InvalidQueryError, lambda: Q.EvidenceRequest(query="x", lanes=["official", "lexical"])),
    (LimitExceededError, lambda: Q.TraversalRequest(reference="bofm/enos/1/1", max_depth=4)),
])
def test_bad_requests(error, make):
    with pytest.raises(error):
        make()


@pytest.mark.parametrize("fault", [FAULTS[0], FAULTS[3], FAULTS[5], FAULTS[6]])
def test_faults_accept_nothing_and_can_be_repeated(spark, tmp_path, fault):
    c = Catalog(spark, f"file://{tmp_path}")
    corpus, expected = golden(spark)
    with pytest.raises(BuildFault):
        c.build(corpus, APPROVAL, "recipe", expected, fault=fault)
    assert c.accepted() == [] and [a["state"] for a in c.attempts()] == ["rejected"]
    assert c.build(corpus, APPROVAL, "recipe", expected)["corpus_version"].startswith("corpus-")


def test_changed_rows_are_noticed(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    corpus, expected = golden(spark)
    record = c.build(corpus, APPROVAL, "recipe", expected)
    folder = f"{c.root}/corpora/{record['artifact_digest']}/units"
    rows = spark.read.parquet(folder).withColumn("text", F.upper("text")).collect()
    schema = spark.read.parquet(folder).schema
    c.store.delete(f"corpora/{record['artifact_digest']}/units")
    spark.createDataFrame(rows, schema).write.parquet(folder)
    with pytest.raises(CorpusUnavailableError, match="units: leaves"):
        c.activate(record["corpus_version"], record["retrieval_config"])


def test_unchanged_files_are_not_hashed_again(spark, tmp_path, monkeypatch):
    from lectern.plans import snapshots

    c = Catalog(spark, f"file://{tmp_path}")
    corpus, expected = golden(spark)
    record = c.build(corpus, APPROVAL, "recipe", expected)
    monkeypatch.setattr(snapshots, "rows_digest", lambda *_: pytest.fail("hashed again"))
    c.activate(record["corpus_version"], record["retrieval_config"])
    monkeypatch.undo()
    assert Catalog(spark, c.root).verify(record["artifact_digest"])["rows"] == record["manifest"]["rows"]  # another process hashes all


def test_findings_stop_a_build(spark, tmp_path):
    corpus, expected = golden(spark, [t for t in TEXTS if t[0] != "jarom/1/1"])  # nothing cites it
    with pytest.raises(ValueError, match="missing_passage"):
        Catalog(spark, f"file://{tmp_path}").build(corpus, APPROVAL, "recipe", expected)


def test_racing_registrations(spark, tmp_path):
    """Of writers for one number each gets a number of its own, and one build key is committed once."""
    a, b = Catalog(spark, f"file://{tmp_path}"), Catalog(spark, f"file://{tmp_path}")
    record = lambda k: {"build_key": k, "corpus_version": f"corpus-{k}", "retrieval_config": "r", "artifact_digest": k}
    met = []

    def meanwhile():
        if not met:
            met.append(b.register(record("x")))

    assert a.register(record("y"), meanwhile) == record("y") and met == [record("x")]
    assert [r["build_key"] for r in a.accepted()] == ["x", "y"] and b.latest() == record("y")
    assert a.register({**record("x"), "artifact_digest": "other"}) == record("x") and len(a.accepted()) == 2
    with pytest.raises(FileExistsError):
        a.store.create("accepted/000000000001.json", "{}")
    assert (tmp_path / "accepted" / "000000000001.json").stat().st_mode & 0o777 == 0o600
    assert not list(tmp_path.glob("accepted/*.tmp"))
