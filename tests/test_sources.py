"""Sources: archives, cases, grammar strings; the command line; the package without its llm part."""

import hashlib
import io
import json
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from lectern import cli
from lectern.operators import ingest
from lectern.plans import evaluation
from lectern.plans.snapshots import Catalog
from lectern.sources import cases, markup
from tests.test_service import APPROVAL, golden

ROOT = Path(__file__).resolve().parent.parent


def test_archive(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(markup.sample_archive())
    rows = markup.read_archives(spark, f"{tmp_path}/*.epub").orderBy("ord").collect()
    assert [(r.kind, r.id, r.target, r.text) for r in rows] == [("passage", "bofm/1-ne/1/1", None, "Alpha begins a here."), ("edge", None, "bofm/1-ne/1/2", None), ("passage", "bofm/1-ne/1/2", None, "Beta follows."), ("note", "n1", None, "A note.")]
    assert rows[1].start < rows[1].end and rows[0].member == "OPS/a.xhtml"


def chapter(body, profile=markup.PROFILE):
    return f'<html><section data-scripture-profile="{profile}">{body}</section></html>'


GOOD = '<p data-reference="bofm/1-ne/1/1">Text.</p>'


@pytest.mark.parametrize("raw", [
    b"not a zip",
    markup.archive_of({"a.xhtml": chapter(GOOD, "other")}),
    markup.archive_of({"a.xhtml": chapter("<p>nothing marked</p>")}),
    markup.archive_of({"a.xhtml": "<!DOCTYPE html>" + chapter(GOOD)}),
    markup.archive_of({"a.xhtml": chapter('<p data-reference="bofm/1-ne/01/1">x</p>')}),
    markup.archive_of({"a.xhtml": chapter('<p data-reference="bofm/1-ne/1/1"> </p>')}),
    markup.archive_of({"a.xhtml": chapter(GOOD + '<a data-target="x" data-origin="bofm/1-ne/1/1">y</a>')}),
    markup.archive_of({"a.xhtml": chapter(GOOD + '<a data-target="x" data-origin="bofm/1-ne/1/1" data-anchor="a" data-source="s">y</a>' * 2)}),
    markup.archive_of({"a.xhtml": chapter(GOOD) + " " * 1_000_000}),
    markup.archive_of({"../a.xhtml": chapter(GOOD)}),
    markup.archive_of({"a.xhtml": "<p>"}),
])
def test_refused_archives(raw):
    with pytest.raises(markup.ExtractionError):
        markup.extract(raw)


def test_repeated_and_missing_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "1")
        with pytest.warns(UserWarning):
            z.writestr("x", "2")
    with pytest.raises(markup.ExtractionError, match="refused"):
        markup.extract(out.getvalue())
    with pytest.raises(markup.ExtractionError, match="budget"):
        markup.extract(markup.sample_archive(), markup.Limits(members=2))


#: Lists over a chapter of six verses, by what becomes of them: what they are written as, or None.
LISTS = {
    "parsed": {"bofm/mosiah/2/6": "bofm/mosiah/2/6", "bofm/mosiah/2/1-6.": "bofm/mosiah/2/1-6", "bofm/mosiah/2/4;bofm/mosiah/2/2-3": "bofm/mosiah/2/4; bofm/mosiah/2/2-3"},
    "unresolved_external_target": {"\tdc/s/4/7;pgp/moses/1/39 ": "dc/s/4/7; pgp/moses/1/39", "bofm/mosiah/2/5 ;bible/ruth/1/16-17 .": "bofm/mosiah/2/5; bible/ruth/1/16-17"},
    "ambiguous_syntax": {"bofm/mosiah/2/3 or bofm/mosiah/2/4": None, "bible/ruth/1/16,dc/s/4/7": None},
    "invalid_canonical_target": {"bofm/mosiah/2/5-7": None, "bofm/mosiah/3/1": None, "bofm/harbor/2/1": None, "pgp/moses/2/9-1": None, "bofm/mosiah/2/9; Ruth": None},
    "duplicate_target": {"bible/ruth/1/16; dc/s/4/7; bible/ruth/1/16": None},
    "unsupported_syntax": {"see Ruth 1": None, "quran/x/1/1": None, "bofm/mosiah/2/03": None, ";": None, "Ruth; bofm/mosiah/2/9": None, "...": None, "bofm/mosiah/2/1;": None},
}


def test_grammar(spark):
    valid = spark.createDataFrame([(f"bofm/mosiah/2/{v}",) for v in range(1, 7)], "reference string")
    want = {text: (f"official_reference_{code}", normalized) for code, lists in LISTS.items() for text, normalized in lists.items()}
    found = ingest.grammar_parse(spark.createDataFrame([(t,) for t in want], "list string"), "list", valid).collect()
    assert {r.list: (r.code, r.normalized_text) for r in found} == want
    assert all((r.n_targets > 0) == (r.normalized_text is not None) for r in found)


CASE = {"case_id": "c1", "schema_version": 1, "split": "locked", "query": " lantern ", "curator_rationale": "r", "judgments": [{"reference": "bofm/1-ne/1/1", "grade": 3}, {"reference": "bofm/1-ne/1/2", "grade": 0}]}


def test_cases(spark, tmp_path):
    (tmp_path / "ok").write_text(json.dumps(CASE) + "\n\n" + json.dumps({**CASE, "case_id": "c2", "split": "development"}))
    assert [r["query"] for r in cases.load_cases(spark, str(tmp_path / "ok")).orderBy("case_id").collect()] == ["lantern", "lantern"]
    (tmp_path / "twice").write_text((json.dumps(CASE) + "\n") * 2)
    with pytest.raises(ValueError, match="more than once"):
        cases.load_cases(spark, str(tmp_path / "twice"))
    for bad in ({"split": "other"}, {"query": "  "}, {"judgments": [{"reference": "x", "grade": 4}]}):
        (tmp_path / "bad").write_text(json.dumps({**CASE, **bad}))
        with pytest.raises(Exception, match="invalid evaluation case"):
            cases.load_cases(spark, str(tmp_path / "bad")).collect()


def test_evaluation_and_probe(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}")
    corpus, expected = golden(spark)
    record = catalog.build(corpus, APPROVAL, "r", expected)
    catalog.activate(record["corpus_version"], record["retrieval_config"])
    found = spark.createDataFrame([("c1", "locked", "quiet lantern"), ("c2", "development", "lighthouse")], "case_id string, split string, query string")
    judged = spark.createDataFrame([("c1", "bofm/enos/1/1", 3), ("c1", "bofm/enos/1/4", 1)], "case_id string, reference string, grade int")
    made = evaluation.report(catalog.pin(), found, judged, [1, 2])
    one, two = made["cases"]
    assert one["ranked_references"] == ["bofm/enos/1/1", "bofm/enos/1/2"] and one["judgment_coverage"] == 0.5
    assert one["metrics"]["precision_at_2"] == 0.5 and one["metrics"]["recall_at_2"] == 0.5 and one["metrics"]["mrr"] == 1.0 and one["metrics"]["ndcg_at_1"] == 1.0 and 0 < one["metrics"]["ndcg_at_2"] < 1
    assert two["metrics"]["mrr"] == 0 and two["judgment_coverage"] == 1.0
    assert made["ineligibility_reasons"] == ["no_baseline_comparison", "incomplete_locked_judgments"] and not made["eligible"]
    assert made == evaluation.report(catalog.pin(), found, judged, [1, 2])
    path = evaluation.publish(catalog.store, "evaluations", made)
    assert evaluation.publish(catalog.store, "evaluations", made) == path
    with pytest.raises(ValueError, match="another"):
        evaluation.publish(catalog.store, "evaluations", {**made, "eligible": True})
    for depths in ([], [3, 1], [1, 1], [0], [101]):
        with pytest.raises(ValueError, match="depths"):
            evaluation.report(catalog.pin(), found, judged, depths)
    from lectern.plans.service import Service

    service = Service(catalog)
    audit = evaluation.probe(service, [{"id": "q1", "query": "quiet lantern", "pool": ["bofm/enos/1/1", "bofm/enos/1/2"]}], ["lexical", "official"])
    assert audit["questions"][0] == {"id": "q1", "coverage": {"atomic": 1.0, "combined": 1.0}, "citation_errors": 0, "class_errors": 0}
    times = evaluation.latencies(service, "bofm/enos/1/1", "lantern", 0, 1)
    assert set(times["operations"]["evidence_search"]) == {"p50_ms", "p95_ms", "iterations", "warmup"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.epub").write_bytes(markup.sample_archive())
    (tmp_path / "s.json").write_text(json.dumps({"books": {"1-ne": [2]}}))
    root = ["--root", f"file://{tmp_path}/catalog"]
    run = lambda *a: (cli.main([*root, *a], spark), capsys.readouterr())
    source = [str(tmp_path / "s.epub"), "--structure", str(tmp_path / "s.json")]
    code, said = run("inspect", *source)
    assert code == 0 and json.loads(said.out)["status"] == "accepted"
    named = ["--edition", "first", "--language", "eng"]
    code, said = run("build", *source, *named)
    assert code == 1 and "needs an approval" in said.err
    code, said = run("build", *source, *named, "--acquisition-url", "https://example.org/s.epub")
    assert code == 1 and "go together" in said.err
    digest = hashlib.sha256((tmp_path / "s.epub").read_bytes()).hexdigest()
    approval = {"source_sha256": digest, "acquisition_url": "https://example.org/s.epub", "acquisition_date": "2026-02-03", "edition": "first", "language": "eng"}
    for wrong in ({"source_sha256": "0" * 64}, {"edition": "second"}, {"language": "deu"}, {"acquisition_date": "2026-02-30"}, {"acquisition_url": "s.epub"}, {"more": "x"}):
        (tmp_path / "s.epub.approval.json").write_text(json.dumps(approval | wrong))
        code, said = run("build", *source, *named)
        assert code == 1 and "approval" in said.err, wrong
    (tmp_path / "s.epub.approval.json").write_text(json.dumps(approval))
    code, said = run("build", *source, *named)
    built = json.loads(said.out)
    assert built["manifest"]["source_approval"] == approval
    code, said = run("build", *source, *named, "--acquisition-url", "https://example.org/s.epub", "--acquisition-date", "2026-02-03")
    assert json.loads(said.out) == built
    assert code == 0 and run("metadata")[0] == 2
    assert run("activate", built["corpus_version"], "baseline-none")[0] == 1
    assert run("activate", built["corpus_version"], built["retrieval_config"])[0] == 0
    code, said = run("verify")
    assert json.loads(said.out) == [built["corpus_version"]]
    code, said = run("search", "beta")
    assert [r["passage"]["reference"] for r in json.loads(said.out)["records"]] == ["bofm/1-ne/1/2"]
    definition = {"lanes": ["lexical"], "questions": [{"id": "q", "query": "beta", "pool": ["bofm/1-ne/1/2"]}]}
    (tmp_path / "probe.json").write_text(json.dumps(definition))
    code, said = run("probe", str(tmp_path / "probe.json"))
    published = json.loads(said.out)
    assert code == 0 and published["report"]["questions"][0]["coverage"]["combined"] == 1.0
    assert json.loads((tmp_path / "catalog" / published["path"]).read_text()) == published["report"]
    for wrong in ({"lanes": ["official"]}, {"questions": []}, {"questions": definition["questions"] * 2}, {"questions": [{"id": "q", "query": "x", "pool": []}]}, {"questions": [{"id": "q", "query": "x", "pool": ["bofm/1-ne/1/1-2"]}]}):
        (tmp_path / "probe.json").write_text(json.dumps(definition | wrong))
        assert run("probe", str(tmp_path / "probe.json"))[0] == 1
    (tmp_path / "missing.json").write_text(json.dumps({"books": {"1-ne": [3]}}))
    code, said = run("build", source[0], "--structure", str(tmp_path / "missing.json"), *named)
    assert code == 1 and "missing_passage" in said.err


def test_the_rest_imports_without_llm(tmp_path):
    for name in ("lectern", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 80
