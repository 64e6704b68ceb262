"""Command line: corpus inspect, build, verify, activate, metadata; search, evaluate, probe, latency."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.errors import EvidenceError
from lectern.operators import ingest, validate
from lectern.plans import evaluation, requests
from lectern.plans.approval import approved
from lectern.plans.service import Service
from lectern.plans.snapshots import Catalog, normalized
from lectern.sources import cases, markup, pages


def _structure(spark: SparkSession, path: str):
    """A manifest {"books": {slug: [verse counts]}}, in its own order."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    books = json.loads(text)["books"]
    return spark.createDataFrame([(k, b, n) for k, (b, n) in enumerate(books.items())], "book_ord int, book string, counts array<int>")


def _archive(spark: SparkSession, source: str):
    """Passages, notes and lists of targets of a markup archive."""
    rows = markup.read_archives(spark, source).cache()
    spans = F.array(F.struct("member", "start", "end", "ord"))
    spans_json = F.to_json(spans)
    of = lambda kind: rows.where(F.col("kind") == kind)
    passages = of("passage").select(F.col("id").alias("reference"), "text", spans.alias("source_spans"))
    notes = of("note").select(F.col("id").alias("note_id"), F.col("origin").alias("origin_reference"), "anchor", F.col("source").alias("kind"), F.col("detail").alias("label"), "text", spans.alias("source_spans"))
    edges = of("edge").select(F.col("origin").alias("origin_reference"), F.col("anchor").alias("origin_anchor"), "target", F.col("source").alias("source_attribution"), spans_json.alias("spans_json"), spans.alias("source_spans"))
    return passages, notes, edges


def _pages(spark: SparkSession, source: str):
    """Passages of a page file with a text layer, which has no notes and no targets."""
    glyphs = pages.glyph_rows(pages.read_pages(spark, source)).cache()
    lines = pages.lines(glyphs).cache()
    if refused := pages.refusals(glyphs, lines).limit(10).collect():
        raise ValueError("; ".join(sorted(f"{r.path}: {r.error}" for r in refused)))
    passages = pages.units(lines).drop("path")
    spans = passages.schema["source_spans"].dataType.simpleString()
    notes = spark.createDataFrame([], f"note_id string, origin_reference string, anchor string, kind string, label string, text string, source_spans {spans}")
    edges = spark.createDataFrame([], f"origin_reference string, origin_anchor string, target string, source_attribution string, spans_json string, source_spans {spans}")
    return passages, notes, edges


#: What reads a source, and the recipe's name, by the source's suffix.
READERS = {"epub": (_archive, "markup-v1"), "pdf": (_pages, "page-text-v1")}


def extracted(spark: SparkSession, source: str):
    """Passages, notes and lists of targets of a source, its format and recipe, by its suffix."""
    suffix = source.rpartition("/")[2].rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported source format: {suffix or '<none>'}")
    read, recipe = READERS[suffix]
    return *read(spark, source), suffix, recipe


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern")
    parser.add_argument("--root", required=True, help="the catalog's folder, a URI")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "build"):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("--structure", required=True)
        if name == "build":
            p.add_argument("--edition", required=True)
            p.add_argument("--language", required=True)
            p.add_argument("--acquisition-url")
            p.add_argument("--acquisition-date")
    commands.add_parser("verify")
    p = commands.add_parser("activate")
    p.add_argument("corpus_version")
    p.add_argument("retrieval_config")
    commands.add_parser("metadata")
    p = commands.add_parser("search")
    p.add_argument("query")
    p.add_argument("--mode", default="terms")
    p = commands.add_parser("evaluate")
    p.add_argument("cases")
    p = commands.add_parser("probe")
    p.add_argument("definition")
    p = commands.add_parser("latency")
    p.add_argument("reference")
    p.add_argument("query")
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    catalog = Catalog(spark, args.root)
    try:
        print(json.dumps(_run(args, spark, catalog), ensure_ascii=False, sort_keys=True, default=str))
    except EvidenceError as e:
        print(json.dumps({"error": {"code": e.code, "message": str(e)}}), file=sys.stderr)
        return 2
    except ValueError as e:
        print(json.dumps({"error": {"code": "invalid", "message": str(e)}}), file=sys.stderr)
        return 1
    return 0


def _run(args, spark: SparkSession, catalog: Catalog):
    service = Service(catalog)
    if args.command in ("inspect", "build"):
        expected = ingest.expected_references(_structure(spark, args.structure)).cache()
        passages, notes, edges, suffix, recipe = extracted(spark, args.source)
        corpus = replace(normalized(passages, notes, edges, expected, passages), source_format=suffix, source_profile=markup.PROFILE)
        if args.command == "inspect":
            return validate.finding_report(validate.validate_corpus(corpus.units, corpus.notes, corpus.edges, expected)).first().asDict()
        approval = approved(spark, args.source, args.edition, args.language, args.acquisition_url, args.acquisition_date)
        return catalog.build(corpus, approval, recipe, expected)
    if args.command == "verify":
        return [catalog.verify(a["artifact_digest"])["corpus_version"] for a in catalog.accepted()]
    if args.command == "activate":
        catalog.activate(args.corpus_version, args.retrieval_config)
        return catalog.active()
    if args.command == "metadata":
        return service.get_corpus()
    if args.command == "search":
        return service.search_lexical(requests.LexicalRequest(query=args.query, mode=args.mode))
    if args.command == "evaluate":
        found = cases.load_cases(spark, args.cases)
        made = evaluation.report(catalog.pin(), found, cases.judgments(found))
        return {"path": evaluation.publish(catalog.store, "evaluations", made), "report": made}
    if args.command == "probe":
        definition = json.loads("".join(r.value for r in spark.read.text(args.definition, wholetext=True).collect()))
        made = evaluation.probe(service, definition["questions"], definition["lanes"])
        return {"path": evaluation.publish(catalog.store, "probes", made), "report": made}
    return evaluation.latencies(service, args.reference, args.query)


if __name__ == "__main__":
    sys.exit(main())
