"""Offline evaluation of the service, the probe, and the latency harness: reports named by their digests."""

from __future__ import annotations

import inspect
import math
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import evaluate, graph, search
from lectern.plans import requests as Q
from lectern.plans.service import Service
from lectern.plans.snapshots import Snapshot, Store, canonical, sha256


def rankings(snapshot: Snapshot, cases: DataFrame, depth: int = 1) -> DataFrame:
    """(case_id, reference, rank) of all cases in one job: what evidence search returns over all pages.

    Cases (case_id, query) are a list that people wrote; their queries compile
    on the driver. Pools, expansions and ranks are keyed by case.
    """
    spark = snapshot.spark
    rows = cases.select("case_id", "query").collect()
    ids = F.broadcast(spark.createDataFrame([(i, r.case_id) for i, r in enumerate(rows)], "query_id int, case_id string"))
    queries = {i: search.compiled(r["query"]) for i, r in enumerate(rows)}
    units = snapshot.table("units").select("reference", "canonical_order", "book")
    found = search.search_all(snapshot.table("blocks"), snapshot.table("stats"), queries).join(ids, "query_id").join(units, F.col("doc") == F.col("canonical_order"))
    if "filters" in cases.columns:
        found = found.join(cases.select("case_id", "filters"), "case_id").where("filters.books IS NULL OR array_contains(filters.books, book)")
    pool = evaluate.ranked(found, ["raw_score", "canonical_order"]).where(F.col("rank") <= int(snapshot.record["config"]["lexical"]["candidate_pool_size"]))
    seeds = pool.select(F.struct("case_id", "rank").alias("seed"), F.col("reference").alias("node"))
    reached, _ = graph.expanded(snapshot.table("adjacency"), seeds, "outbound", depth)
    cited = reached.where("depth > 0").select(F.col("seed.case_id").alias("case_id"), F.col("node").alias("reference")).distinct()
    both = pool.select("case_id", "reference", F.lit(0).alias("lane"), F.col("raw_score").alias("score")).unionByName(cited.select("case_id", "reference", F.lit(1).alias("lane"), F.lit(0.0).alias("score")))
    best = both.groupBy("case_id", "reference").agg(F.min(F.struct("lane", "score")).alias("b")).join(units.select("reference", "canonical_order"), "reference")
    return evaluate.ranked(best.select("case_id", "reference", "b.lane", "b.score", "canonical_order"), ["lane", "score", "canonical_order"]).select("case_id", "reference", "rank")


def report(snapshot: Snapshot, cases: DataFrame, judgments: DataFrame, depths=evaluate.DEPTHS) -> dict:
    """A report over cases (case_id, split, query) and judgments (case_id, reference, grade), with the digests that it stands for."""
    depths = evaluate.checked_depths(depths)
    twice = cases.groupBy("case_id").count().where("count > 1").limit(1).collect()
    if twice or cases.isEmpty():
        raise ValueError("cases are needed, each under its own id")
    graded = evaluate.grades(rankings(snapshot, cases), judgments).cache()
    judgments = judgments.cache()
    tables = [evaluate.precision_recall(cases, graded, judgments, depths), evaluate.ndcg(cases, graded, judgments, depths)]
    metrics: dict = {}
    for r in (r for t in tables for r in t.collect()):
        metrics.setdefault(r.case_id, {}).update({f"{k}_at_{r.depth}": v for k, v in r.asDict().items() if k not in ("case_id", "depth")})
    for r in evaluate.mrr(cases, graded).collect():
        metrics.setdefault(r.case_id, {})["mrr"] = r.mrr
    cover = {r.case_id: r.judgment_coverage for r in evaluate.coverage(cases, graded).collect()}
    ranked: dict = {}
    for r in graded.orderBy("case_id", "rank").collect():
        ranked.setdefault(r.case_id, []).append((r.reference, r.judged))
    reasons = [r.reason for r in evaluate.eligibility(cases, graded).collect()]
    rows = sorted(cases.collect(), key=lambda r: r.case_id)
    results = [{"case_id": c.case_id, "split": c.split, "ranked_references": [x for x, _ in ranked.get(c.case_id, [])], "unjudged_candidates": sorted(x for x, j in ranked.get(c.case_id, []) if not j), "judgment_coverage": cover[c.case_id], "metrics": metrics[c.case_id]} for c in rows]
    code = sha256(inspect.getsource(evaluate) + inspect.getsource(inspect.getmodule(report)))
    identities = {
        "corpus_version": snapshot.record["corpus_version"], "retrieval_config": snapshot.record["retrieval_config"],
        "case_definitions_digest": sha256(canonical([[c.case_id, c.split, c["query"]] for c in rows])),
        "judgment_digest": sha256(canonical(sorted([r.case_id, r.reference, r.grade] for r in judgments.collect()))),
        "annotation_digest": sha256(canonical([[c.case_id, *(c.asDict().get(k) for k in ("curator_rationale", "non_authoritative_notes"))] for c in rows])),
        "evaluator_code_digest": code, "metric_depths_digest": sha256(canonical(depths)),
    }
    core = {"schema_version": 1, "identities": identities, "metric_depths": depths, "cases": results, "eligible": not reasons, "ineligibility_reasons": reasons, "unjudged_candidates": sorted({x for r in results for x in r["unjudged_candidates"]})}
    return {**core, "report_digest": sha256(canonical(core))}


def publish(store: Store, folder: str, made: dict) -> str:
    """Writes a report under its digest; a file of that name must already say the same."""
    name, text = f"{folder}/{made['report_digest']}.json", canonical(made) + "\n"
    store.make(folder)
    if (there := store.read(name)) is None:
        store.create(name, text)
    elif there != text:
        raise ValueError("another report has this digest")
    return name


PATHS = ("atomic", "combined")


LANES = (["lexical"], ["lexical", "official"])


def checked_probe(questions: list[dict], lanes: list[str]) -> None:
    """Refuses a probe without questions, with an id twice, with a pool that is empty, repeats or names ranges, or with other lanes than those that exist."""
    if lanes not in LANES:
        raise ValueError("a probe's lanes are lexical, or lexical and official")
    ids = [q.get("id") for q in questions]
    if not ids or len(set(ids)) != len(ids) or any(not isinstance(i, str) or not re.fullmatch("[A-Za-z0-9._-]{1,128}", i) for i in ids):
        raise ValueError("a probe has questions, each under an id of its own")
    for q in questions:
        pool = q.get("pool") or []
        if not pool or len(set(pool)) != len(pool):
            raise ValueError(f"the pool of {q['id']} is empty or repeats")
        for reference in pool:
            if Q.split_reference(reference)[3] is not None:
                raise ValueError(f"{reference} is a range; a pool names single references")
        Q.LexicalRequest(query=q.get("query", ""))


def probe(service: Service, questions: list[dict], lanes: list[str]) -> dict:
    """Answers questions ({id, query, pool, hops}) by single operations and by evidence search, and audits both.

    The atomic path looks up, widens, searches and traverses; the combined one
    makes one request. Coverage is of each question's pool; citations are looked
    up again and compared; lanes other than the locked ones are errors.
    """
    checked_probe(questions, lanes)
    spark = service.catalog.spark
    out = []
    for q in questions:
        found = service.search_lexical(Q.LexicalRequest(query=q["query"], limit=100))
        atomic = list(found["records"])
        for r in found["records"][: q.get("hops", 5)]:
            at = r["passage"]["reference"]
            atomic += service.get_passage(Q.PassageRequest(reference=at))["records"]
            atomic += service.get_context(Q.ContextRequest(reference=at, before=1, after=1))["records"]
            atomic += service.traverse_references(Q.TraversalRequest(reference=at))["records"]
        combined = service.search_evidence(Q.EvidenceRequest(query=q["query"], limit=100, lanes=lanes))["records"]
        returned = [(p, i, r["passage"]["reference"], r["passage"]["text"], r["passage"]["content_hash"]) for p, rs in zip(PATHS, (atomic, combined)) for i, r in enumerate(rs)]
        bases = [(b["lane"],) for rs in (atomic, combined) for r in rs for b in r["basis"]]
        rows = spark.createDataFrame(returned, "path string, pos int, reference string, text string, content_hash string")
        units = service.catalog.pin().table("units")
        pool = spark.createDataFrame([(r,) for r in q["pool"]], "reference string")
        out.append({
            "id": q["id"],
            "coverage": {r.path: r.coverage for r in evaluate.pool_coverage(rows, pool).collect()},
            "citation_errors": evaluate.citations(rows.dropDuplicates(["reference", "text", "content_hash"]), units).count(),
            "class_errors": evaluate.class_audit(spark.createDataFrame(bases, "lane string"), lanes).where("NOT allowed").count() if bases else 0,
        })
    core = {"schema_version": 1, "lanes": lanes, "questions": out}
    return {**core, "report_digest": sha256(canonical(core))}


def percentile(samples: list[float], q: float) -> float:
    """Nearest rank."""
    return sorted(samples)[max(0, math.ceil(len(samples) * q) - 1)]


def latencies(service: Service, reference: str, query: str, warmup: int = 2, iterations: int = 20) -> dict:
    """p50 and p95 in milliseconds of lookup, context, lexical search, traversal and evidence search, one at a time and warm."""
    Q.within("warmup", warmup, 0, 100)
    Q.within("iterations", iterations, 1, 1000)
    operations = {
        "passage_lookup": lambda: service.get_passage(Q.PassageRequest(reference=reference)),
        "context_lookup": lambda: service.get_context(Q.ContextRequest(reference=reference)),
        "lexical_search": lambda: service.search_lexical(Q.LexicalRequest(query=query)),
        "official_traversal": lambda: service.traverse_references(Q.TraversalRequest(reference=reference)),
        "evidence_search": lambda: service.search_evidence(Q.EvidenceRequest(query=query)),
    }
    out = {}
    for name, run in operations.items():
        times = []
        for k in range(warmup + iterations):
            start = time.perf_counter()
            run()
            if k >= warmup:
                times.append((time.perf_counter() - start) * 1000)
        out[name] = {"p50_ms": percentile(times, 0.5), "p95_ms": percentile(times, 0.95), "iterations": iterations, "warmup": warmup}
    return {"operations": out, "acceptance_gate": False}
