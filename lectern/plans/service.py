"""The six read operations over a pinned snapshot; each collects once, at its end."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict

from pyspark.sql import functions as F

from lectern.errors import InvalidQueryError, PassageNotFoundError
from lectern.operators import graph, lookup, search
from lectern.plans.requests import BOUNDS, ContextRequest, EvidenceRequest, LexicalRequest, PassageRequest, Pinned, SearchRequest, TraversalRequest
from lectern.plans.snapshots import Catalog, Snapshot, canonical

OPERATIONS = ["get_corpus", "get_passage", "get_context", "search_lexical", "traverse_references", "search_evidence"]
#: Keeps cursors of this format apart from others.
NAMESPACE = b"lectern-cursor-1\0"


def fingerprint(operation: str, snapshot: Snapshot, request: SearchRequest) -> str:
    rest = {k: v for k, v in asdict(request).items() if k != "cursor"}
    return hashlib.sha256(canonical({"operation": operation, "corpus_version": snapshot.record["corpus_version"], "retrieval_config": snapshot.record["retrieval_config"], "request": rest}).encode()).hexdigest()


def encode_cursor(mark: str, lane: int, score: float, order: int) -> str:
    body = canonical({"fingerprint": mark, "lane_priority": lane, "raw_score": score, "canonical_order": order}).encode()
    sealed = {"body": base64.urlsafe_b64encode(body).decode(), "checksum": hashlib.sha256(NAMESPACE + body).hexdigest()}
    return base64.urlsafe_b64encode(canonical(sealed).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, mark: str) -> tuple[int, float, int]:
    """(lane, score, order) behind a cursor of the same request; the checksum guards against damage, not against forgery."""
    try:
        sealed = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        body = base64.urlsafe_b64decode(sealed["body"])
        if not hmac.compare_digest(hashlib.sha256(NAMESPACE + body).hexdigest(), sealed["checksum"]):
            raise ValueError
        at = json.loads(body)
        if at["fingerprint"] != mark:
            raise ValueError
        return int(at["lane_priority"]), float(at["raw_score"]), int(at["canonical_order"])
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidQueryError("the cursor is not of this request") from e


class Service:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def _pin(self, request: Pinned) -> Snapshot:
        return self.catalog.pin(request.corpus_version, request.retrieval_config)

    @staticmethod
    def _answer(snapshot: Snapshot, records, applied, truncated=False, cursor=None, frontier=(), **more) -> dict:
        return {"records": records, "corpus_version": snapshot.record["corpus_version"], "retrieval_config": snapshot.record["retrieval_config"], "applied": applied, "completeness": {"truncated": truncated, "cursor": cursor, "frontier": list(frontier)}, "official_edges": [], **more}

    @staticmethod
    def _record(snapshot: Snapshot, row, basis: list[dict], context=()) -> dict:
        passage = {k: v for k, v in row.asDict(recursive=True).items() if k in ("reference", "book", "canonical_order", "text", "content_hash", "source_spans")}
        manifest = snapshot.record["manifest"]
        provenance = {"edition": manifest["source_approval"].get("edition"), "source_sha256": manifest["source_approval"].get("source_sha256"), "artifact_digest": manifest["artifact_digest"]}
        return {"passage": passage, "context": [c.asDict(recursive=True) for c in context], "basis": basis, "provenance": provenance}

    def _one(self, snapshot: Snapshot, reference: str):
        row = lookup.get_passage(snapshot.table("units"), reference).first()
        if row is None:
            raise PassageNotFoundError(reference)
        return row

    def get_corpus(self, request: Pinned = Pinned()) -> dict:
        s = self._pin(request)
        manifest, approval = s.record["manifest"], s.record["manifest"]["source_approval"]
        return {
            "corpus_version": s.record["corpus_version"], "retrieval_config": s.record["retrieval_config"], "edition": approval.get("edition"), "language": approval.get("language"), "source_sha256": approval.get("source_sha256"),
            "schema_version": manifest["schema_version"], "importer_version": manifest["importer_version"], "enabled_lanes": s.record["config"]["lanes"], "supported_operations": OPERATIONS, "bounds": BOUNDS, "accepted_at": s.record["accepted_at"],
        }

    def get_passage(self, request: PassageRequest) -> dict:
        s = self._pin(request)
        row = self._one(s, request.reference)
        basis = [{"lane": "lexical", "match_kind": "exact_lookup", "tie_break": row.canonical_order}]
        return self._answer(s, [self._record(s, row, basis)], {"operation": "get_passage", "reference": request.reference})

    def get_context(self, request: ContextRequest) -> dict:
        s = self._pin(request)
        row = self._one(s, request.reference)
        around = lookup.get_context(s.table("units"), row.canonical_order, request.before, request.after).collect()
        basis = [{"lane": "lexical", "match_kind": "context_lookup", "tie_break": row.canonical_order}]
        return self._answer(s, [self._record(s, row, basis, around)], {"operation": "get_context", "before": request.before, "after": request.after})

    def _filtered(self, s: Snapshot, request: SearchRequest):
        """What a request's filters make of hits (doc, raw_score), joined with their units; statistics are the whole corpus's."""
        units = s.table("units")
        bounds = None
        if request.reference_ranges is not None:
            ranges = []
            for r in request.reference_ranges:
                chapter, _, verses = r.rpartition("/")
                first, _, last = verses.partition("-")
                ranges.append((f"{chapter}/{first}", f"{chapter}/{last or first}"))
            bounds = search.range_bounds(units, ranges)
            if bounds.where("lo is null or hi is null").limit(1).count():
                raise InvalidQueryError("a reference range is not in the corpus")

        def keep(hits):
            found = search.with_units(hits, units)
            if request.books is not None:
                found = search.in_books(found, request.books)
            return found if bounds is None else search.in_ranges(found, bounds)

        return keep

    def search_lexical(self, request: LexicalRequest) -> dict:
        s = self._pin(request)
        mark = fingerprint("search_lexical", s, request)
        filtered, key = self._filtered(s, request), decode_cursor(request.cursor, mark) if request.cursor is not None else None
        keep = filtered if key is None else lambda hits: search.after(filtered(hits), key[1], key[2])
        if request.mode == "terms":
            hits = search.best(s.table("blocks"), s.table("stats"), request.query, request.limit, keep)[0]
        else:
            hits = search.search(s.table("blocks"), s.table("stats"), request.query, request.mode, request.near_distance)
        rows = search.top(keep(hits), request.limit).collect()
        page, more = rows[: request.limit], len(rows) > request.limit
        records = [self._record(s, r, [{"lane": "lexical", "match_kind": request.mode, "raw_score": r.raw_score, "score_components": {"bm25": r.raw_score}, "tie_break": r.canonical_order}]) for r in page]
        cursor = encode_cursor(mark, 0, page[-1].raw_score, page[-1].canonical_order) if more else None
        applied = {"operation": "search_lexical", "mode": request.mode, "near_distance": request.near_distance, "limit": request.limit, "filters": {"books": request.books, "reference_ranges": request.reference_ranges}}
        return self._answer(s, records, applied, more, cursor)

    def traverse_references(self, request: TraversalRequest) -> dict:
        s = self._pin(request)
        self._one(s, request.reference)
        walk = graph.traverse(s.table("adjacency"), request.reference, request.direction, request.max_depth, request.max_nodes)
        rows = walk["nodes"].join(s.table("units"), walk["nodes"].node == F.col("reference")).orderBy("rank").collect()
        edges = walk["edges"].join(s.table("edges"), "edge_id").orderBy("first").collect()
        frontier = sorted(r.node for r in walk["frontier"].collect())
        outside = sorted(r.external_key for r in walk["externals"].collect()) if request.include_external else []
        kind = lambda r: "official_reference" if r.path else "traversal_origin"
        records = [self._record(s, r, [{"lane": "official", "match_kind": kind(r), "tie_break": r.canonical_order, "relationship_path": r.path}]) for r in rows]
        applied = {"operation": "traverse_references", "direction": request.direction, "max_depth": request.max_depth, "max_nodes": request.max_nodes, "include_external": request.include_external}
        return self._answer(s, records, applied, bool(frontier), None, frontier, external_targets=outside) | {"official_edges": [e.asDict(recursive=True) for e in edges]}

    def search_evidence(self, request: EvidenceRequest) -> dict:
        """Lexical hits, the best of them up to the pool's size, and what these cite; filters bind the hits only."""
        s = self._pin(request)
        mark = fingerprint("search_evidence", s, request)
        key = decode_cursor(request.cursor, mark) if request.cursor is not None else None
        size = int(s.record["config"]["lexical"]["candidate_pool_size"])
        keep = self._filtered(s, request)
        found = search.top(keep(search.best(s.table("blocks"), s.table("stats"), request.query, size, keep)[0]), size).select("reference", "canonical_order", "raw_score").collect()
        overflow, pool_rows = len(found) > size, found[:size]  # at most the pool's size
        spark = s.spark
        pool = spark.createDataFrame([(r.canonical_order, r.raw_score) for r in pool_rows], "canonical_order long, raw_score double")
        units = s.table("units")
        official = spark.createDataFrame([], "canonical_order long, seed_rank long, node_rank array<long>, path array<string>")
        edge_rows = []
        if "official" in request.lanes and request.official_depth and pool_rows:
            seeds = spark.createDataFrame([(k, r.reference) for k, r in enumerate(pool_rows)], "seed long, node string")
            nodes, touched = graph.expanded(s.table("adjacency"), seeds, "outbound", request.official_depth)
            orders = units.select(F.col("reference").alias("node"), "canonical_order")
            official = nodes.where("depth > 0").join(orders, "node").select("canonical_order", F.col("seed").alias("seed_rank"), F.col("rank").alias("node_rank"), "path")
            edge_rows = touched.select("edge_id").distinct().join(s.table("edges"), "edge_id").orderBy("edge_id").collect()
        ranked = graph.page_after(graph.merged(pool, official), key, request.limit)
        rows = ranked.join(units, "canonical_order").orderBy("lane_priority", "best_score", "canonical_order").collect()
        page, more = rows[: request.limit], len(rows) > request.limit
        cursor = encode_cursor(mark, page[-1].lane_priority, page[-1].best_score, page[-1].canonical_order) if more else None

        def basis(r):
            return [{"lane": "lexical", "match_kind": "terms", "raw_score": b.score, "tie_break": r.canonical_order} if b.lane == "lexical" else {"lane": "official", "match_kind": "official_reference", "tie_break": r.canonical_order, "relationship_path": b.path} for b in r.basis]

        records = [self._record(s, r, basis(r)) for r in page]
        applied = {"operation": "search_evidence", "lanes": request.lanes, "official_depth": request.official_depth, "candidate_pool_size": size, "limit": request.limit, "filters": {"books": request.books, "reference_ranges": request.reference_ranges}}
        return self._answer(s, records, applied, more or overflow, cursor) | {"official_edges": [e.asDict(recursive=True) for e in edge_rows]}
