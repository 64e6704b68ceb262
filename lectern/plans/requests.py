"""Requests of the service, checked where they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lectern.errors import InvalidQueryError, LimitExceededError
from lectern.functions.references import BOOKS

IDENTIFIER = re.compile(r"[A-Za-z0-9._-]{1,128}")
REFERENCE = re.compile(r"bofm/([a-z0-9-]+)/([1-9]\d*)/([1-9]\d*)(?:-([1-9]\d*))?")
#: What a service accepts, at most; fixed values of the contract.
BOUNDS = {"query_characters": 512, "search_limit": 100, "context_neighbor_limit": 40, "traversal_depth": 3, "traversal_nodes": 200, "books_filter": 15, "reference_ranges_filter": 50}


def split_reference(value: str) -> tuple[str, int, int, int | None]:
    """(book, chapter, verse, end) of a reference to a known book."""
    m = REFERENCE.fullmatch(value or "")
    if not m or m[1] not in BOOKS["bofm"] or (m[4] and int(m[4]) < int(m[3])):
        raise InvalidQueryError(f"invalid reference {value!r}")
    return m[1], int(m[2]), int(m[3]), int(m[4]) if m[4] else None


def within(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool):
        raise InvalidQueryError(f"{name} is a number")
    if not low <= value <= high:
        raise LimitExceededError(f"{name} lies between {low} and {high}")


@dataclass(frozen=True, kw_only=True)
class Pinned:
    """Both of corpus_version and retrieval_config, or neither for the active pair."""

    corpus_version: str | None = None
    retrieval_config: str | None = None

    def __post_init__(self):
        if (self.corpus_version is None) != (self.retrieval_config is None):
            raise InvalidQueryError("corpus_version and retrieval_config come together")
        for v in (self.corpus_version, self.retrieval_config):
            if v is not None and not IDENTIFIER.fullmatch(v):
                raise InvalidQueryError(f"invalid identifier {v!r}")
        self.check()

    def check(self) -> None:
        pass


@dataclass(frozen=True, kw_only=True)
class PassageRequest(Pinned):
    reference: str

    def check(self):
        split_reference(self.reference)


@dataclass(frozen=True, kw_only=True)
class ContextRequest(PassageRequest):
    before: int = 3
    after: int = 3

    def check(self):
        super().check()
        within("before", self.before, 0, 20)
        within("after", self.after, 0, 20)


@dataclass(frozen=True, kw_only=True)
class SearchRequest(Pinned):
    query: str
    books: list[str] | None = None
    reference_ranges: list[str] | None = None
    limit: int = 20
    cursor: str | None = None

    def check(self):
        object.__setattr__(self, "query", (self.query or "").strip())
        if not self.query:
            raise InvalidQueryError("an empty query")
        within("the query's length", len(self.query), 1, BOUNDS["query_characters"])
        within("limit", self.limit, 1, BOUNDS["search_limit"])
        for name, values, most in (("books", self.books, BOUNDS["books_filter"]), ("reference_ranges", self.reference_ranges, BOUNDS["reference_ranges_filter"])):
            if values is not None:
                within(f"the number of {name}", len(values), 1, most)
                if len(set(values)) != len(values):
                    raise InvalidQueryError(f"{name} repeat")
        if unknown := set(self.books or ()) - set(BOOKS["bofm"]):
            raise InvalidQueryError(f"unknown books {sorted(unknown)}")
        for r in self.reference_ranges or ():
            split_reference(r)
        if self.cursor is not None and not 1 <= len(self.cursor) <= 4096:
            raise InvalidQueryError("invalid cursor")


@dataclass(frozen=True, kw_only=True)
class LexicalRequest(SearchRequest):
    mode: str = "terms"
    near_distance: int | None = None

    def check(self):
        super().check()
        if self.mode not in ("phrase", "terms", "prefix", "near"):
            raise InvalidQueryError(f"unknown mode {self.mode!r}")
        if self.mode == "near":
            object.__setattr__(self, "near_distance", 5 if self.near_distance is None else self.near_distance)
            within("near_distance", self.near_distance, 1, 20)
        elif self.near_distance is not None:
            raise InvalidQueryError("near_distance goes with near only")


@dataclass(frozen=True, kw_only=True)
class TraversalRequest(PassageRequest):
    direction: str = "outbound"
    max_depth: int = 1
    max_nodes: int = 50
    include_external: bool = True

    def check(self):
        super().check()
        if self.direction not in ("outbound", "inbound", "both"):
            raise InvalidQueryError(f"unknown direction {self.direction!r}")
        within("max_depth", self.max_depth, 0, BOUNDS["traversal_depth"])
        within("max_nodes", self.max_nodes, 1, BOUNDS["traversal_nodes"])


@dataclass(frozen=True, kw_only=True)
class EvidenceRequest(SearchRequest):
    lanes: list[str] = field(default_factory=lambda: ["lexical", "official"])
    official_depth: int = 1

    def check(self):
        super().check()
        if self.lanes not in (["lexical"], ["lexical", "official"]):
            raise InvalidQueryError("lanes are lexical, or lexical and official")
        within("official_depth", self.official_depth, 0, BOUNDS["traversal_depth"])
