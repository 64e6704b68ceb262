"""Errors of the service, by the code that callers see."""

from __future__ import annotations


class EvidenceError(Exception):
    """An error with a stable code and an HTTP status."""

    code = "internal_error"
    status = 500


class InvalidQueryError(EvidenceError):
    code, status = "invalid_query", 400


class InvalidReferenceError(EvidenceError):
    code, status = "invalid_reference", 400


class LimitExceededError(EvidenceError):
    code, status = "limit_exceeded", 400


class PassageNotFoundError(EvidenceError):
    code, status = "passage_not_found", 404


class CorpusUnavailableError(EvidenceError):
    code, status = "corpus_unavailable", 503


class VersionUnavailableError(EvidenceError):
    code, status = "version_unavailable", 404


class ConfigUnavailableError(EvidenceError):
    code, status = "config_unavailable", 409
