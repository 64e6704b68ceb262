"""The service over HTTP routes and over a line protocol of tools; the standard library only.

``handle`` maps a route to an operation for any server; ``serve`` binds it to the
loopback interface. ``tools`` speaks JSON-RPC 2.0, a message a line, with one tool
an operation.
"""

from __future__ import annotations

import json
from dataclasses import MISSING, fields
from urllib.parse import parse_qsl, unquote, urlsplit

from lectern.errors import EvidenceError, InvalidQueryError
from lectern.plans import requests as Q
from lectern.plans.service import Service

TOOLS = {"get_corpus": Q.Pinned, "get_passage": Q.PassageRequest, "get_context": Q.ContextRequest, "search_lexical": Q.LexicalRequest, "traverse_references": Q.TraversalRequest, "search_evidence": Q.EvidenceRequest}
POSTS = {"/v1/search/lexical": "search_lexical", "/v1/references/traverse": "traverse_references", "/v1/evidence/search": "search_evidence"}
MOST_BYTES = 1 << 20


def call(service: Service, operation: str, arguments: dict) -> dict:
    """One operation with a request of plain values; unknown fields are refused."""
    kind = TOOLS.get(operation)
    if kind is None:
        raise InvalidQueryError(f"unknown operation {operation!r}")
    if not isinstance(arguments, dict) or set(arguments) - {f.name for f in fields(kind)}:
        raise InvalidQueryError("the request has fields that the operation doesn't")
    if missing := [f.name for f in fields(kind) if f.name not in arguments and f.default is MISSING and f.default_factory is MISSING]:
        raise InvalidQueryError(f"the request lacks {missing}")
    return getattr(service, operation)(kind(**arguments))


def _problem(error: Exception) -> tuple[int, dict]:
    known = isinstance(error, EvidenceError)
    return (error.status if known else 500), {"error": {"code": error.code if known else "internal_error", "message": str(error) if known else "internal error"}}


def handle(service: Service, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and answer of a request: GET /v1/corpus, /v1/passages/{reference}[/context], POST searches and traversals."""
    url = urlsplit(target)
    query: dict = dict(parse_qsl(url.query))
    try:
        if method == "GET" and url.path == "/v1/corpus":
            return 200, call(service, "get_corpus", query)
        if method == "GET" and url.path.startswith("/v1/passages/"):
            reference = unquote(url.path.removeprefix("/v1/passages/"))
            operation = "get_passage"
            if reference.endswith("/context"):
                operation, reference = "get_context", reference.removesuffix("/context")
                for k in ("before", "after"):
                    if k in query:
                        if not query[k].isdigit():
                            raise InvalidQueryError(f"{k} is a number")
                        query[k] = int(query[k])
            return 200, call(service, operation, {**query, "reference": reference})
        if method == "POST" and url.path in POSTS:
            if len(body) > MOST_BYTES:
                raise InvalidQueryError("the body is too large")
            try:
                arguments = json.loads(body)
            except ValueError as e:
                raise InvalidQueryError("the body is no JSON") from e
            return 200, call(service, POSTS[url.path], arguments)
    except Exception as e:  # answered with its code; the server goes on
        return _problem(e)
    return 404, {"error": {"code": "not_found", "message": "no such route"}}


def serve(service: Service, port: int = 8000):
    """A server on the loopback interface; the caller runs serve_forever()."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            host = (self.headers.get("Host") or "").rpartition(":")[0] or self.headers.get("Host")
            origin = self.headers.get("Origin")
            if host not in ("127.0.0.1", "localhost", "[::1]") or (origin and urlsplit(origin).hostname not in ("127.0.0.1", "localhost", "::1")):
                status, answer = 403, {"error": {"code": "forbidden", "message": "loopback only"}}
            else:
                size = min(int(self.headers.get("Content-Length") or 0), MOST_BYTES + 1)
                status, answer = handle(service, self.command, self.path, self.rfile.read(size))
            raw = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def _schema(kind) -> dict:
    names = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}
    return {"type": "object", "additionalProperties": False, "properties": {f.name: {"type": names[str(f.type).split(" | ")[0]]} for f in fields(kind)}, "required": [f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING]}


def tools(service: Service, lines, write) -> None:
    """Answers JSON-RPC messages of ``lines`` with ``write``: initialize, tools/list, tools/call."""
    for line in lines:
        if not line.strip():
            continue
        message = json.loads(line)
        if "id" not in message:
            continue
        method, p = message.get("method"), message.get("params") or {}
        answer: dict = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            answer["result"] = {"protocolVersion": p.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lectern", "version": "0.1.0"}}
        elif method == "tools/list":
            answer["result"] = {"tools": [{"name": n, "description": (getattr(Service, n).__doc__ or n.replace("_", " ")).strip(), "inputSchema": _schema(k)} for n, k in TOOLS.items()]}
        elif method == "tools/call":
            try:
                made, bad = call(service, p.get("name"), p.get("arguments") or {}), False
            except Exception as e:  # a tool's error is its answer
                made, bad = _problem(e)[1], True
            answer["result"] = {"content": [{"type": "text", "text": json.dumps(made, ensure_ascii=False, default=str)}], "structuredContent": made, "isError": bad}
        else:
            answer["error"] = {"code": -32601, "message": "method not found"}
        write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
