"""HTTP routes and tools give what the service gives."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lectern import adapters
from lectern.plans import requests as Q
from tests.test_service import catalog, service  # noqa: F401  fixtures


def test_routes(service):  # noqa: F811
    same = lambda a, b: json.loads(json.dumps(a, default=str)) == json.loads(json.dumps(b, default=str))
    status, corpus = adapters.handle(service, "GET", "/v1/corpus")
    assert status == 200 and corpus == service.get_corpus()
    status, answer = adapters.handle(service, "GET", "/v1/passages/bofm/enos/1/3/context?before=2&after=1")
    assert status == 200 and same(answer, service.get_context(Q.ContextRequest(reference="bofm/enos/1/3", before=2, after=1)))
    status, answer = adapters.handle(service, "POST", "/v1/search/lexical", b'{"query": "lan", "mode": "prefix"}')
    assert status == 200 and same(answer, service.search_lexical(Q.LexicalRequest(query="lan", mode="prefix")))


@pytest.mark.parametrize(("method", "path", "body", "status", "code"), [
    ("GET", "/v1/passages/bofm/enos/4/1", b"", 404, "passage_not_found"),
    ("GET", "/v1/passages/bofm/enos/1/02", b"", 400, "invalid_query"),
    ("GET", "/v1/passages/bofm/enos/1/1/context?before=x", b"", 400, "invalid_query"),
    ("GET", "/v1/passages/bofm/enos/1/1/context?before=30", b"", 400, "limit_exceeded"),
    ("GET", "/v1/corpus?corpus_version=c&retrieval_config=d", b"", 404, "version_unavailable"),
    ("POST", "/v1/evidence/search", b"{", 400, "invalid_query"),
    ("POST", "/v1/evidence/search", b'{"query": "x", "extra": 1}', 400, "invalid_query"),
    ("POST", "/v1/references/traverse", b"{}", 400, "invalid_query"),
    ("POST", "/v1/nowhere", b"{}", 404, "not_found"),
])
def test_errors(service, method, path, body, status, code):  # noqa: F811
    got, answer = adapters.handle(service, method, path, body)
    assert (got, answer["error"]["code"]) == (status, code)


def test_server(service):  # noqa: F811
    server = adapters.serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/v1/corpus"
    with urllib.request.urlopen(url) as r:
        assert json.load(r)["enabled_lanes"] == ["lexical", "official"]
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(url, headers={"Host": "example.com"}))
    assert e.value.code == 403
    server.shutdown()


def test_tools(service):  # noqa: F811
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_passage", "arguments": {"reference": "bofm/enos/1/1"}}}, {"id": 4, "method": "tools/call", "params": {"name": "get_passage", "arguments": {"reference": "x"}}}, {"id": 5, "method": "other"}]
    said: list = []
    adapters.tools(service, [json.dumps(m) for m in asked], said.append)
    one, two, three, four, five = map(json.loads, said)
    assert one["result"]["capabilities"] == {"tools": {}} and len(two["result"]["tools"]) == 6
    assert three["result"]["structuredContent"]["records"][0]["passage"]["text"] == "The lantern burns above the quiet harbor."
    assert four["result"]["isError"] and four["result"]["structuredContent"]["error"]["code"] == "invalid_query"
    assert five["error"]["code"] == -32601
