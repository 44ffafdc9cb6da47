"""An endpoint over an engine: results documents under a server's limits, and a small HTTP server for it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from quadrille.engine import Engine
from quadrille.operators import sampling
from quadrille.operators.paging import Budget, Page
from quadrille.sources.results import to_json

DESCRIPTION = """@prefix sd: <http://www.w3.org/ns/sparql-service-description#> .
[] a sd:Service ; sd:supportedLanguage sd:SPARQL11Query ; sd:resultFormat <http://www.w3.org/ns/formats/SPARQL_Results_JSON> .
"""


@dataclass
class Endpoint:
    """``mode``: ``pages`` answers within the budget and with a continuation, ``walks`` samples, ``whole`` answers all.

    ``limits`` bound every request; a request's own limits only lower them.  ``attempts`` bounds a request's walks.
    """

    engine: Engine
    mode: str = "pages"
    limits: Budget = field(default_factory=Budget)
    attempts: int = 10_000

    def query(self, text: str | None, timeout: float | None = None, limit: int | None = None, attempts: int | None = None,
              seed: int = 0) -> str:
        """A results document; without a query, the service description in Turtle.  ``timeout`` is in seconds."""
        if not text:
            return DESCRIPTION
        if self.mode == "walks":
            n = min(self.attempts, attempts or self.attempts)
            query = self.engine.plan(text)
            try:
                df = sampling.estimate(self.engine, text, n, seed)
            except sampling.UnsupportedQuery:
                df = sampling.walk(self.engine, text, n, seed)
            names = query.names + ([sampling.PROBABILITY] if sampling.PROBABILITY in df.columns else [])
            rows = [r.asDict() for r in df.limit(n).collect()]
            return to_json(names, rows)
        if self.mode == "whole":
            df = self.engine.execute(text)
            return to_json(df.columns, (r.asDict() for r in df.toLocalIterator()))
        page = self.engine.page(text, self.limits.lowered(Budget(limit, None, timeout)))
        return to_json(page.names, page.rows, page)


def serve(endpoints: dict[str, Endpoint], port: int = 3330, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server, not yet running: GET or POST ``/name?query=...&timeout=ms&limit=n&attempts=n``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self._answer(urlsplit(self.path).query)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            plain = self.headers.get("Content-Type", "").startswith("application/sparql-query")
            self._answer(urlsplit(self.path).query, body if plain else None, None if plain else body)

        def _answer(self, query: str, text: str | None = None, form: str | None = None) -> None:
            args = {k: v[-1] for k, v in parse_qs(query + "&" + (form or "")).items()}
            # arguments may stand in headers as well
            args |= {k: self.headers[k] for k in ("timeout", "limit", "attempts") if self.headers.get(k) and k not in args}
            endpoint = endpoints.get(urlsplit(self.path).path.strip("/").split("/")[0])
            try:
                if endpoint is None:
                    return self._send(404, json.dumps({"error": "no such dataset"}), "application/json")
                whole = lambda k: int(args[k]) if k in args else None
                ms = whole("timeout")
                out = endpoint.query(text or args.get("query"), None if ms is None else ms / 1000, whole("limit"), whole("attempts"))
                self._send(200, out, "text/turtle" if out is DESCRIPTION else "application/sparql-results+json")
            except Exception as e:
                self._send(400, json.dumps({"error": f"{type(e).__name__}: {e}"[:500]}), "application/json")

        def _send(self, status: int, body: str, kind: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


__all__ = ["DESCRIPTION", "Endpoint", "Page", "serve"]
