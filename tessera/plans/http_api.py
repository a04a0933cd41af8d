"""HTTP: GET /health, GET /router/stats, POST /index/build, POST /search (exactly one of text and vector)."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from tessera.operators.router import RouterConfig
from tessera.plans.catalog import Catalog, Filters, result_json


class Api:
    """The requests without the transport, so that they can be tested."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog

    def handle(self, method: str, path: str, body: dict) -> tuple[int, dict]:
        try:
            if (method, path) == ("GET", "/health"):
                return 200, {"status": "ok", "loaded": self.catalog is not None}
            if (method, path) == ("POST", "/index/build"):
                config = RouterConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in body.get("config", {}).items()})
                self.catalog = Catalog.build(self.spark, body["csv"], body["output"], config=config, provider_name=body.get("provider", "hash"), dimension=body.get("dimension", 384))
                return 200, self.catalog.stats()
            if self.catalog is None:
                return 409, {"error": "no catalog is loaded"}
            if (method, path) == ("GET", "/router/stats"):
                return 200, self.catalog.stats()
            if (method, path) == ("POST", "/search"):
                return 200, self._search(body)
        except (KeyError, TypeError, ValueError) as error:
            return 422, {"error": str(error)}
        return 404, {"error": "there is no such path"}

    def _search(self, body: dict) -> dict:
        if (body.get("text") is None) == (body.get("vector") is None):
            raise ValueError("give either text or vector")
        options = {k: body[k] for k in ("top_k", "probe_shards", "all_results", "strategy", "evaluate") if k in body} | {"filters": Filters(**body.get("filters", {}))}
        outcome = self.catalog.search_text(body["text"], **options) if body.get("text") is not None else self.catalog.search_vector(body["vector"], **options)
        rows = result_json(outcome.results).orderBy("rank").collect()
        return {"route": outcome.evidence.first().asDict(), "results": [json.loads(r["json"]) for r in rows], "latency_ms": outcome.latency_ms}


def serve(spark: SparkSession, index: str | None, port: int = 8080) -> None:
    api = Api(spark, Catalog.load(spark, index) if index else None)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                status, value = api.handle(self.command, self.path, json.loads(self.rfile.read(size)) if size else {})
            except json.JSONDecodeError:
                status, value = 400, {"error": "the body is not JSON"}
            raw = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer  # noqa: N815

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
