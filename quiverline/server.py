"""A small HTTP front over collections, by the standard library."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from quiverline.sources.collection import Collection
from quiverline.sources.files import Store
from quiverline.types import CollectionConfig, Metric, VectorError

_ROUTE = re.compile(r"/collections/([A-Za-z0-9_-]+)(/insert|/search)?")


class Registry:
    """Open collections under one folder; those that are there already are opened when asked for."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.open, self.lock = spark, base.rstrip("/"), {}, threading.Lock()

    def create(self, name: str, dimension: int, metric: Metric) -> None:
        self.open[name] = Collection.open_or_create(self.spark, f"{self.base}/{name}", CollectionConfig(dimension, metric))

    def get(self, name: str) -> Collection | None:
        if name not in self.open:
            store = Store(self.spark, f"{self.base}/{name}")
            if not store.exists("meta.json"):
                return None
            meta = json.loads(store.read("meta.json"))
            self.create(name, meta["dimension"], Metric.of(meta["metric"]))
        return self.open[name]

    def handle(self, path: str, body: dict) -> tuple[int, object]:
        m = _ROUTE.fullmatch(path)
        if not m:
            return 404, {"error": "Not found"}
        name, action = m[1], m[2]
        try:
            with self.lock:
                if action is None:
                    try:
                        metric = Metric.of(body.get("metric", "cosine"))
                    except ValueError:
                        return 400, {"error": "Invalid metric"}
                    self.create(name, int(body["dimension"]), metric)
                    return 201, {}
                if (collection := self.get(name)) is None:
                    return 404, {"error": "Collection not found"}
                if action == "/insert":
                    payload = body.get("payload")
                    if payload is not None and not isinstance(payload, dict):
                        return 400, {"error": "Payload must be a JSON object"}
                    collection.insert(body["id"], body["vector"], payload)
                    return 200, {}
                rows = collection.search(body["vector"], int(body["k"])).select("id", "distance").collect()
                return 200, [{"id": r["id"], "distance": r["distance"]} for r in rows]
        except (KeyError, TypeError, ValueError) as e:
            return (500 if isinstance(e, VectorError) else 400), {"error": str(e)}


def serve(spark: SparkSession, base: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Start on a thread of its own; ``server_address`` has the port, ``shutdown`` ends it."""
    registry = Registry(spark, base)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                code, answer = registry.handle(self.path, body)
            except ValueError:
                code, answer = 400, {"error": "Invalid JSON"}
            data = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
