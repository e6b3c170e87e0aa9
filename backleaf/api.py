"""Lookups over HTTP: GET /index/lookup/<key, 64 hex digits> on a stored index, and clients for it.

The server reads the key's bucket by itself, without a Spark job. `python -m backleaf.api URL NAME` prints an answer.
"""

from __future__ import annotations

import hashlib
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import DataFrame

from backleaf.functions import codec
from backleaf.plans.store import IndexStore

PATH = "/index/lookup/"


def answer(store: IndexStore, path: str, under: str = PATH) -> tuple[int, str]:
    """Status and body: 404 for other paths, 400 for a bad key, 500 where the index is not populated."""
    if not path.startswith(under):
        return 404, "not found"
    try:
        key = codec.parse_key(path[len(under) :])
    except ValueError as bad:
        return 400, str(bad)
    try:
        positions, _ = store.probe(key)
    except LookupError as none:
        return 500, str(none)
    return 200, codec.lookup_json(positions)


def serve(store: IndexStore, port: int = 0, host: str = "127.0.0.1", under: str = PATH) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, body = answer(store, self.path, under)
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if status == 200 else "text/plain")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            """Quiet."""

    return ThreadingHTTPServer((host, port), Handler)


def fetch(base_url: str, name: str, under: str = PATH) -> dict:
    """The answer for a key's name, which is hashed here; another status than 200 raises."""
    url = base_url.rstrip("/") + under + hashlib.sha256(name.encode()).hexdigest()
    try:
        with urlopen(url, timeout=60) as got:
            return json.loads(got.read())
    except HTTPError as bad:
        raise RuntimeError(f"lookup of {name!r} failed: {bad.code} {bad.read().decode()}") from bad


def fetch_many(names: DataFrame, base_url: str, under: str = PATH) -> DataFrame:
    """(name, body) for each name of the first column: the server's answer as text, asked for by the executors."""

    def asked(batches):
        import pyarrow as pa

        for b in batches:
            own = b.column(0).to_pylist()
            bodies = [json.dumps(fetch(base_url, n, under)) for n in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(bodies, pa.string())], names=["name", "body"])

    return names.select(names[0].cast("string").alias("name")).where("name is not null").mapInArrow(asked, "name string, body string")


def main() -> None:
    print(json.dumps(fetch(*sys.argv[1:3]), indent=2))


if __name__ == "__main__":
    main()
