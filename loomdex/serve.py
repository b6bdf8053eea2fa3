"""Search from the command line or over HTTP: python -m loomdex.serve INDEX [PORT]."""

from __future__ import annotations

import json
import sys
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from loomdex.operators.index import Index, read
from loomdex.operators.search import search


def answer(spark, index: Index, q: str) -> dict:
    """{"results": [[title, url], ...], "time": ms}; an empty query has no results."""
    began = time.perf_counter()
    rows = search(index, spark.createDataFrame([(0, q)], "query_id long, q string")).orderBy("rank").collect() if q.strip() else []
    return {"results": [[r.title, r.url] for r in rows], "time": (time.perf_counter() - began) * 1000}


def respond(spark, index: Index, target: str) -> tuple[int, object]:
    """(status, body) of GET target: without q 404, for an empty q an empty list."""
    url = urlparse(target)
    q = parse_qs(url.query, keep_blank_values=True).get("q")
    if url.path not in ("", "/") or not q:
        return 404, {"error": "not found"}
    return 200, answer(spark, index, q[0]) if q[0] else []


def serve(spark, index: Index, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = respond(spark, index, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loomdex").getOrCreate()
    index = read(spark, args[0])
    if args[1:]:
        serve(spark, index, int(args[1])).serve_forever()
    while (q := input("> ")) != "Done":
        got = answer(spark, index, q)
        print(f"{got['time']:.0f} ms")
        for title, url in got["results"]:
            print(f"{title}\n\t{url}")


if __name__ == "__main__":
    main(sys.argv[1:])
