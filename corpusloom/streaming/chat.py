"""Questions that arrive one by one: as files of requests, over HTTP, and at a prompt.

The engine answers batches; a stream of requests gives it what has come since the last
batch. The server and the prompt ask one question at a time, for trying things out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.engine import Engine

REQUEST = "query_id string, query string"
#: Words that end a conversation at the prompt.
GOODBYE = ("exit", "quit", "keluar")


def answer_stream(spark: SparkSession, engine: Engine, requests: str, responses: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Answers the JSON requests (query_id, query) that come to a folder by JSON responses
    (query_id, response), in a folder for each batch.

    A request without a query asks the empty question, one without an id gets its query's
    hash for one. A batch that is tried again writes the same folder again."""

    def reply(batch: DataFrame, number: int) -> None:
        query = F.coalesce("query", F.lit(""))
        asked = batch.select(F.coalesce("query_id", F.md5(query)).alias("query_id"), query.alias("query")).dropDuplicates(["query_id"])
        engine.answer(asked).select("query_id", "response").write.mode("overwrite").json(f"{responses}/batch={number}")

    stream = spark.readStream.schema(REQUEST).json(requests).writeStream.foreachBatch(reply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def ask_one(engine: Engine, query: str) -> str:
    spark = engine.chunks.sparkSession
    return engine.answer(spark.createDataFrame([("1", query)], REQUEST)).first()["response"]


def chat_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of ``POST /chat`` with a body {query}, answered by {response}; a body without
    a query asks the empty question. The caller runs ``serve_forever``."""

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802  the library's name
            if self.path != "/chat":
                self.send_error(404)
                return
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                query = asked.get("query", "")
            except (ValueError, AttributeError):
                self.send_error(400)
                return
            body = json.dumps({"response": ask_one(engine, str(query))}, ensure_ascii=False).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Chat)


def converse(engine: Engine, lines: Iterable[str], write: Callable[[str], object] = print) -> int:
    """Answers lines until one says goodbye; blank ones are passed over. The number answered."""
    n = 0
    for line in lines:
        if (query := line.strip()).lower() in GOODBYE:
            break
        if query:
            write(ask_one(engine, query))
            n += 1
    return n
