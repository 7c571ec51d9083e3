"""Answers to single questions: over a table of points and model providers, from Python, the command line or HTTP."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import answers, registry, retrieval
from foliant.operators.answer_parse import parse_answers
from foliant.sources.providers import Chat, Embedder, asker, with_retries
from foliant.sources.settings import Settings

PAYLOAD = ("document_id", "source_file", "page_numbers", "page_start", "chunk_id", "chunk_type", "section_titles", "text")


@dataclass
class Answers:
    """What is needed to answer: points (point_id, vector and the payload of their chunks), providers and the known documents."""

    spark: SparkSession
    points: DataFrame
    embedder: Embedder
    chat: Chat
    known: DataFrame
    settings: Settings = Settings()

    def respond(self, question: str, companies: list[str] = (), chunk_types: list[str] = (), limit: int | None = None) -> dict:
        """mode, answer, reporting_period, resources, evidence, raw_response and duration_seconds. ValueError for an empty question or an unknown company."""
        started, question = time.perf_counter(), question.strip()
        if not question:
            raise ValueError("the question is empty")
        q = self.spark.createDataFrame([(1, question, list(companies), list(chunk_types))], "question_id int, question string, filters array<string>, types array<string>")
        named = registry.require_known(registry.resolve(q, self.known), self.known).select("question_id", F.col("documents").alias("given"))
        found = registry.detect(q, self.known).select("question_id", F.col("documents").alias("found"))
        q = q.join(named, "question_id").join(found, "question_id")
        # the documents that are named count before those found in the question
        q = q.withColumn("documents", F.when(F.size("given") > 0, F.col("given")).otherwise(F.col("found")))
        names = registry.company_names(q.select("question_id", F.posexplode("documents").alias("place", "document_id")), self.known)
        names = names.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "company"))).getField("company").alias("companies"))
        q = q.select("question_id", "question", "documents", "types").join(names, "question_id", "left")
        said = answers.answer(q, self.search, asker(self.chat), limit or self.settings.retrieval_limit)
        got = parse_answers(said).select("mode", "answer", "reporting_period", "resources", "evidence", F.col("response").alias("raw_response"))
        return {**json.loads(got.toJSON().first()), "duration_seconds": round(time.perf_counter() - started, 3)}

    def search(self, asked: DataFrame) -> DataFrame:
        """The chunks that a question gets which the gate let through; without one nothing is embedded or read."""
        row = asked.select("question", "documents", "limit").first()
        points = self.points if row else self.points.limit(0)
        meta = F.from_json(F.to_json("table_metadata"), "map<string,string>") if "table_metadata" in points.columns else F.lit(None).cast("map<string,string>")
        payload = points.select("point_id", *(c for c in PAYLOAD if c in points.columns), meta.alias("table_metadata"))
        if row:
            (vector,) = with_retries(lambda: self.embedder.embed([row.question]))
            q = asked.withColumns({"query_id": F.col("question_id"), "vector": F.array(*map(F.lit, map(float, vector)))})
            hits = retrieval.retrieve(points, q, row.limit, len(row.documents) > 1, document="document_id", chunk_type="chunk_type", chunk_types="types")
        else:
            hits = points.select(F.lit(1).alias("query_id"), "point_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return registry.company_names(hits.select("query_id", "point_id", "rank", "score").join(payload, "point_id"), self.known)

    def companies(self) -> list[dict]:
        return [json.loads(x) for x in self.known.orderBy("place").select("document_id", "company_name", "source_file", "aliases").toJSON().collect()]  # the registry: some documents


def server(own: Answers, reports: str, address: tuple[str, int] = ("127.0.0.1", 8000), origin: str = "") -> ThreadingHTTPServer:
    """A server of GET /health, /reports/{file}.pdf and /api/companies, and POST /api/answer; origin may read it from a browser."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), "X-Content-Type-Options": "nosniff", **({"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Headers": "*"} if origin else {}), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def _say(self, status: int, said) -> None:
            self._send(status, json.dumps(said, ensure_ascii=False).encode())

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send(204, b"")

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                return self._say(200, {"status": "ok"})
            if self.path == "/api/companies":
                return self._say(200, {"companies": own.companies()})
            if self.path.startswith("/reports/"):
                name = self.path.removeprefix("/reports/").replace("%20", " ")
                path = os.path.realpath(os.path.join(reports, name))
                # a plain name of a PDF that lies in the folder itself
                if name == os.path.basename(name) and name.lower().endswith(".pdf") and os.path.dirname(path) == os.path.realpath(reports) and os.path.isfile(path) and name.isprintable() and '"' not in name:
                    with open(path, "rb") as f:
                        return self._send(200, f.read(), "application/pdf", **{"Content-Disposition": f'inline; filename="{name}"', "Cache-Control": "public, max-age=3600"})
            return self._say(404, {"detail": "not found"})

        do_HEAD = do_GET  # noqa: N815

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/api/answer":
                return self._say(404, {"detail": "not found"})
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                limit = given.get("retrieval_limit")
                if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 50):
                    raise ValueError("retrieval_limit must be from 1 to 50")
                said = own.respond(str(given.get("question") or ""), given.get("company_filters") or [], given.get("chunk_types") or [], limit)
            except ValueError as e:
                return self._say(400, {"detail": str(e)})
            except Exception as e:  # noqa: BLE001
                return self._say(500, {"detail": f"no answer: {e}"})
            return self._say(200, said)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(address, Handler)
