"""python -m foliant: normalise and chunk layout files, embed chunks into a table of points, search it, answer from it, parse answers, judge them."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from foliant import service
from foliant.operators import chunking, layout, registry, retrieval
from foliant.operators.answer_parse import parse_answers
from foliant.operators.evaluation import answers as measures
from foliant.operators.evaluation import judge
from foliant.session import checkpointed, session
from foliant.sources import layout as files
from foliant.sources import ledger, providers, services, settings, sinks
from foliant.sources.prompts import prompts

#: An answered case, as judge reads it.
CASES = "case_id string, category_id string, category_name string, answer_expectation string, question string, generated_answer string, latency_seconds double, expected_document_ids array<string>, expected_documents array<struct<company_name:string,source_file:string>>"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant", description=__doc__)
    p.add_argument("--settings")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("chunk", help="layout files to chunks")
    c.add_argument("raw")
    c.add_argument("out")
    c = commands.add_parser("index", help="chunks to points, with vectors of hashed words, or of a model of the settings' embedding service (key in FOLIANT_KEY)")
    c.add_argument("chunks")
    c.add_argument("points")
    c.add_argument("--dimension", type=int, default=256)
    c.add_argument("--embedding-model", default="")
    c = commands.add_parser("search", help="the best chunks for a question")
    c.add_argument("points")
    c.add_argument("question")
    c.add_argument("--document", action="append", default=[])
    c.add_argument("--chunk-type", action="append", default=[])
    c.add_argument("--limit", type=int)
    c.add_argument("--threshold", type=float)
    c.add_argument("--balance", action="store_true")
    for name, what in (("answer", "the answer to a question"), ("serve", "answers over HTTP")):
        c = commands.add_parser(name, help=f"{what}, by the chat service of the settings (key in FOLIANT_KEY) or by recorded responses")
        c.add_argument("points")
        c.add_argument("--recorded", help="a JSON object of responses by kind: gate, topic, operation, location, answer")
        c.add_argument("--model", default="")
        c.add_argument("--embedding-model", default="")
        c.add_argument("--scope", default="the documents of this collection")
        if name == "answer":
            c.add_argument("question")
            c.add_argument("--company", action="append", default=[])
            c.add_argument("--chunk-type", action="append", default=[])
            c.add_argument("--limit", type=int)
        else:
            c.add_argument("--reports", default=".")
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
            c.add_argument("--origin", default="")
    c = commands.add_parser("judge", help="answered cases, one JSON object a line, scored by rules and by the chat service or recorded responses; a run that was stopped asks for what its ledger lacks")
    c.add_argument("cases")
    c.add_argument("out")
    c.add_argument("ledger")
    c.add_argument("--recorded", help="a JSON object with the response judge")
    c.add_argument("--model", default="")
    c.add_argument("--scope", default="the documents of this collection")
    c.add_argument("--per-second", type=float)
    c = commands.add_parser("parse", help="a file of responses, one JSON object with response a line, parsed")
    c.add_argument("responses")
    a = p.parse_args(argv)
    spark, known = session(), settings.load(a.settings)
    if a.command == "chunk":
        chunking.chunk_documents(layout.normalize(files.read_raw(spark, a.raw), materialize=True)).write.mode("overwrite").parquet(a.out)
    elif a.command == "index":
        rows = spark.read.parquet(a.chunks).withColumn("document_id", F.regexp_replace("chunk_id", "__c.*$", "")).withColumn("id", F.col("chunk_id"))
        embedder = services.HttpEmbedder(known.embedding_endpoint, os.environ.get("FOLIANT_KEY", ""), a.embedding_model) if a.embedding_model else providers.HashedWords(a.dimension)
        made = sinks.points(providers.embed(rows, embedder, chars=known.max_batch_characters))
        print(json.dumps(sinks.PointStore(spark, a.points, a.dimension).upsert(made)))
    elif a.command == "search":
        points = sinks.PointStore(spark, a.points, 0).read()
        dimension = points.select(F.size("vector").alias("n")).first().n
        q = spark.createDataFrame([(1, a.question, providers.HashedWords(dimension).embed([a.question])[0], a.document, a.chunk_type)], "query_id int, question string, vector array<double>, documents array<string>, types array<string>")
        if not a.document:
            q = q.drop("documents").join(registry.detect(q.withColumnRenamed("query_id", "question_id"), registry.registry(spark)).withColumnRenamed("question_id", "query_id"), "query_id")
        hits = retrieval.retrieve(points, q, a.limit or known.retrieval_limit, a.balance, document="document_id", chunk_type="chunk_type", chunk_types="types", threshold=a.threshold)
        shown = hits.join(points.select("point_id", "chunk_id", "text"), "point_id").orderBy("rank").select("rank", F.round("score", 6).alias("score"), "chunk_id", F.substring("text", 1, 200).alias("text"))
        for line in shown.toJSON().toLocalIterator():
            print(line)
    elif a.command in ("answer", "serve"):
        own = _answers(spark, known, a)
        if a.command == "answer":
            print(json.dumps(own.respond(a.question, a.company, a.chunk_type, a.limit), ensure_ascii=False))
        else:
            service.server(own, a.reports, (a.host, a.port), a.origin).serve_forever()
    elif a.command == "judge":
        own = ledger.Ledger(spark, a.ledger, _chat(known, a), a.per_second, valid=judge.valid)
        scored = checkpointed(measures.scored(judge.judged(sinks.read_json_lines(spark, a.cases, CASES), own)))
        sinks.write_json(scored, a.out)
        for line in measures.summary(scored).toJSON().toLocalIterator():  # a row a category
            print(line)
    else:
        for line in parse_answers(sinks.read_json_lines(spark, a.responses, "response string")).toJSON().toLocalIterator():
            print(line)
    return 0


class Recorded:
    """Responses by kind, whatever the prompt."""

    def __init__(self, said: dict[str, str]):
        self.said = said

    def complete(self, kind: str, prompts) -> list[str]:
        return [self.said[kind] for _ in prompts]


def _chat(known: settings.Settings, a: argparse.Namespace):
    if a.recorded:
        with open(a.recorded, encoding="utf-8") as f:
            return Recorded(json.load(f))
    return services.HttpChat(known.chat_endpoint, os.environ.get("FOLIANT_KEY", ""), a.model, prompts(a.scope))


def _answers(spark, known: settings.Settings, a: argparse.Namespace) -> service.Answers:
    points, key, chat = sinks.PointStore(spark, a.points, 0).read(), os.environ.get("FOLIANT_KEY", ""), _chat(known, a)
    if known.embedding_endpoint and a.embedding_model:
        embedder = services.HttpEmbedder(known.embedding_endpoint, key, a.embedding_model)
    else:
        embedder = providers.HashedWords(points.select(F.size("vector").alias("n")).first().n)
    return service.Answers(spark, points, embedder, chat, registry.registry(spark), known)


if __name__ == "__main__":
    raise SystemExit(main())
