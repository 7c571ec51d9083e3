"""Answers scored by a judge: prompts of the cases that are judged, asked once each, and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.evaluation.answers import GOLD_SCORES, STRESS_SCORES, judge_scores, refused


def valid(response: str) -> bool:
    """Whether a response holds a JSON object, as the scores are read from it."""
    import json

    begin, end = response.find("{"), response.rfind("}")
    try:
        return 0 <= begin < end and isinstance(json.loads(response[begin : end + 1]), dict)
    except ValueError:
        return False


def gold_prompts(cases: DataFrame) -> DataFrame:
    """cases with prompt: question, gold_answer, expected_resources and generated_answer as indented JSON."""
    return cases.withColumn("prompt", F.to_json(F.struct("question", "gold_answer", "expected_resources", "generated_answer"), {"pretty": "true", "ignoreNullFields": "false"}))


def stress_prompts(cases: DataFrame) -> DataFrame:
    """cases with prompt: question, what was expected, expected_document_ids and generated_answer as indented JSON."""
    own = F.struct("question", F.lit("supported").alias("expected_behavior"), "expected_document_ids", "generated_answer")
    return cases.withColumn("prompt", F.to_json(own, {"pretty": "true", "ignoreNullFields": "false"}))


def judged(cases: DataFrame, ask: Callable[[DataFrame, str], DataFrame], prompts: Callable[[DataFrame], DataFrame] = stress_prompts, names: tuple[str, ...] = STRESS_SCORES, kind: str = "judge") -> DataFrame:
    """cases with scores, a struct of names and notes: what ask(df, kind) makes of the prompts of supported cases that were answered.

    Others are not asked and have null, as refusals are scored by rule; a score that the judge leaves out is 0. Repeated cases have
    equal scores. With a ledger for ask, a run that was stopped goes on where it was.
    """
    asked = (F.col("answer_expectation") == "supported") & ~refused(F.coalesce("generated_answer", F.lit("")))
    own = cases.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    got = ask(prompts(own.filter("_asked")), kind)
    read = judge_scores(F.col("response"), names)
    filled = F.struct(*(F.coalesce(read[n], F.lit(0.0)).alias(n) for n in names), F.trim(F.coalesce(read["notes"], F.lit(""))).alias("notes"))
    scores = got.withColumn("scores", filled).drop("prompt", "response", "_asked")
    none = F.lit(None).cast(scores.schema["scores"].dataType)
    return scores.unionByName(own.filter("not _asked").drop("_asked").withColumn("scores", none))


def gold_scores(cases: DataFrame, ask: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    return judged(cases, ask, gold_prompts, GOLD_SCORES)
