"""Measures of answers: refusals, rules of form, and the scores of a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.rates import mean_or_zero
from foliant.functions.text import stripped
from foliant.operators.answers import NO_STRONG, REFUSALS, UNSUPPORTED
from foliant.operators.evaluation.search import latency

HEADING = r"(?m)^(Answer|Reporting Period|Resources|Evidence)\s*$"
GOLD_SCORES = ("correctness", "groundedness", "citation_accuracy", "completeness", "format_compliance")
STRESS_SCORES = ("relevance", "groundedness", "citation_accuracy", "completeness", "instruction_following")


def headings(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(HEADING), F.lit(1))


def section(answer: Column, name: str) -> Column:
    """The stripped text of the last section of a name, empty if there is none."""
    h = headings(answer)
    texts = F.slice(F.split(answer, HEADING, -1), 2, 1_000_000)
    return stripped(F.coalesce(F.try_element_at(F.filter(texts, lambda t, i: F.get(h, i) == name), F.lit(-1)), F.lit("")))


def well_formed(answer: Column) -> Column:
    return F.size(F.array_except(F.array(F.lit("Answer"), F.lit("Resources"), F.lit("Evidence")), headings(answer))) == 0


def resources_present(answer: Column, expected: Column) -> Column:
    """Whether company, source_file and page of each expected resource stand somewhere in the answer."""
    low = F.lower(answer)
    has = lambda x: F.contains(low, F.lower(x.cast("string")))
    return F.forall(expected, lambda r: has(r["company"]) & has(r["source_file"]) & has(r["page"]))


def cites(answer: Column) -> Column:
    """Whether there are resources and evidence, and neither is None."""
    given = lambda n: ~F.lower(section(answer, n)).isin("", "none")
    return given("Resources") & given("Evidence")


def names_documents(answer: Column, expected: Column) -> Column:
    """Whether each expected document (company_name, source_file) is named by either."""
    low = F.lower(answer)
    return F.forall(expected, lambda d: F.contains(low, F.lower(d["company_name"])) | F.contains(low, F.lower(d["source_file"])))


def refused(answer: Column) -> Column:
    return stripped(answer).isin(*REFUSALS)


def refusal_match(expectation: Column, answer: Column) -> Column:
    """1 or 0 for cases that must be refused, null for the others."""
    hit = lambda x: F.when(stripped(answer) == x, 1.0).otherwise(0.0)
    return F.when(expectation == "unsupported", hit(UNSUPPORTED)).when(expectation == "no_strong_answer", hit(NO_STRONG))


def judge_scores(response: Column, names=STRESS_SCORES) -> Column:
    """Scores of a judge's response: its JSON, or what stands between its first and last brace."""
    schema = "struct<" + ",".join(f"{n}:double" for n in names) + ",notes:string>"
    whole = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.from_json(whole, schema)


def scored(cases: DataFrame, names=STRESS_SCORES) -> DataFrame:
    """cases (answer_expectation, generated_answer, scores, expected_documents) with refusal_match and, of supported ones, rules and scores; a refused one scores 0 throughout."""
    a, supported = F.col("generated_answer"), F.col("answer_expectation") == "supported"
    gone = refused(a)
    rule = lambda x: F.when(supported, F.when(gone, 0.0).when(x, 1.0).otherwise(0.0))
    made = {"refusal_match": refusal_match(F.col("answer_expectation"), a), "format_rule": rule(well_formed(a)), "resource_rule": rule(cites(a)), "document_rule": rule(names_documents(a, F.col("expected_documents"))), "nonrefusal_rule": rule(F.lit(True))}
    made |= {f"llm_{n}": F.when(supported, F.when(gone, 0.0).otherwise(F.col("scores")[n])) for n in names}
    out = cases.withColumns(made)
    total = sum((F.col(f"llm_{n}") for n in names[1:]), F.col(f"llm_{names[0]}"))
    return out.withColumn("llm_answer_quality_mean", F.round(total / len(names), 6))


def summary(cases: DataFrame, by: tuple[str, ...] = ("category_id", "category_name"), metrics: tuple[str, ...] = ("format_rule", "resource_rule", "document_rule", "nonrefusal_rule", *(f"llm_{n}" for n in STRESS_SCORES), "llm_answer_quality_mean")) -> DataFrame:
    """Counts, latency, refusal accuracy by expectation and means over supported cases: by group and, in the row without one, over all."""
    kind = F.col("answer_expectation")
    of = lambda k, x: F.when(kind == k, F.col(x))
    counts = [F.count("*").alias("case_count"), *(F.count_if(kind == k).alias(f"{k}_case_count") for k in ("supported", "unsupported", "no_strong_answer"))]
    made = [mean_or_zero(of("unsupported", "refusal_match")).alias("unsupported_refusal_accuracy"), mean_or_zero(of("no_strong_answer", "refusal_match")).alias("no_strong_answer_accuracy"), *(mean_or_zero(of("supported", m)).alias(f"{m}_mean") for m in metrics)]
    grouped = cases.groupingSets([tuple(map(F.col, by)), ()], *by) if by else cases.groupBy()
    return grouped.agg(*counts, *latency(), *made)
