"""Banks of questions by category, flattened to cases and rendered; cases that are still to be run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANK = "category_id string, category_name string, category_description string, cases array<struct<case_id:string,question:string,answer_expectation:string,company_filters:array<string>,chunk_types:array<string>,expected_document_ids:array<string>,expected_chunk_types:array<string>>>"


def flatten_bank(bank: DataFrame) -> DataFrame:
    """A row for each case of a bank (BANK), with its place in its category from 1."""
    one = bank.select("category_id", "category_name", "category_description", F.posexplode("cases").alias("i", "c"))
    return one.select("c.*", "category_id", "category_name", "category_description", (F.col("i") + 1).alias("category_case_index"))


def render_bank(cases: DataFrame) -> DataFrame:
    """category_name, markdown: a heading, the description and numbered questions of each category."""
    line = F.format_string("%d. %s (%s)", "category_case_index", "question", "answer_expectation")
    own = cases.groupBy("category_name", "category_description").agg(F.sort_array(F.collect_list(F.struct("category_case_index", line.alias("l")))).alias("x"))
    return own.select("category_name", F.concat(F.lit("## "), "category_name", F.lit("\n\n"), F.coalesce("category_description", F.lit("")), F.lit("\n\n"), F.array_join("x.l", "\n")).alias("markdown"))


def supported(cases: DataFrame) -> DataFrame:
    return cases.filter("answer_expectation = 'supported'")


def to_run(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without a result yet."""
    return cases.join(done.select("case_id"), "case_id", "left_anti")
