"""Documents for training in five stages; each takes (spark, docs, sf_dir) and its result is written and read again.

Every stage keeps the columns it was given under whatever names they have (the last one puts its own beside them), takes
null and empty texts as stated, reads very long texts whole, and gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, mixing, secrets, simhash
from foliant.llm.common import column, shared_folder
from foliant.session import ship

#: Least posterior of the predicted language.
SURE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with names that no operator gives to a column of its own, these names, and the columns under their old ones."""
    names = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(column(c).alias(n) for c, n in names.items())), names, [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned; those without letters, null and empty and unsure ones go.

    Repeated rows fare alike, and of languages with equal scores the first by name is taken.
    """
    ship(spark)
    own, name, back = _plain(docs)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = langid.language(own, vocabulary, name["text"], name["lang"], name["doc_id"], carry=tuple(own.columns))
    return known.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the least doc_id (a null one first).

    Two are linked if their SimHash fingerprints differ in at most simhash.NEAR bits, and these and a second one together in
    at most simhash.CONFIRMED. Repeated rows are one; texts without words, null ones too, are alike and leave one.
    """
    ship(spark)
    return simhash.one_of_each(docs, radius=simhash.NEAR, total=simhash.CONFIRMED)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty ones hold none, and repeated rows fare alike."""
    own, name, back = _plain(docs)
    bench = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(own, bench, name["text"], tuple(own.columns)).filter(~F.col("contaminated")).select(*back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials in their texts replaced; null texts stay null, repeated rows stay."""
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and the words taken of them (a given column of such a name gives way).

    Those without words are not taken; rows alike in key and text take turns.
    """
    return mixing.mix(docs, carry=tuple(docs.columns)).filter(F.col("taken") > 0)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("mix_sources", mix_sources)]

#: SQL has no segmentation sums and no XXH64; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; what each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
