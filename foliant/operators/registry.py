"""The dimension of known documents: aliases, names found in free text, filters resolved to ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.functions.text import lookup_key
from foliant.session import checkpointed

# The documents of the shipped registry.
DOCUMENTS = [
    ("bmw_2024", "BMW Group", "bmw_2024.pdf", ["bmw", "bmw group"]),
    ("bosch_2024", "Robert Bosch GmbH", "bosch_2024.pdf", ["bosch", "robert bosch", "robert bosch gmbh"]),
    ("mercedes_2024", "Mercedes-Benz Group", "mercedes_2024.pdf", ["mercedes", "mercedes benz", "mercedes-benz", "mercedes-benz group"]),
    ("siemens_2024", "Siemens AG", "siemens_2024.pdf", ["siemens", "siemens ag"]),
    ("volkswagen_2024", "Volkswagen Group", "volkswagen_2024.pdf", ["volkswagen", "volkswagen group", "vw"]),
]
EVERY = ("all", "all companies", "all documents")


def registry(spark: SparkSession, documents=DOCUMENTS) -> DataFrame:
    """place, document_id, company_name, source_file, aliases."""
    return spark.createDataFrame([(i, *d) for i, d in enumerate(documents)], "place int, document_id string, company_name string, source_file string, aliases array<string>")


def alias_table(known: DataFrame) -> DataFrame:
    """alias, document_id: id, file, name and aliases as lookup keys; of two documents with one key the later has it."""
    said = known.select("document_id", "place", F.explode(F.concat(F.array("document_id", "source_file", "company_name"), F.coalesce("aliases", F.array()))).alias("a"))
    said = said.select("document_id", "place", lookup_key("a").alias("alias")).filter("alias <> ''")
    return said.groupBy("alias").agg(F.max_by("document_id", "place").alias("document_id"))


#: Bytes of aliases whose automaton goes to the tasks; of more, the runs of words of the texts meet them. First words that such runs are looked for by.
AUTOMATON_BYTES, FIRST_WORDS = 16 << 20, 10_000


def _runs(lengths: list[int], first: list[str] | None):
    """Runs of the words w of each of some lengths with their first place, those that begin with a first word if these are given."""
    at = F.sequence(F.lit(1), F.size("w"))
    if first is not None:
        at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(first), i + 1)), lambda i: i.isNotNull())
    return F.flatten(F.transform(at, lambda i: F.array(*(F.struct(i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("alias")) for n in lengths))))


def detect(questions: DataFrame, known: DataFrame, text: str = "question", key: str = "question_id", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """question_id, documents of every row: ids whose alias the text has as whole words, by first place, then longest alias, then id.

    The texts run through an automaton of all aliases, once, whatever the number of these. More aliases than automaton_bytes
    (measured) are met as word runs of the text by an equi join, of those runs only that begin as an alias does. Rows of a repeated
    question_id each have their own documents; a null text has none.
    """
    aliases = alias_table(known)
    size = aliases.agg(F.coalesce(F.sum(F.octet_length("alias") + F.octet_length("document_id") + 64), F.lit(0))).first()[0]
    return _by_automaton(questions, aliases, text, key) if size <= automaton_bytes else _by_runs(questions, aliases, text, key)


def _by_automaton(questions: DataFrame, aliases: DataFrame, text: str, key: str) -> DataFrame:
    rows = aliases.toArrow()  # at most AUTOMATON_BYTES
    sent = questions.sparkSession.sparkContext.broadcast((rows.column("alias").to_pylist(), rows.column("document_id").to_pylist()))
    own = questions.select(F.col(key).alias("question_id"), F.coalesce(lookup_key(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for alias, document in zip(*sent.value, strict=True):
            found.add_word(f" {alias} ", (len(alias), document))
        found.make_automaton()

        def of(said: str) -> list[str]:
            first: dict[str, tuple[int, int]] = {}
            for end, (n, document) in found.iter(f" {said} "):
                at = (end - n, -n)
                if document not in first or at < first[document]:
                    first[document] = at
            return [d for _, d in sorted((at, d) for d, at in first.items())]

        for batch in batches:
            documents = [of(t) for t in batch.column(1).to_pylist()] if len(found) else [[]] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(documents, pa.list_(pa.string()))], names=["question_id", "documents"])

    return own.mapInArrow(run, StructType([own.schema["question_id"], StructField("documents", ArrayType(StringType()))]))


def _by_runs(questions: DataFrame, aliases: DataFrame, text: str, key: str) -> DataFrame:
    aliases = aliases.withColumn("n", F.size(F.split("alias", " ")))
    lengths = [r.n for r in aliases.select("n").distinct().collect()]  # as many as there are lengths
    own = checkpointed(questions.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("question_id"), F.coalesce(lookup_key(text), F.lit("")).alias("t"))).withColumn("w", F.split("t", " "))
    begins = aliases.select(F.substring_index("alias", " ", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    first = [r.w for r in begins] if len(begins) <= FIRST_WORDS else None
    runs = _runs(lengths, first) if lengths else F.expr("cast(array() as array<struct<i:int,alias:string>>)")
    met = own.select("_row", F.explode(runs).alias("r")).select("_row", "r.i", "r.alias").join(aliases, "alias")
    where = met.groupBy("_row", "document_id").agg(F.min(F.struct("i", -F.length("alias"))).alias("at"))
    listed = where.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "document_id"))).alias("s"))
    none = F.expr("cast(array() as array<string>)")
    return own.select("_row", "question_id").join(listed, "_row", "left").select("question_id", F.coalesce(F.col("s.document_id"), none).alias("documents"))


def resolve(filters: DataFrame, known: DataFrame, key: str = "question_id", column: str = "filters") -> DataFrame:
    """question_id, documents, unknown: ids of the filter values in order without repeats; all of them for an all-word.

    Blank values don't count. unknown lists what matches nothing; see require_known().
    """
    ids = known.orderBy("place").agg(F.sort_array(F.collect_list(F.struct("place", "document_id"))).alias("x")).select(F.col("x.document_id").alias("every"))
    aliases = alias_table(known)
    said = filters.select(F.col(key).alias("question_id"), F.posexplode_outer(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))).alias("i", "value"))
    said = said.withColumn("alias", lookup_key("value")).join(aliases, "alias", "left")
    every = ids.first()
    found = said.groupBy("question_id").agg(
        F.max(F.col("alias").isin(*EVERY)).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("document_id").isNotNull(), F.struct("i", "document_id")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("document_id").isNull() & F.col("value").isNotNull() & ~F.col("alias").isin(*EVERY), F.struct("i", "value")))).alias("u"),
    )
    none = F.expr("cast(array() as array<string>)")
    return found.select(
        "question_id",
        F.when(F.col("all"), F.array(*map(F.lit, every.every or []))).otherwise(F.array_distinct("s.document_id")).alias("documents"),
        F.when(F.col("all"), none).otherwise(F.col("u.value")).alias("unknown"),
    )


def wanted(direct: Column | str, found: Column | str) -> Column:
    """Ids given directly and those of a registry, in this order, each once."""
    none = F.expr("cast(array() as array<string>)")
    listed = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, none)
    return F.array_distinct(F.concat(listed(direct), listed(found)))


def require_known(resolved: DataFrame, known: DataFrame) -> DataFrame:
    """resolved, or ValueError with the names that are supported."""
    bad = resolved.filter(F.size("unknown") > 0).first()
    if bad:
        names = ", ".join(r.company_name for r in known.orderBy("place").collect())
        raise ValueError(f"Unknown company/document filter: {', '.join(bad.unknown)}. Supported companies: {names}.")
    return resolved


def company_names(rows: DataFrame, known: DataFrame, document: str = "document_id") -> DataFrame:
    """rows with company: the name, else the id, else unknown."""
    names = known.select(F.col("document_id").alias(document), F.col("company_name").alias("_name"))
    return rows.join(names, document, "left").withColumn("company", F.coalesce("_name", F.nullif(F.col(document), F.lit("")), F.lit("unknown"))).drop("_name")
