"""Layout files: schemas that hold all that may be missing, readers, and names of what each stage writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import sibling_name

REGIONS = "array<struct<pageNumber:int,polygon:array<double>>>"
SPANS = "array<struct<offset:int,length:int>>"
LINE = "struct<content:string,polygon:array<double>>"
CELL = "struct<kind:string,rowIndex:int,columnIndex:int,content:string>"
TABLE = f"struct<rowCount:int,columnCount:int,cells:array<{CELL}>,boundingRegions:{REGIONS},spans:{SPANS}>"
PARAGRAPH = f"struct<role:string,content:string,boundingRegions:{REGIONS},spans:{SPANS}>"
ROOT_FIELDS = (
    "apiVersion string, contentFormat string, stringIndexType string, modelId string, "
    f"pages array<struct<pageNumber:int,width:double,height:double,unit:string,lines:array<{LINE}>>>, tables array<{TABLE}>, "
    f"paragraphs array<{PARAGRAPH}>, sections array<string>, styles array<string>, figures array<string>"
)
ROOT = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in ROOT_FIELDS.split(", "))) + ">"
#: A raw layout file: what was extracted may be under result, under analyzeResult, or the document itself.
RAW = f"source_file string, sourceFile string, source_path string, sourcePath string, model_id string, result {ROOT}, analyzeResult {ROOT}, {ROOT_FIELDS}"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw layout files of a folder, one row each, with the file's name."""
    return spark.read.schema(RAW).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def list_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, length and name of the PDF files of a folder, by name; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "length", F.regexp_extract("path", "([^/]+)$", 1).alias("name")).orderBy("name")


def read_stage(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """JSON files whose names end in suffix, but for those of evaluations."""
    files = spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}.json").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return files.filter(~F.col("file").ilike("%evaluation%"))


def document_id(file: Column, suffix: str) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), f"{suffix}$", "")


def processed_name(file: Column) -> Column:
    return sibling_name(file, "_layout", "_processed")


def chunks_name(file: Column) -> Column:
    return sibling_name(file, "_processed", "_chunks")


def matching(left: DataFrame, right: DataFrame, suffix: str) -> DataFrame:
    """document_id, file of left with the right file of the same document: the one named with suffix, else the first whose name begins with the id.

    The names meet the ids by their beginnings, a row for each length, so that it is an equi join.
    """
    begins = F.transform(F.sequence(F.lit(0), F.length("file")), lambda n: F.substring("file", F.lit(1), n))
    names = right.select(F.col("file").alias("r_file"), F.explode(begins).alias("document_id"))
    pairs = left.alias("l").join(names, "document_id", "left")
    best = F.min(F.struct((F.col("r_file") != F.concat("document_id", F.lit(f"{suffix}.json"))).alias("other"), F.col("r_file").alias("file"))).alias("b")
    return pairs.groupBy("document_id", F.col("l.file").alias("file")).agg(best).select("document_id", "file", F.col("b.file").alias("matched"))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key), key, "left_anti")
