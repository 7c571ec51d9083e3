"""Structured answers: sections, resources and evidence with citations, as column expressions.

A page is kept as label (text) and as number where the label is all digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import collapse, stripped
from foliant.operators.answers import REFUSALS

# The forms that responses have.
HEADING = r"(?im)^(Answer|Reporting Period|Resources|Evidence)[^\S\n]*:?\s*$"
ITEM = r"^\s*(?:[-*•]|\d+[.)])\s*"
PAGE = r"(?:pages?|pp?|p)\.?\s*"
FILE = r"([^,\s()]+\.pdf)"
RESOURCE = rf"(?i)^(?:(.+?),\s*)?{FILE}\s*,\s*({PAGE}.+?)\s*$"
PREFIX_CITATION = rf"(?is)^(?:(.+?),\s*)?{FILE}\s*,\s*({PAGE}[^:\n]+)\s*:\s*(.*)$"
SUFFIX_CITATION = rf"(?is)^(.*?)(?:\s*\((?:([^,()]+),\s*)?{FILE}\s*,\s*({PAGE}[^)]+)\))\s*$"
PAGE_PREFIX = r"(?is)^Page\s+([^:\n]+):\s*(.*)$"
PAGE_SUFFIX = rf"(?is)^(.*?)(?:\s*\(({PAGE}[^)]+)\))\s*$"
COMPANY_HEADER = r"^[A-Za-z0-9 .&'/()-]+:\s*$"
ANY_FILE = r"(?i)([^,\s()]+\.pdf)\b"
ANY_PAGE = r"(?i)\b((?:pages?|pp?|p)\.?\s*\d[\d,\sand-]*)\b"


def page_label(x: Column) -> Column:
    """The page of a reference without its prefix, null if nothing is left."""
    t = F.regexp_replace(collapse(x), r"""^[()\[\]{}"'.,;: ]+|[()\[\]{}"'.,;: ]+$""", "")
    t = F.trim(F.regexp_replace(t, rf"(?i)^{PAGE}", ""))
    return F.when(t != "", F.regexp_replace(t, r"^0+(?=\d+$)", ""))


def page_number(label: Column) -> Column:
    return F.when(label.rlike(r"^\d+$"), label.try_cast("int"))


def sections(response: Column) -> Column:
    """Map of section titles to their stripped texts; the whole text as Answer if there is no heading. The last of a repeated title stays."""
    titles = F.regexp_extract_all(response, F.lit(HEADING), F.lit(1))
    texts = F.slice(F.split(response, HEADING, -1), 2, 1_000_000)
    pairs = F.zip_with(titles, texts, lambda a, b: F.struct(F.initcap(F.lower(a)).alias("k"), stripped(b).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(titles) == 0, F.create_map(F.lit("Answer"), stripped(response))).otherwise(F.map_from_entries(last))


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(x, pattern, i)


def resource(t: Column) -> Column:
    """company, source_file, page_label, raw of one line without its mark; null for blank and None."""
    whole = t.rlike(RESOURCE)
    file = F.when(whole, _group(t, RESOURCE, 2)).otherwise(_group(t, ANY_FILE, 1))
    before = F.regexp_replace(F.call_function("substring_index", t, file, F.lit(1)), "[, ]+$", "")
    company = F.when(whole, collapse(_group(t, RESOURCE, 1))).when(file != "", collapse(before)).otherwise(F.lit(""))
    page = F.when(whole, page_label(_group(t, RESOURCE, 3))).otherwise(page_label(_group(t, ANY_PAGE, 1)))
    return F.when((t != "") & (F.lower(t) != "none"), F.struct(company.alias("company"), file.alias("source_file"), page.alias("page_label"), t.alias("raw")))


def resources(text: Column) -> Column:
    return F.filter(F.transform(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: collapse(F.regexp_replace(x, ITEM, ""))), resource), lambda x: x.isNotNull())


def blocks(text: Column) -> Column:
    """Evidence items: a blank line ends one, the start of an item begins one."""
    lines = F.split(text, r"\r\n|\r|\n")
    # lines joined by a line feed in a block, blocks by a form feed; neither is in a line
    step = lambda a, x: F.when(stripped(x) == "", F.struct(a["t"].alias("t"), F.lit(False).alias("open"))).otherwise(
        F.struct(F.concat(a["t"], F.when(a["t"] == "", "").when(~a["open"] | _starts(x), "\f").otherwise("\n"), F.regexp_replace(x, "\f", " ")).alias("t"), F.lit(True).alias("open"))
    )
    joined = F.aggregate(lines, F.struct(F.lit("").alias("t"), F.lit(False).alias("open")), step, lambda a: a["t"])
    return F.filter(F.split(joined, "\f"), lambda b: b != "")


def _starts(line: Column) -> Column:
    t = stripped(line)
    return t.rlike(ITEM) | t.rlike(PAGE_PREFIX) | t.rlike(PREFIX_CITATION)


def evidence_form(block: Column) -> Column:
    """A block without its mark, and which of the citation forms it has first (0 for none)."""
    return F.struct(block.alias("t"), F.when(block.rlike(PREFIX_CITATION), 1).when(block.rlike(PAGE_PREFIX), 2).when(block.rlike(SUFFIX_CITATION), 3).when(block.rlike(PAGE_SUFFIX), 4).otherwise(0).alias("form"))


def evidence_item(x: Column) -> Column:
    """text, page_label, company, source_file, raw of one block; null for None, company headers and empty texts."""
    t, form = x["t"], x["form"]
    pick = lambda w, x, y, z, rest: F.when(form == 1, w).when(form == 2, x).when(form == 3, y).when(form == 4, z).otherwise(rest)
    none = F.lit("")
    text = collapse(pick(_group(t, PREFIX_CITATION, 4), _group(t, PAGE_PREFIX, 2), _group(t, SUFFIX_CITATION, 1), _group(t, PAGE_SUFFIX, 1), t))
    page = page_label(pick(_group(t, PREFIX_CITATION, 3), _group(t, PAGE_PREFIX, 1), _group(t, SUFFIX_CITATION, 4), _group(t, PAGE_SUFFIX, 2), none))
    company = collapse(pick(_group(t, PREFIX_CITATION, 1), none, _group(t, SUFFIX_CITATION, 2), none, none))
    file = collapse(pick(_group(t, PREFIX_CITATION, 2), none, _group(t, SUFFIX_CITATION, 3), none, none))
    usable = (t != "") & (F.lower(t) != "none") & ~collapse(t).rlike(COMPANY_HEADER) & (text != "")
    return F.when(usable, F.struct(text.alias("text"), page.alias("page_label"), company.alias("company"), file.alias("source_file"), collapse(t).alias("raw")))


def evidence(text: Column) -> Column:
    # each step binds what the next uses often, else Catalyst would write it out as often
    plain = F.transform(F.transform(blocks(text), stripped), lambda b: stripped(F.regexp_replace(b, ITEM, "")))
    return F.filter(F.transform(F.transform(plain, evidence_form), evidence_item), lambda x: x.isNotNull())


def _key(r: Column) -> Column:
    return F.concat_ws("\x01", F.lower(r["company"]), F.lower(r["source_file"]), F.lower(F.coalesce(r["page_label"], F.lit(""))))


def _named(r: Column) -> Column:
    return _key(r) != "\x01\x01"


def _with_resources(d: DataFrame) -> DataFrame:
    """d with _res: resources of the answer (_given) that name something, then those of the evidence (_items) that add one; what names nothing only if there is nothing else."""
    derived = F.filter(F.transform("_items", lambda e: F.struct(e["company"].alias("company"), e["source_file"].alias("source_file"), e["page_label"].alias("page_label"), e["raw"].alias("raw"))), _named)
    d = d.withColumn("_own", F.filter("_given", _named)).withColumn("_all", F.concat("_own", derived))
    d = d.withColumn("_keys", F.transform("_all", _key))
    # one that is derived stays if its key is new; the answer's own all stay
    fresh = F.filter(F.transform("_all", lambda r, i: F.struct(r.alias("r"), ((i < F.size("_own")) | (F.array_position("_keys", F.get("_keys", i)) == i + 1)).alias("new"))), lambda x: x["new"])
    return d.withColumn("_fresh", F.transform(fresh, lambda x: x["r"])).withColumn("_res", F.when(F.size("_fresh") > 0, F.col("_fresh")).otherwise(F.col("_given")))


def parse_answers(responses: DataFrame, response: str = "response") -> DataFrame:
    """responses with mode, answer, reporting_period, resources and evidence (each with page_label and page_number).

    A refusal has no sections. A single resource fills what an item of evidence leaves open. Null is an empty answer.
    """
    d = responses.withColumn("_r", F.coalesce(F.col(response), F.lit(""))).withColumn("_plain", stripped("_r")).withColumn("_special", F.col("_plain").isin(*REFUSALS))
    d = d.withColumn("_s", sections(F.col("_r")))
    get = lambda k: F.coalesce(F.try_element_at(F.col("_s"), F.lit(k)), F.lit(""))
    d = d.withColumn("_given", resources(get("Resources"))).withColumn("_items", evidence(get("Evidence")))
    d = _with_resources(d).withColumn("_one", F.when(F.size("_res") == 1, F.get("_res", F.lit(0))))
    fill = lambda own, k: F.when((own[k].isNull()) | (own[k] == ""), F.coalesce(F.col("_one")[k], own[k])).otherwise(own[k]).alias(k)
    d = d.withColumn("_items", F.transform("_items", lambda e: F.struct(e["text"].alias("text"), fill(e, "page_label"), fill(e, "company"), fill(e, "source_file"), e["raw"].alias("raw"))))
    number = lambda e: page_number(e["page_label"]).alias("page_number")
    plain = lambda e, *names: [e[k].alias(k) for k in names]
    usual = ~F.col("_special")
    d = d.withColumns({
        "_items": F.transform(F.filter("_items", lambda e: usual), lambda e: F.struct(*plain(e, "text", "page_label"), number(e), *plain(e, "company", "source_file", "raw"))),
        "_res": F.transform(F.filter("_res", lambda e: usual), lambda e: F.struct(*plain(e, "company", "source_file", "page_label"), number(e), e["raw"].alias("raw"))),
    })
    return d.withColumns({
        "mode": F.when(usual, "grounded_answer").otherwise("special_refusal"),
        "answer": F.when(usual, F.coalesce(F.try_element_at(F.col("_s"), F.lit("Answer")), F.col("_plain"))).otherwise(F.col("_plain")),
        "reporting_period": F.when(usual, F.nullif(F.try_element_at(F.col("_s"), F.lit("Reporting Period")), F.lit(""))),
        "resources": F.col("_res"), "evidence": F.col("_items"),
    }).drop("_r", "_plain", "_special", "_s", "_given", "_items", "_own", "_all", "_keys", "_fresh", "_res", "_one")
