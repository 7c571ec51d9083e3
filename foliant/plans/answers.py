"""Questions, locations and answers. Responses are made from the tables, so that SQL can say what parsing them must give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.skew import dealt_join, hot_keys
from foliant.functions.text import collapse
from foliant.operators import answers, locate
from foliant.operators.answer_parse import parse_answers
from foliant.plans.registry import query, table
from foliant.sources.providers import recorded

_NATIONS = "select n_nationkey k, n_name, r_name, n_nationkey * 7 + 3 page from nation join region on n_regionkey = r_regionkey"


def _nations(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("k"), "n_name", "r_name", (F.col("n_nationkey") * 7 + 3).alias("page"))


def responses(spark, sf_dir) -> DataFrame:
    """Of each nation an answer in one of five forms, by its key: numbered resources, evidence with prefixes, one resource and bare quotes, page prefixes, a refusal."""
    file, k = F.concat(F.lower(F.regexp_replace("n_name", " ", "_")), F.lit("_2024.pdf")), F.col("k") % 5
    cite = F.concat("n_name", F.lit(", "), file, F.lit(", page "), "page")
    quote = F.concat(F.lit("Trade of "), "n_name", F.lit(" grew in "), "r_name", F.lit("."))
    head = F.concat(F.lit("Answer\nIt grew in "), "n_name", F.lit(".\n\n"))
    forms: list[Column] = [
        F.concat(head, F.lit("Reporting Period\n2024\n\nResources\n1. "), "n_name", F.lit(", "), file, F.lit(", p"), "page", F.lit("\n\nEvidence\n- \""), quote, F.lit('" ('), cite, F.lit(")")),
        F.concat(head, F.lit("Resources\nNone\n\nEvidence\n"), cite, F.lit(": "), quote, F.lit("\n- "), cite, F.lit(": \"Second quote.\"")),
        F.concat(head, F.lit("Resources:\n- "), cite, F.lit("\n\nEvidence:\n- \""), quote, F.lit('"\n\n- "Another\nline."')),
        F.concat(head, F.lit("Resources\n- "), cite, F.lit("\n\nEvidence\n"), "r_name", F.lit(":\n\nPage "), "page", F.lit(": "), quote),
        F.when(F.col("k") % 2 == 0, answers.NO_STRONG).otherwise(F.concat(F.lit("  "), F.lit(answers.UNSUPPORTED), F.lit("\n"))),
    ]
    out = forms[-1]
    for i, f in enumerate(forms[:-1]):
        out = F.when(k == i, f).otherwise(out)
    return _nations(spark, sf_dir).withColumn("response", out)


_FILE = "lower(replace(n_name, ' ', '_')) || '_2024.pdf'"


@query(f"""select k, case when k % 5 = 4 then 'special_refusal' else 'grounded_answer' end as mode, case when k % 5 < 4 then 'It grew in ' || n_name || '.' when k % 2 = 0 then '{answers.NO_STRONG}' else '{answers.UNSUPPORTED}' end answer,
  case when k % 5 = 0 then '2024' end reporting_period, case k % 5 when 4 then 0 when 3 then 2 else 1 end n_resources, case k % 5 when 1 then 2 when 2 then 2 when 4 then 0 else 1 end n_evidence from ({_NATIONS})""")
def parse_sections(spark, sf_dir):
    p = parse_answers(responses(spark, sf_dir))
    return p.select("k", "mode", "answer", "reporting_period", F.size("resources").alias("n_resources"), F.size("evidence").alias("n_evidence"))


@query(f"select k, n_name company, {_FILE} source_file, page::varchar page_label, page::int page_number from ({_NATIONS}) where k % 5 < 4 union all select k, '', '', page::varchar, page::int from ({_NATIONS}) where k % 5 = 3")
def parse_resources(spark, sf_dir):
    # the outer form, since for the other Spark tests the array below the whole parse and writes that out again
    return parse_answers(responses(spark, sf_dir)).select("k", F.explode_outer("resources").alias("r")).filter("r is not null").select("k", "r.company", "r.source_file", "r.page_label", "r.page_number")


@query(f"""with n as ({_NATIONS}), e as (select *, 'Trade of ' || n_name || ' grew in ' || r_name || '.' q from n),
  i as (select k, 0 i, case k % 5 when 0 then '"' || q || '"' when 2 then '"' || q || '"' else q end as text from e where k % 5 < 4 union all select k, 1, case k % 5 when 1 then '"Second quote."' else '"Another line."' end from e where k % 5 in (1, 2))
  select k, i::int i, text, page::int page_number, case when k % 5 = 3 then '' else n_name end company, case when k % 5 = 3 then '' else {_FILE} end source_file from i join n using (k)""")
def parse_evidence(spark, sf_dir):
    return parse_answers(responses(spark, sf_dir)).select("k", F.posexplode_outer("evidence").alias("i", "e")).filter("e is not null").select("k", "i", "e.text", "e.page_number", "e.company", "e.source_file")


def _wrapped() -> Column:
    none = "\nResources\nNone\nEvidence\nNone"
    k = F.col("k") % 7
    forms = ["Answer\n" + answers.NO_STRONG, "Answer\n" + answers.UNSUPPORTED + none, "Answer\nThe report does not provide this for ", "Answer\nIn short: " + answers.NO_STRONG + none, " " + answers.NO_DATA + " ", answers.ONLY_2024, "Answer\nIt grew in "]
    out = F.concat(F.lit(forms[6]), "n_name")
    for i in range(6):
        out = F.when(k == i, F.concat(F.lit(forms[i]), *(["n_name", F.lit("." + none)] if i == 2 else []))).otherwise(out)
    return out


@query(f"select k, case k % 7 when 0 then '{answers.NO_STRONG}' when 1 then '{answers.NO_STRONG}' when 2 then '{answers.NO_STRONG}' when 3 then '{answers.NO_STRONG}' when 4 then '{answers.NO_DATA}' when 5 then '{answers.ONLY_2024}' else 'Answer' || chr(10) || 'It grew in ' || n_name end said from ({_NATIONS})")
def refusal_normalise(spark, sf_dir):
    return _nations(spark, sf_dir).select("k", answers.final(_wrapped(), F.lit("supported")).alias("said"))


@query("select event_id, case when event_type = 'error' then 'unsupported' else 'supported' end scope, case when event_type = 'view' then 'ambiguous' else 'clear' end clarity, case event_type when 'purchase' then 'aggregation' when 'click' then 'ranking' when 'signup' then 'comparison' else 'direct' end operation from events")
def gate_parse(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", answers.gate(F.concat(F.lit("scope: "), F.when(t == "error", "Unsupported").otherwise("SUPPORTED"), F.lit("\nClarity : "), F.when(t == "view", "ambiguous").when(t == "click", "unsure").otherwise("CLEAR"))).alias("g"), answers.operation(F.when(t == "purchase", " Aggregation.").when(t == "click", "RANKING").when(t == "signup", "comparison of").otherwise("other")).alias("operation"))
    return e.select("event_id", "g.scope", "g.clarity", "operation")


@query("select o_orderkey, case o_orderkey % 3 when 0 then '' when 1 then (o_orderkey % 100)::varchar else (o_orderkey % 100)::varchar || ',' || (o_orderkey % 7)::varchar end pages from orders")
def pages_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "PAGES: none of these 12").when(k % 3 == 1, F.concat(F.lit("x\npages : "), k % 100)).otherwise(F.concat(F.lit("PAGES: "), k % 100, F.lit(" and p"), k % 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(locate.selected_pages(said), ",").alias("pages"))


_STOP = ", ".join(f"'{w}'" for w in locate.STOP)
_TERMS = r"list_filter(string_split(regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 3 and t not in (" + _STOP + "))"


@query(f"select conv_id, turn, len({_TERMS.format('text')}) n, array_to_string({_TERMS.format('text')}, ' ') terms from conversations")
def location_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("t", locate.terms("text")).select("conv_id", "turn", F.size("t").alias("n"), F.array_join("t", " ").alias("terms"))


def hits(spark, sf_dir) -> DataFrame:
    """For every benchmark item as a question, the documents of one source as hits."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Where is the outlook of "), "text").alias("question"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    b = locate.asked(b)
    from pyspark.sql import Window

    # a document has one rank for all questions on its source, so ranks are made of keys, once a document, and so is what terms are looked for in
    d = table(spark, sf_dir, "documents")
    ranks = d.select("source", "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).select("doc_id", "rank")
    c = d.select(
        "source", "doc_id", "text", F.when(F.col("lang") == "en", "text").when(F.col("lang") == "fr", "table").otherwise("visual").alias("chunk_type"), F.array(F.substring_index("text", " ", 2)).alias("section_titles"), F.lit(None).cast("map<string,string>").alias("table_metadata"),
    )
    h = locate.searchable(c).join(ranks, "doc_id").join(b, "source")
    return h.select(
        "query_id", "question", "terms", "rank", (1.0 / (F.col("rank") + 1)).alias("score"), F.col("source").alias("document_id"), F.lit("company").alias("company"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.array((F.col("doc_id") % 50).cast("int")).alias("page_numbers"), F.lit(0).alias("page_start"),
        "chunk_type", "section_titles", "table_metadata", "text", F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "_titles", "_hay", "_speaks", "_asked", "_sorted",
    )


_HITS = rf"""h as (select item_id query_id, 'Where is the outlook of ' || b.text question, row_number() over (partition by item_id order by doc_id) rank, d.source document_id, doc_id % 50 page, lang, array_to_string(string_split(d.text, ' ')[1:2], ' ') title, d.text from benchmark b join documents d on d.source = 'src' || (item_id % 20)),
  f as (select *, {_TERMS.format('question')} terms, 1.0::double / (rank + 1) score, case lang when 'en' then 0.25 when 'fr' then 0.15 else 0 end::double type_bonus, lower(trim(regexp_replace(text || ' ' || title || ' ' || case lang when 'en' then 'text' when 'fr' then 'table' else 'visual' end, '\s+', ' ', 'g'))) hay, lower(title) low from h),
  g as (select *, len(list_filter(terms, lambda t: contains(hay, t))) overlap,
    {' + '.join("case when len(list_filter(list_filter(terms, lambda t: t in (" + ", ".join(f"'{w}'" for w in x) + ")), lambda t: contains(low, t))) > 0 then 2.5 when len(list_filter(list_filter(terms, lambda t: t in (" + ", ".join(f"'{w}'" for w in x) + ")), lambda t: contains(hay, t))) > 0 then 1.0 else 0 end" for x in locate.GROUPS)} intent_bonus from f),
  c as (select *, overlap + intent_bonus::double + type_bonus + score composite from g),
  r as (select *, row_number() over (partition by query_id order by composite desc, overlap desc, intent_bonus desc, score desc, rank) location_rank from c)"""


@query(f"with {_HITS} select query_id, rank, overlap, intent_bonus::double intent_bonus, type_bonus, round(composite, 6) composite, location_rank from r")
def location_rerank(spark, sf_dir):
    return locate.rerank(hits(spark, sf_dir)).select("query_id", "rank", "overlap", "intent_bonus", "type_bonus", F.round("composite", 6).alias("composite"), "location_rank")


@query(f"""with {_HITS}, p as (select *, list_filter(terms, lambda t: t in ({', '.join(f"'{w}'" for g in locate.GROUPS for w in g)})) focus from r),
  q as (select *, len(list_filter(focus, lambda t: contains(low, t) or contains(hay, t))) > 0 focused from p), k as (select *, max(focused) over (partition by query_id) any_focus from q),
  m as (select *, max(composite) over (partition by query_id) best from k where not any_focus or focused), o as (select *, row_number() over (partition by query_id, document_id, page order by location_rank) once from m where composite >= 0.6 * best),
  s as (select *, row_number() over (partition by query_id order by location_rank) n from o where once = 1) select query_id, page::int page, rank, row_number() over (partition by query_id order by page, location_rank) place from s where n <= 3""")
def location_select(spark, sf_dir):
    return locate.select_locations(hits(spark, sf_dir)).select("query_id", "page", "rank", "place")


@query(f"""with t as (select conv_id, turn, text, trim(text, ' ' || chr(10)) s, {_TERMS.format('text')} terms from conversations), b as (select *, list_sort(list_transform(list_filter(terms, lambda x: contains(lower(s), x)), lambda x: {{'n': -length(x), 'at': instr(lower(s), x)}}))[1] best from t),
  e as (select *, least(greatest(best.at - 1 - 100, 0) + 200, length(s)) fin from b), w as (select *, greatest(fin - 200, 0) ini from e)
  select conv_id, turn, md5(case when length(s) <= 200 then s when best is null then rtrim(s[:200], ' ' || chr(10)) || '...' else (case when ini > 0 then '...' else '' end) || trim(substring(s, ini + 1, 200), ' ' || chr(10)) || (case when fin < length(s) then '...' else '' end) end) digest from w""")
def excerpts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("terms", locate.terms("text"))
    return c.select("conv_id", "turn", F.md5(locate.excerpt("text", "terms", 200)).alias("digest"))


@query("select k, n_name || ' report' target, k % 4 < 3 located, case k % 3 when 0 then 'page ' || page when 1 then 'pages ' || page || ' and 5' else 'pages ' || page || ', 5, and 9' end pages from (" + _NATIONS + ")")
def location_target(spark, sf_dir):
    k = F.col("k")
    q = F.when(k % 4 == 0, F.concat(F.lit("On which page is "), "n_name", F.lit(" report stated?"))).when(k % 4 == 1, F.concat(F.lit("where  is "), "n_name", F.lit(" report ??"))).when(k % 4 == 2, F.concat(F.lit("Show me the source of "), "n_name", F.lit(" report"))).otherwise(F.concat("n_name", F.lit(" report shown")))
    pages = F.when(k % 3 == 0, F.array("page")).when(k % 3 == 1, F.array(F.col("page"), F.lit(5))).otherwise(F.array(F.col("page"), F.lit(5), F.lit(9)))
    return _nations(spark, sf_dir).select("k", locate.target(q).alias("target"), locate.is_location(q).alias("located"), locate.page_phrase(pages).alias("pages"))


@query(f"""select k question_id, case when k % 5 = 0 then 'unsupported' when k % 5 = 1 or k % 3 = 0 then 'no_strong' when k % 2 = 0 then 'location' else 'answer' end status,
  case when k % 5 = 0 then '{answers.UNSUPPORTED}' when k % 5 = 1 or k % 3 = 0 then '{answers.NO_STRONG}'
  when k % 2 = 0 then 'Answer' || chr(10) || 'The strongest evidence for ' || n_name || ' trade appears on page ' || page || '.' || chr(10) || chr(10) || 'Resources' || chr(10) || '- ' || n_name || ', ' || {_FILE} || ', page ' || page || chr(10) || chr(10) || 'Evidence' || chr(10) || '- Page ' || page || ': "Trade of ' || n_name || ' grew in ' || r_name || '."'
  else 'Answer' || chr(10) || n_name || ' grew.' end response from ({_NATIONS})""")
def answer_states(spark, sf_dir):
    """Questions on nations through gate, search, location and answer with recorded responses."""
    n = _nations(spark, sf_dir)
    k = F.col("k")
    ask = F.when(k % 2 == 0, F.concat(F.lit("On which page is "), "n_name", F.lit(" trade?"))).otherwise(F.concat(F.lit("How did "), "n_name", F.lit(" grow?")))
    questions = n.select(k.alias("question_id"), ask.alias("question"), F.array("n_name").alias("companies"))
    file = F.concat(F.lower(F.regexp_replace("n_name", " ", "_")), F.lit("_2024.pdf"))
    found = n.select(
        k.alias("query_id"), F.lit(1).alias("rank"), F.when(k % 3 == 0, 0.2).otherwise(0.7).alias("score"), file.alias("document_id"), F.col("n_name").alias("company"), file.alias("source_file"), F.array("page").alias("page_numbers"), F.col("page").alias("page_start"), F.lit("c").alias("chunk_id"), F.lit("text").alias("chunk_type"),
        F.array("r_name").alias("section_titles"), F.lit(None).cast("map<string,string>").alias("table_metadata"), F.concat(F.lit("Trade of "), "n_name", F.lit(" grew in "), "r_name", F.lit(".")).alias("text"),
    )
    gate = F.concat(F.lit("SCOPE: "), F.when((k % 5 == 0) | (k % 5 == 2), "UNSUPPORTED").otherwise("SUPPORTED"), F.lit("\nCLARITY: "), F.when(k % 5 == 1, "AMBIGUOUS").otherwise("CLEAR"))
    said = {"gate": gate, "topic": F.when(k % 5 == 0, "EXTERNAL").otherwise("REPORT_TOPIC"), "operation": F.lit("DIRECT"), "location": F.concat(F.lit("PAGES: "), "page"), "answer": F.concat(F.lit("Answer\n"), "n_name", F.lit(" grew."))}
    record = n.select(k.alias("question_id"), F.explode(F.array(*(F.struct(F.lit(a).alias("kind"), b.alias("response")) for a, b in said.items()))).alias("x")).select("question_id", "x.*")
    return answers.answer(questions, found, recorded(record))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) digest, count(*) over (partition by text) copies from documents")
def exact_copies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.withColumn("h", F.coalesce(F.sha2("text", 256), F.lit("")))  # null is a text of its own
    copies = d.groupBy("h").agg(F.count("*").alias("m"))
    hot = hot_keys(copies, "h", d.count())
    return dealt_join(d, copies.withColumnRenamed("m", "copies"), "h", hot, "doc_id").select("doc_id", F.md5(collapse("text")).alias("digest"), "copies")
