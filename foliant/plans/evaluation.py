"""Summaries of cases, integrity of records, and streams' windows over tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.rates import mean_or_zero
from foliant.functions.text import int_or_zero
from foliant.operators import registry as registry_operators
from foliant.operators import retrieval
from foliant.operators.context import section
from foliant.operators.evaluation import answers as measures
from foliant.operators.evaluation import artifacts, judge, search
from foliant.operators.evaluation import cases as bank_operators
from foliant.plans.registry import query, table
from foliant.session import shared_path
from foliant.sources import ledger
from foliant.streaming.ingest import windowed_counts


@query("select event_type category, count(*) n, round(avg(value), 3) mean, round(quantile_cont(value, 0.95), 3) p95, max(round(value, 6)) most from events group by grouping sets ((event_type), ())")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("category", F.col("event_type"))
    return e.groupingSets([(F.col("category"),), ()], "category").agg(F.count("*").alias("n"), mean_or_zero(F.col("value"), 3).alias("mean"), F.round(F.percentile("value", 0.95), 3).alias("p95"), F.max(F.round("value", 6)).alias("most"))


def cases(spark, sf_dir) -> DataFrame:
    """Labelled documents as answered cases: what is toxic had to be refused, and was if its quality is good."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    from foliant.operators.answers import NO_STRONG, UNSUPPORTED

    kind = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "unsupported").when(F.col("toxic") == 1, "no_strong_answer").otherwise("supported")
    good = F.concat(F.lit("Answer\nyes\nResources\n- "), "source", F.lit(", x.pdf, page 1\nEvidence\n- some"))
    said = F.when(kind == "unsupported", F.when(F.col("quality") == 1, UNSUPPORTED).otherwise("no")).when(kind == "no_strong_answer", F.when(F.col("quality") == 1, F.lit(f" {NO_STRONG} ")).otherwise("Answer")).when(F.col("doc_id") % 10 == 3, NO_STRONG).when(F.col("quality") == 1, good).otherwise(F.lit("Answer\nno\nResources\nNone\nEvidence\nNone"))
    score = (F.col("doc_id") % 3) / 2
    judged = measures.judge_scores(F.concat(F.lit("Scores: {"), *(F.concat(F.lit(f'"{n}": '), score.cast("string"), F.lit(", ")) for n in measures.STRESS_SCORES), F.lit('"notes": "none"} end')))
    return d.select("doc_id", F.col("lang").alias("category_id"), F.upper("lang").alias("category_name"), kind.alias("answer_expectation"), said.alias("generated_answer"), (F.col("n_chars") / 1000).alias("latency_seconds"), judged.alias("scores"), F.array(F.struct(F.col("source").alias("company_name"), F.lit("none.pdf").alias("source_file"))).alias("expected_documents"))


_CASES = """c as (select doc_id, lang, n_chars / 1000.0::double latency, quality, toxic, case when toxic = 1 and doc_id % 2 = 0 then 'unsupported' when toxic = 1 then 'no_strong_answer' else 'supported' end kind, (doc_id % 3) / 2.0::double s from documents join labels using (doc_id)),
  m as (select *, case when toxic = 1 then (quality = 1)::int::double end refusal_match, case when toxic = 0 then (doc_id % 10 <> 3)::int::double end nonrefusal, case when toxic = 0 then (doc_id % 10 <> 3 and quality = 1)::int::double end cited, case when toxic = 0 then case when doc_id % 10 = 3 then 0 else s end end score from c)"""


@query(f"""with {_CASES} select lang category_id, upper(lang) category_name, count(*) case_count, count(*) filter (kind = 'supported') supported_case_count, count(*) filter (kind = 'unsupported') unsupported_case_count, count(*) filter (kind = 'no_strong_answer') no_strong_answer_case_count,
  round(avg(latency), 3) mean_latency_seconds, round(quantile_cont(latency, 0.95), 3) p95_latency_seconds, round(coalesce(avg(refusal_match) filter (kind = 'unsupported'), 0), 6) unsupported_refusal_accuracy, round(coalesce(avg(refusal_match) filter (kind = 'no_strong_answer'), 0), 6) no_strong_answer_accuracy,
  round(avg(nonrefusal), 6) format_rule_mean, round(avg(cited), 6) resource_rule_mean, round(avg(cited), 6) document_rule_mean, round(avg(nonrefusal), 6) nonrefusal_rule_mean, {', '.join(f'round(avg(score), 6) llm_{n}_mean' for n in (*measures.STRESS_SCORES, 'answer_quality_mean'))}
  from m group by grouping sets ((lang, upper(lang)), ())""")
def stress_rollup(spark, sf_dir):
    return measures.summary(measures.scored(cases(spark, sf_dir)))


@query(f"with {_CASES} select doc_id, refusal_match, nonrefusal nonrefusal_rule, cited resource_rule, nonrefusal format_rule, round(score, 6) llm_answer_quality_mean from m")
def answer_rules(spark, sf_dir):
    c = measures.scored(cases(spark, sf_dir))
    return c.select("doc_id", "refusal_match", "nonrefusal_rule", "resource_rule", "format_rule", "llm_answer_quality_mean")


class ByLength:
    """A judge for tests of the way to its scores: they are told by the length of the answer in the prompt; completeness is left out."""

    def complete(self, kind: str, prompts) -> list[str]:
        sizes = [len(json.loads(p)["generated_answer"]) for p in prompts]
        return [f'Scores: {{"relevance": {min(n, 400) / 400}, "groundedness": {n % 3 / 2}, "citation_accuracy": {n % 2}, "instruction_following": 1, "notes": "{n}"}} end' for n in sizes]


@query("""with a as (select a.conv_id, a.turn, length(a.text) n from conversations a join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant')
  select conv_id, turn, least(n, 400) / 400.0::double llm_relevance, (n % 3) / 2.0::double llm_groundedness, (n % 2)::double llm_citation_accuracy, 0.0::double llm_completeness, 1.0::double llm_instruction_following,
  round((least(n, 400) / 400.0::double + (n % 3) / 2.0::double + n % 2 + 1) / 5, 6) llm_answer_quality_mean, n::varchar notes from a""")
def judged_cases(spark, sf_dir):
    """Every answer of an assistant to the turn before it, from the prompt of its judge over a ledger of calls to its scores."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("generated_answer")).join(asked, ["conv_id", "turn"])
    rows = said.withColumns({"answer_expectation": F.lit("supported"), "expected_document_ids": F.array(F.lit("d")), "expected_documents": F.expr("array(struct('c' as company_name, 'f' as source_file))")})
    own = ledger.Ledger(spark, shared_path(spark, "ledger"), ByLength(), block=1 << 16, valid=judge.valid)
    out = measures.scored(judge.judged(rows, own))
    return out.select("conv_id", "turn", *(f"llm_{n}" for n in measures.STRESS_SCORES), "llm_answer_quality_mean", F.col("scores.notes").alias("notes"))


@query("select doc_id, l.quality is not null labelled, l.quality is null missing from documents d full join labels l using (doc_id)")
def set_diff_ids(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d")), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    both = d.join(x, "doc_id", "full")
    return both.select("doc_id", F.col("l").isNotNull().alias("labelled"), F.col("l").isNull().alias("missing"))


@query("select doc_id id, l.quality table_metadata, l.quality is distinct from (case when doc_id % 2 = 0 then 1 end) changed from documents d left join labels l using (doc_id)")
def enrich_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, 1).cast("bigint").alias("table_metadata"))
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("bigint").alias("table_metadata"))
    return artifacts.enriched(d, chunks).select("id", F.col("table_metadata"), "changed")


def embedding_records(spark, sf_dir):
    """Embeddings as records of their label's document: every 50th is missing, every 40th twice, every 30th says another text, every 25th has no kind."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc"), "label").alias("document_id"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "vec_id")
    text = F.concat(F.lit("text "), "vec_id")
    expected = e.select("document_id", "id", text.alias("text"), F.col("id").alias("chunk_id"), F.lit("text").alias("chunk_type"))
    given = e.filter("vec_id % 50 <> 0").withColumn("n", F.explode(F.when(F.col("vec_id") % 40 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    given = given.select("document_id", "id", "vector", F.when(F.col("vec_id") % 30 == 0, "other").otherwise(text).alias("text"), F.col("id").alias("chunk_id"), F.when(F.col("vec_id") % 25 != 0, "text").alias("chunk_type"), F.when(F.col("vec_id") % 25 != 0, F.array(F.lit("chunk_id"), F.lit("chunk_type"))).otherwise(F.array(F.lit("chunk_id"))).alias("payload_keys"))
    manifest = e.groupBy("document_id").agg(F.count("*").alias("chunk_count_embedded"), F.lit(64).alias("vector_dimension"))
    return artifacts.embedding_metrics(given, expected, manifest, ["chunk_id", "chunk_type"])


_EMBEDDED = """e as (select 'doc' || label document_id, vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) l, len(embedding) n from embeddings), g as (select *, unnest(case when vec_id % 40 = 0 then [1, 2] else [1] end) copy from e where vec_id % 50 <> 0),
  x as (select document_id, count(*) source_chunk_count, count(*) filter (vec_id % 50 <> 0) have from e group by 1),
  m as (select document_id, count(*) k, count(distinct vec_id) u, round(count(*) filter (vec_id % 30 <> 0)::double / count(*), 6) texts, round(count(*) filter (vec_id % 25 <> 0)::double / count(*), 6) metas, round(sum(case when vec_id % 25 <> 0 then 2 else 1 end)::double / (2 * count(*)), 6) fields, round(min(l), 6) norm_min, round(max(l), 6) norm_max, round(avg(l), 6) norm_mean, round(stddev_pop(l), 6) norm_std from g group by 1)"""


@query(f"""with {_EMBEDDED} select document_id, source_chunk_count, k embedded_record_count, u unique_embedded_id_count, case when source_chunk_count = k then 1.0 else 0.0 end manifest_count_matches_rate, round(have::double / source_chunk_count, 6) embedding_coverage_rate, source_chunk_count - have missing_embedding_count, 0::bigint extra_embedding_count, k - u duplicate_embedding_id_count,
  texts payload_text_exact_match_rate, metas payload_metadata_match_rate, fields required_payload_field_presence_rate, 1.0 vector_dimension_consistency_rate, norm_min vector_norm_min, norm_max vector_norm_max, norm_mean vector_norm_mean, norm_std vector_norm_std from x join m using (document_id)""")
def embedding_quality(spark, sf_dir):
    names = ["document_id", "source_chunk_count", "embedded_record_count", "unique_embedded_id_count", "manifest_count_matches_rate", "embedding_coverage_rate", "missing_embedding_count", "extra_embedding_count", "duplicate_embedding_id_count", "payload_text_exact_match_rate", "payload_metadata_match_rate", "required_payload_field_presence_rate", "vector_dimension_consistency_rate"]
    return embedding_records(spark, sf_dir).select(*names, *(f"vector_norm_{n}" for n in ("min", "max", "mean", "std")))


@query(f"""with {_EMBEDDED} select count(*) document_count, sum(source_chunk_count)::bigint source_chunk_count, sum(k)::bigint embedded_record_count, sum(u)::bigint unique_embedded_id_count, round(sum(texts * k) / sum(k), 6) payload_text_exact_match_rate, round(sum(metas * k) / sum(k), 6) payload_metadata_match_rate, round(sum(u)::double / sum(source_chunk_count), 6) embedding_coverage_rate, 64::int vector_dimension, min(norm_min) vector_norm_min, max(norm_max) vector_norm_max, round(avg(norm_mean), 6) vector_norm_mean_macro from x join m using (document_id)""")
def embedding_overall(spark, sf_dir):
    s = artifacts.embedding_summary(embedding_records(spark, sf_dir))
    return s.select("document_count", "source_chunk_count", "embedded_record_count", "unique_embedded_id_count", "payload_text_exact_match_rate", "payload_metadata_match_rate", "embedding_coverage_rate", "vector_dimension", "vector_norm_min", "vector_norm_max", "vector_norm_mean_macro")


@query("with m as (select source, count(*)::double n_documents, avg(n_chars) mean_chars, max(n_chars)::double most_chars from documents group by source) select metric, round(avg(value), 6) mean from (unpivot m on n_documents, mean_chars, most_chars into name metric value value) group by metric")
def macro_means(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("n_documents"), F.avg("n_chars").alias("mean_chars"), F.max("n_chars").cast("double").alias("most_chars"))
    return artifacts.macro_means(d, "source")


@query("select time_bucket(interval 1 hour, ts) window_start, time_bucket(interval 1 hour, ts) + interval 1 hour window_end, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark, sf_dir):
    w = windowed_counts(table(spark, sf_dir, "events"), "ts")
    return w.withColumn("total", F.round("total", 4))


@query("""with h as (select conv_id query_id, turn rank, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) t from conversations), g as (select query_id, g, w from (select query_id, rank, t from h where rank <= 1) x, lateral (select 0 g, string_split(t, ' ')[3] w union all select 1, string_split(t, ' ')[-1]) y where rank = 1),
  r as (select g.query_id, g.g, min(h.rank) filter (contains(h.t, g.w)) r from g join h using (query_id) group by all) select query_id, case when count(r) = count(*) then max(r) end expected_rank, coalesce(case when count(r) = count(*) then max(r) end <= 1, false) hit_at_1, coalesce(case when count(r) = count(*) then max(r) end <= 5, false) hit_at_5 from r group by query_id""")
def snippet_ranks(spark, sf_dir):
    """Two words of each second turn as snippets that some turn must have."""
    c = table(spark, sf_dir, "conversations")
    hits = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    groups = c.filter("turn = 1").select(F.col("conv_id").alias("query_id"), F.array(F.array(F.get(words, F.lit(2))), F.array(F.element_at(words, -1))).alias("groups"))
    return search.snippet_ranks(hits, groups).select("query_id", "expected_rank", "hit_at_1", "hit_at_5")


@query("select o_orderkey, case o_orderkey % 6 when 0 then 0 when 1 then o_orderkey when 2 then -(o_orderkey % 1000) when 3 then o_orderkey % 100 when 4 then 0 else 0 end::int n from orders")
def whole_numbers(spark, sf_dir):
    """Numbers as JSON may have them: true, a whole one, one with a fraction and a sign, text around it, nothing."""
    k = F.col("o_orderkey")
    said = F.when(k % 6 == 0, "true").when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, F.concat(F.lit("-"), (k % 1000).cast("string"), F.lit(".75"))).when(k % 6 == 3, F.concat((k % 100).cast("string"), F.lit(".0"))).when(k % 6 == 4, F.concat(F.lit("p"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", int_or_zero(said).alias("n"))


@query("""with d as (select doc_id, lang, case when doc_id % 2 = 0 then 1 end old, quality from documents left join labels using (doc_id))
  select count(distinct lang) document_count, count(*) record_count, count(*) filter (doc_id % 3 = 0) table_record_count, count(*) filter (doc_id % 3 = 0 and quality is not null) table_records_with_metadata, count(*) filter (quality is distinct from old) changed_record_count from d""")
def enrichment_sums(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text").alias("chunk_type"), F.when(F.col("doc_id") % 2 == 0, 1).cast("bigint").alias("table_metadata"))
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("bigint").alias("table_metadata"))
    return artifacts.enrichment_summary(artifacts.enriched(d, chunks))


@query("""select event_id, case when event_type = 'view' or (event_type in ('click', 'signup') and user_id % 3 > 1) then greatest(5 + event_id % 30, 20) else 5 + event_id % 30 end n from events""")
def search_limits(spark, sf_dir):
    """How many hits a question gets: by its kind, what it computes and how many documents it is on."""
    e = table(spark, sf_dir, "events")
    n = retrieval.effective_limit(F.lit(5) + F.col("event_id") % 30, F.col("event_type") == "view", F.col("event_type").isin("click", "signup"), F.col("user_id") % 3)
    return e.select("event_id", n.alias("n"))


@query("""select doc_id, md5('[Evidence ' || (doc_id % 9 + 1) || ']' || chr(10) || 'score: ' || printf('%.6f', (doc_id % 100) / 100.0::double) || chr(10) || 'company: ' || upper(lang) || chr(10) || 'document_id: ' || source || chr(10) || 'source_file: ' || source || '.pdf' || chr(10)
  || 'page_numbers: ' || (doc_id % 50) || ', ' || (doc_id % 50 + 1) || chr(10) || 'chunk_id: d' || doc_id || chr(10) || 'chunk_type: text' || chr(10) || 'section_titles: ' || case when doc_id % 2 = 0 then 'One, Two' else '' end || chr(10) || case when doc_id % 5 = 0 then 'table_metadata: {"rows":' || doc_id || '}' || chr(10) else '' end
  || 'exact_text:' || chr(10) || case when length(t) <= 500 then t else rtrim(t[:500], ' ' || chr(10)) || chr(10) || '[TRUNCATED]' end) digest from (select *, trim(text, ' ' || chr(10)) t from documents)""")
def evidence_blocks(spark, sf_dir):
    """The block of a hit as a prompt has it."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", (k % 9 + 1).cast("int").alias("rank"), ((k % 100) / F.lit(100.0)).alias("score"), F.upper("lang").alias("company"), F.col("source").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.array(k % 50, k % 50 + 1).alias("page_numbers"), F.concat(F.lit("d"), k.cast("string")).alias("chunk_id"),
        F.lit("text").alias("chunk_type"), F.when(k % 2 == 0, F.array(F.lit("One"), F.lit("Two"))).alias("section_titles"), F.when(k % 5 == 0, F.concat(F.lit('{"rows":'), k.cast("string"), F.lit("}"))).alias("table_metadata"), "text",
    )
    return d.select("doc_id", F.md5(section(500)).alias("digest"))


_EXPECT = "select doc_id, source, lang, doc_id % 50 page, 'Answer' || chr(10) || 'See ' || upper(lang) || ' in ' || upper(source) || '.PDF, page ' || (doc_id % 50) said from documents"


@query(f"""select doc_id, contains(lower(said), lower(lang)) and contains(lower(said), source || '.pdf') and contains(lower(said), (page + (doc_id % 3 = 0)::int)::varchar) present, contains(lower(said), source || '.pdf') or contains(lower(said), 'nobody') named from ({_EXPECT})""")
def resource_checks(spark, sf_dir):
    """Whether an answer has the resources that it should."""
    page = F.col("doc_id") % 50
    d = table(spark, sf_dir, "documents").withColumn("said", F.concat(F.lit("Answer\nSee "), F.upper("lang"), F.lit(" in "), F.upper("source"), F.lit(".PDF, page "), page.cast("string")))
    file = F.concat("source", F.lit(".pdf"))
    want = F.array(F.struct(F.col("lang").alias("company"), file.alias("source_file"), (page + (F.col("doc_id") % 3 == 0).cast("int")).alias("page")))
    return d.select("doc_id", measures.resources_present(F.col("said"), want).alias("present"), measures.names_documents(F.col("said"), F.array(F.struct(F.lit("Nobody").alias("company_name"), file.alias("source_file")))).alias("named"))


@query("""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i, count(*) over (partition by conv_id) n, text, role from conversations)
  select conv_id::varchar category_id, conv_id || '-' || turn case_id, i category_case_index, length(text) n_chars from c where role = 'user'""")
def bank_cases(spark, sf_dir):
    """Conversations as a bank of questions: flattened, numbered in their category, those of users kept."""
    one = F.struct(F.col("turn"), F.struct(F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("question"), F.when(F.col("role") == "user", "supported").otherwise("unsupported").alias("answer_expectation"), *(F.lit(None).cast("array<string>").alias(c) for c in ("company_filters", "chunk_types", "expected_document_ids", "expected_chunk_types"))).alias("c"))
    bank = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("category_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("cases"))
    bank = bank.withColumns({"category_name": F.col("category_id"), "category_description": F.lit("")})
    return bank_operators.supported(bank_operators.flatten_bank(bank)).select("category_id", "case_id", F.col("category_case_index").cast("bigint").alias("category_case_index"), F.length("question").alias("n_chars"))


@query("""select vec_id, case label when 0 then 'BMW Group' when 1 then 'Robert Bosch GmbH' when 2 then '' else 'doc' || label end = case label when 2 then 'x' else '' end blank, case label when 0 then 'BMW Group' when 1 then 'Robert Bosch GmbH' when 2 then 'unknown' when 3 then 'unknown' else 'doc' || label end company from embeddings""")
def company_labels(spark, sf_dir):
    """The company of a hit: its name, else its document's id, else unknown."""
    k = F.col("label")
    e = table(spark, sf_dir, "embeddings").withColumn("document_id", F.when(k == 0, "bmw_2024").when(k == 1, "bosch_2024").when(k == 2, "").when(k > 3, F.concat(F.lit("doc"), k.cast("string"))))
    return registry_operators.company_names(e, registry_operators.registry(spark)).select("vec_id", (F.col("company") == "").alias("blank"), "company")


@query("""with c as (select vec_id id, label, vec_id % 7 = 0 missed, (vec_id % 12) + 1 r, (vec_id % 40) / 8.0::double s from embeddings), x as (select *, case when not missed then r end e from c)
  select count(*) case_count, round(avg(s), 3) mean_latency_seconds, max(s) max_latency_seconds, """ + ", ".join(f"count(*) filter (e <= {k}) / count(*)::double hit_at_{k}_rate" for k in (1, 3, 5, 10, 20)) + """, count(*) filter (e is null) missed from x""")
def baseline_summary(spark, sf_dir):
    """Cases whose snippets were found at some rank, or not."""
    k = F.col("vec_id")
    c = table(spark, sf_dir, "embeddings").select(k.alias("query_id"), ((k % 40) / F.lit(8.0)).alias("latency_seconds"), F.when(k % 7 != 0, (k % 12 + 1).cast("int")).alias("expected_rank"))
    c = c.withColumns({f"hit_at_{n}": F.coalesce(F.col("expected_rank") <= n, F.lit(False)) for n in (1, 3, 5, 10, 20)})
    return search.snippet_summary(c).withColumn("missed", F.size("missed").cast("bigint"))


@query("""with c as (select vec_id, label, case when label % 2 = 0 then (vec_id % 5) / 4.0::double end cov, (vec_id % 16) / 16.0::double s from embeddings)
  select case when grouping(label) = 0 then 'c' || label end category_id, case when grouping(label) = 0 then 'C' || label end category_name, count(*) case_count, round(avg(s), 3) mean_latency_seconds, round(quantile_cont(s, 0.95), 3) p95_latency_seconds, round(avg(s), 6) mean_top_score,
  round(avg(s), 6) mean_document_recall_at_10, round(avg(cov), 6) mean_type_coverage_at_3 from c group by grouping sets ((label), ())""")
def type_coverage(spark, sf_dir):
    """Means by category, of type coverage over the cases that expect types only."""
    k = F.col("vec_id")
    s = (k % 16) / F.lit(16.0)
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), "label").alias("category_id"), F.concat(F.lit("C"), "label").alias("category_name"), s.alias("latency_seconds"), *(s.alias(c) for c in ("top_score", "top1_hit", "purity_at_5", *(f"document_recall_at_{n}" for n in search.KS))), *(F.when(F.col("label") % 2 == 0, (k % 5) / F.lit(4.0)).alias(f"type_coverage_at_{n}") for n in (3, 5, 10)))
    return search.stress_summary(e).select("category_id", "category_name", "case_count", "mean_latency_seconds", "p95_latency_seconds", "mean_top_score", "mean_document_recall_at_10", "mean_type_coverage_at_3")


@query("select doc_id::varchar id, doc_id % 2 = 0 matched, list_distinct(list_filter([source, lang, case when doc_id % 2 = 0 then source end], lambda x: x is not null)) = [] none, len(list_distinct(list_filter([source, lang, case when doc_id % 2 = 0 then source else 'other' end], lambda x: x is not null))) n from documents")
def wanted_documents(spark, sf_dir):
    """Ids given directly and those that were found, each once."""
    d = table(spark, sf_dir, "documents").withColumn("w", registry_operators.wanted(F.array("source", "lang"), F.array(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("other"))))
    return d.select(F.col("doc_id").cast("string").alias("id"), (F.element_at("w", -1) != "other").alias("matched"), (F.size("w") == 0).alias("none"), F.size("w").alias("n"))
