"""DuckDB SQL for those opN queries that SQL can express."""

from __future__ import annotations

from foliant.llm import decontam, divergence, jaccard, mixing, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _parts(kind: str, pattern: str, least: str = "true") -> str:
    k = secrets.KINDS.index(kind)
    return f"""
    select rn, {k} k, s::bigint s, (s + length(m))::bigint e from (
      select rn, m, sum(length(g) + length(m)) over (partition by rn order by i) - length(m) s from (
        select rn, unnest(regexp_split_to_array(t, {_sql(pattern)})) g, unnest(list_append(regexp_extract_all(t, {_sql(pattern)}, 0), null)) m,
          generate_subscripts(regexp_split_to_array(t, {_sql(pattern)}), 1) i
        from d where regexp_matches(t, {_sql(pattern)})
      )) where m is not null and {least}"""


def _op2() -> str:
    prev = lambda r: f"s - max(case when r = {r} then e end) over (partition by rn order by s, k, e rows between unbounded preceding and 1 preceding) <= {secrets.SCOPE}"
    later = lambda r: f"min(case when r = {r} then s end) over (partition by rn order by s, k, e rows between 1 following and unbounded following) - e <= {secrets.SCOPE}"
    near = ", ".join(f"coalesce({prev(r)}, false) or coalesce({later(r)}, false) n{r}" for r in (1, 2, 3))
    coded = lambda x: f"coalesce(string_agg({x}, ',' order by s, k, e), '')"
    name = "['assign','access','hex','ident','phrase','endpoint'][k + 1] || ':' || s || ':' || e"
    return f"""
    with d as (select row_number() over () rn, doc_id, coalesce(text, '') t from documents),
    base as ({_parts('assign', secrets.ASSIGN, f"length(regexp_extract(m, {_sql(secrets.ASSIGN)}, 2)) >= 8")}
      union all {_parts('access', secrets.ACCESS, 'length(m) >= 16')}
      union all {_parts('hex', secrets.HEX, 'length(m) >= 32')}),
    parts as (select * from base union all {_parts('ident', secrets.IDENT)} union all {_parts('phrase', secrets.PHRASE)} union all {_parts('endpoint', secrets.ENDPOINT)}),
    near as (select *, {near} from (select *, case k when 0 then 2 when 1 then 1 when 2 then 2 when 3 then 1 when 4 then 2 else 3 end r from parts)),
    kept as (select * from near where k < 3 or (k = 3 and n2) or (k = 4 and (n1 or n3)) or (k = 5 and n1 and n2))
    select any_value(doc_id) doc_id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
      sha256(coalesce(string_agg({name}, ',' order by s, k, e) filter (k < 3), '')) base_sha256, {coded(name)} spans
    from d left join kept using (rn) group by rn"""


def _op4() -> str:
    m = mixing.MAX_EPOCHS
    return f"""
    with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size,
        md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) place from documents),
    s as (select source, sum(size)::bigint source_size, row_number() over (order by source is null, source) n from d group by source),
    w as (select *, (n - 1) % 3 + 1 weight, {m} * source_size cap, {m} * source_size / ((n - 1) % 3 + 1) r from s),
    o as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by r, n rows between unbounded preceding and 1 preceding), 0) room,
        sum(weight) over (order by r, n rows between current row and unbounded following) open from w),
    f as (select *, room::double * weight >= cap::double * open filled from o),
    t as (select source, source_size, case when filled then cap::double else least(cap::double,
        (first_value(room) over (order by filled, r, n))::double * weight / first_value(open) over (order by filled, r, n)) end target from f),
    x as (select doc_id, size, source_size, target, floor(target + 0.5)::bigint wanted,
        (sum(size) over (partition by d.source order by place, doc_id, size rows between unbounded preceding and current row) - size)::bigint before
        from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target, case when source_size = 0 then 0 else
      ((wanted // source_size) * size + greatest(0, least(size, wanted % source_size - before)))::bigint end taken from x"""


def _op8() -> str:
    n = decontam.WINDOW
    words = lambda of, key: f"select {key}, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from {of}"
    return f"""
    with i as ({words('benchmark', 'item_id')}), d as ({words('documents', 'row_number() over () rn, doc_id')}),
    iw as (select distinct coalesce(item_id::varchar, '') item, m, array_to_string(w[p:p + m - 1], ' ') said from (
      select *, unnest(generate_series(1, len(w) - m + 1)) p from (select *, least(len(w), {n}) m from i where len(w) > 0))),
    sizes as (select distinct m from iw),
    dw as (select rn, p, m, array_to_string(w[p:p + m - 1], ' ') said from (select rn, w, m, unnest(generate_series(1, len(w) - m + 1)) p from d, sizes where len(w) >= m)),
    hits as (select rn, p, m, item from dw join iw using (m, said)),
    cover as (select rn, count(distinct q) n_hit from (select rn, unnest(generate_series(p, p + m - 1)) q from (select distinct rn, p, m from hits)) group by rn),
    items as (select rn, count(*) n_items, string_agg(item, ',' order by item) said from (select distinct rn, item from hits) group by rn)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items.said, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join cover using (rn) left join items using (rn)"""


def _op11() -> str:
    k, same = jaccard.SHINGLE, jaccard.SAME
    return f"""
    with recursive d as (select row_number() over () rn, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
    s as (select distinct rn, array_to_string(w[p:p + {k - 1}], ' ') g from (select *, unnest(generate_series(1, greatest(1, len(w) - {k - 1}))) p from d where len(w) > 0)),
    n as (select rn, count(*) n from s group by rn),
    x as (select a.rn a, b.rn b, count(*) both_have from s a join s b on a.g = b.g and a.rn < b.rn group by all),
    l as (select a, b from x join n na on na.rn = a join n nb on nb.rn = b where 100 * both_have >= {same} * (na.n + nb.n - both_have)),
    e as (select a, b from l union all select b, a from l),
    r as (select rn a, rn b from d union select r.a, e.b from r join e on r.b = e.a)
    select d.doc_id, coalesce(any_value(n), 0) n_shingles, min(o.doc_id) component_id from d left join n using (rn) join r on r.a = d.rn join d o on o.rn = r.b group by d.rn, d.doc_id"""


def _op12() -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    with d as (select *, len(w)::bigint n from (select row_number() over () rn, doc_id, {words} w from documents) where len(w) > 0),
    s as (select count(*) n_docs, sum(n)::bigint n_terms from d),
    q as (select qn, item_id, term, count(*) r from (select row_number() over () qn, item_id, unnest({words}) term from benchmark) group by all),
    c as (select rn, doc_id, n, term, count(*) tf from (select rn, doc_id, n, unnest(w) term from d) where term in (select term from q) group by all),
    f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w from c, s group by term, n_docs),
    x as (select qn, item_id, rn, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint score
      from q join c using (term) join f using (term), s group by all),
    y as (select *, (row_number() over (partition by qn order by score desc, doc_id, rn))::int rank from x where score > 0)
    select item_id, rank, doc_id, score from y where rank <= 10"""


def _op13() -> str:
    u, a = divergence.UNIT, divergence.PRIOR
    rate = lambda n, total: f"1 + (({n} + {a})::hugeint * {u}) // ({total} + {a} * v)::hugeint"
    return f"""
    with d as (select row_number() over () rn, coalesce(lang, '') lang, coalesce(source, '') source, {_LOWER} t from documents),
    w as (select rn, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
    kept as (select lang, term, count(*) lang_n from w group by lang, term having count(distinct rn) >= {divergence.LEAST}),
    l as (select lang, count(term) v, coalesce(sum(lang_n), 0) lang_total from (select distinct lang from d) left join kept using (lang) group by lang),
    c as (select w.lang, w.source, term, count(*) n from w join kept using (lang, term) group by all),
    g as (select s.lang, s.source, v, lang_total, coalesce(sum(n), 0) total from (select distinct lang, source from d) s join l using (lang) left join c on c.lang = s.lang and c.source = s.source group by all),
    r as (select g.lang, g.source, kept.term, coalesce(n, 0) n, {rate('coalesce(n, 0)', 'total')} p, {rate('lang_n', 'lang_total')} q from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
    x as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p))::bigint value from r a join r b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    y as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
      union all select lang, source, 'term', term, (p - q)::bigint from r where n > 0 and p > q),
    z as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from y)
    select * from z where part = 'pair' or rank <= {divergence.TERMS}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _op2(), "op4_mixing": _op4(), "op8_decontamination": _op8(), "op11_jaccard": _op11(), "op12_ranked_search": _op12(), "op13_divergence": _op13()}
