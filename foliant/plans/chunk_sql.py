"""SQL for the chunker: documents as laid-out pages, cut and packed by recursive queries, one step a unit."""

from __future__ import annotations

MOST, TARGET, SOFT, LEAST_SOFT, HEADING, TRAILING, SMALL, TINY = 1500, 1100, 1400, 450, 180, 250, 280, 140


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def first_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def last_three(x: str) -> str:
    """The last 3 of a list."""
    return f"list_reverse(list_reverse({x})[1:3])"


def merged_titles(x: str) -> str:
    return last_three(first_distinct(x))


def latest_titles(x: str) -> str:
    """The last 3 distinct ones, each where it was last."""
    return f"list_reverse({first_distinct(f'list_reverse({x})')}[1:3])"


def _count(x: str, kind: str) -> str:
    return f"length(regexp_replace({x}, '[^{kind}]', '', 'g'))"


def title(t: str) -> str:
    letters = _count(t, r"\pL")
    return rf"(length({t}) between 1 and 160 and {letters} > 0 and not ({letters} <= 1 and {_count(t, r'\p{Nd}')} = 0 and length({t}) <= 2))"


def heading(t: str, lines: str = "1") -> str:
    words = f"len(list_filter(string_split({t}, ' '), lambda w: w <> ''))"
    return rf"({title(t)} and length({t}) <= 140 and {words} <= 14 and not regexp_matches({t}, '[.!?]$') and {lines} <= 3 and ({words} <= 8 or {_count(t, r'\p{Lu}')} >= 0.55::double * {_count(t, r'\pL')}))"


def _boundary(t: str, most: int) -> str:
    """Characters before the cut of a text longer than most."""
    least = max(int(most * 0.6), 200)
    part = f"substring({t}, {least + 1}, {most + 1 - least})"
    at = lambda mark: f"{least} + length({part}) - strpos(reverse({part}), '{mark[::-1]}') + 1 - {len(mark)} + {len(mark.strip())}"
    marks = " ".join(f"when contains({part}, '{m}') then {at(m)}" for m in (". ", "; ", ": ", ", ", " "))
    after = f"strpos(substring({t}, {most + 1}), ' ') - 1"
    return f"case {marks} when {after} between 0 and 120 then {most} + {after} else {most} end"


def split_long(name: str, of: str, most: int) -> str:
    """CTEs that end in name (id, part, text): the parts of the texts of table of (id, text), numbered from 0."""
    n = name
    sentence = r"""regexp_replace(t, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g')"""
    return f"""
    {n}_t as (select id, {collapsed('text')} t from {of}),
    {n}_s as (select id, string_split({sentence}, chr(1)) s from {n}_t where length(t) > {most}),
    {n}_p as (select id, 1 i, 1 pack, s[1] said, s from {n}_s union all
      select id, i + 1, case when length(said) + 1 + length(s[i + 1]) <= {most} then pack else pack + 1 end,
        case when length(said) + 1 + length(s[i + 1]) <= {most} then said || ' ' || s[i + 1] else s[i + 1] end, s from {n}_p where i < len(s)),
    {n}_k as (select id, pack, arg_max(said, i) said from {n}_p group by id, pack),
    {n}_c as (select id, pack, 0 cut, null::varchar made, said rest from {n}_k union all
      select id, pack, cut + 1, {collapsed(f"substring(rest, 1, {_boundary('rest', most)})")}, {collapsed(f"substring(rest, {_boundary('rest', most)} + 1)")} from {n}_c where length(rest) > {most}),
    {n}_a as (select id, pack, cut, made text from {n}_c where made is not null union all select id, pack, 1000000000, rest from {n}_c where length(rest) <= {most}),
    {n} as (select id, (row_number() over (partition by id order by pack, cut) - 1)::int part, text from {n}_a where text <> ''
      union all select id, 0, t from {n}_t where length(t) between 1 and {most})"""


def chunk_text(most: int) -> str:
    return f"""with recursive given as (select doc_id id, text from documents), {split_long('cuts', 'given', most)}
    select id doc_id, part, text, length(text) n from cuts"""


def _layout(height: float, line: float) -> str:
    """CTEs that end in chunks (source, doc_id, k, text, titles, paras, kind, page_type, flagged) and the tables of first pages."""
    small = lambda c: f"(length({c}.text) <= {SMALL} and (length({c}.text) <= {TINY} or len(list_filter(string_split({c}.text, chr(10)), lambda x: trim(x) <> '')) <= 3 or {c}.paras <= 1))"
    fit = lambda a, b: f"({a}.kind = {b}.kind and length({a}.text) + 2 + length({b}.text) <= {MOST})"
    both = lambda a, b: f"{{'text': {a}.text || chr(10) || chr(10) || {b}.text, 'titles': {merged_titles(f'list_concat({a}.titles, {b}.titles)')}, 'paras': {a}.paras + {b}.paras, 'kind': {a}.kind}}"
    times = f"{line}::double"
    # what a step of the packing does with the unit u and the held ones h
    early = f"(h.text is not null and ((u.heading is not null and length(h.text) >= {HEADING}) or (length(h.text) >= {LEAST_SOFT} and length(h.text) + length(u.text) > {SOFT})))"
    alone = f"(h.text is null or {early})"
    text = f"case when {alone} then u.text else h.text || chr(10) || chr(10) || u.text end"
    own = f"{{'text': {text}, 'titles': case when {alone} then u.titles else list_concat(h.titles, u.titles) end, 'paras': case when {alone} then u.paras else h.paras + u.paras end, 'kind': case when {alone} then u.kind else h.kind end}}"
    none = "null::struct(\"text\" varchar, titles varchar[], paras bigint, kind varchar)"
    return f"""
    l as (select source, doc_id, i - 1 i, line, {collapsed('line')} t from
      (select source, doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from documents)),
    m as (select *, lower(t) k, case when i * {times} <= {height}::double * 0.08::double then 'top' when i * {times} + 0.4::double >= {height}::double - {height}::double * 0.08::double then 'bottom' end place from l where t <> ''),
    enough as (select source, case when count(*) < 2 then 2 else least(5, count(*)) end least_pages, min(doc_id) first from documents group by source),
    rep as (select source, k, count(distinct doc_id) times from m join enough using (source) where place is not null group by source, k, least_pages having count(distinct doc_id) >= least_pages),
    pages as (select d.source, d.doc_id, coalesce(n, 0) n, case when d.doc_id = first and coalesce(n, 0) <= 10 then 'visual_or_table' when d.doc_id = first then 'mixed' when coalesce(n, 0) <= 8 then 'visual_or_cover' else 'text' end page_type
      from documents d join enough using (source) left join (select source, doc_id, count(*) n from m group by all) using (source, doc_id)),
    seen as (select m.*, case when place is not null then times end flagged, times, i = 0 and length(line) < 100 head from m left join rep using (source, k)),
    flags as (select distinct source, doc_id from seen where flagged is not null),
    para as (select *, case when head and {title('t')} then t end heading from seen where head or coalesce(times, 0) < 5),
    paras as (select *, list(heading) filter (heading is not null) over (partition by source, doc_id order by i) heads from para),
    decided as (select source, doc_id, count(*) c, sum(length(t)) chars, count(*) filter (length(t) >= 180 or len(string_split(t, ' ')) >= 25) long, count(*) filter (length(t) <= 40) short, count(heading) hs, max(length(t)) longest from para group by all),
    usable as (select source, doc_id, case when page_type in ('visual_or_table', 'visual_or_cover') and chars < 200 then false when c >= 20 and chars::double / c < 35 and short::double / c >= 0.6::double then false
        when c >= 12 and chars::double / c < 50 and long = 0 and hs >= c * 0.35::double then false
        else longest >= 450 or (chars >= 350 and c >= 2 and chars::double / c >= 45) or long >= 2 or (chars >= 600 and c <= 10) end ok from decided join pages using (source, doc_id)),
    others as (select source, doc_id, count(*) filter (flagged is null) others from seen group by all),
    kept as (select source, doc_id, i, t, row_number() over (partition by source, doc_id order by i) j from seen join others using (source, doc_id) left join usable using (source, doc_id)
      where not coalesce(ok, false) and not (others >= 3 and coalesce(flagged, 0) >= 5 and len(string_split(t, ' ')) <= 12 and length(t) <= 120)),
    grouped as (select source, doc_id, j, i, 1 g, t said, 1 n from kept where j = 1 union all
      select k.source, k.doc_id, k.j, k.i, case when apart then g + 1 else g end, case when apart then k.t else said || chr(10) || k.t end, case when apart then 1 else grouped.n + 1 end
      from grouped join (select * from kept) k on k.source = grouped.source and k.doc_id = grouped.doc_id and k.j = grouped.j + 1,
      lateral (select k.i - grouped.i >= 2 or (length(grouped.said) >= 60 and {heading('k.t')}) apart)),
    groups as (select source, doc_id, g, arg_max(said, j) said, max(n) n from grouped group by all),
    titled as (select *, case when {heading(collapsed('said'), 'n')} then said end heading, case when {heading(collapsed('said'), 'n')} then {collapsed('said')} end name from groups),
    lined as (select *, list(name) filter (name is not null) over (partition by source, doc_id order by g) heads from titled),
    units as (select source, doc_id, i u, t as text, 'paragraph' kind, heading, {latest_titles("coalesce(heads, [])")} titles, 1 paras from paras join usable using (source, doc_id) where ok
      union all select source, doc_id, g, said, 'clean_lines', heading, {latest_titles("coalesce(heads, [])")}, 0 from lined),
    long_units as (select source || chr(1) || doc_id || chr(1) || u id, text from units where length(text) > {MOST}),
    {split_long('cut_units', 'long_units', MOST)},
    several as (select id from cut_units group by id having count(*) > 1),
    parts as (select source, doc_id, u, 0 part, text, kind, heading, titles, paras from units where source || chr(1) || doc_id || chr(1) || u not in (select id from several)
      union all select source, doc_id, u, part, c.text, kind, case when part = 0 then heading end, titles, case when part = 0 then paras else 0 end from units join cut_units c on c.id = source || chr(1) || doc_id || chr(1) || u where c.id in (select id from several)),
    steps as (select *, row_number() over (partition by source, doc_id order by u, part) q from parts),
    packed as (select source, doc_id, 0::bigint q, {none} h, {none} before, {none} made from pages union all
      select p.source, p.doc_id, u.q, case when length(own.text) >= {TARGET} then {none} else own end, case when {early} then h end, case when length(own.text) >= {TARGET} then own end
      from packed p join steps u on u.source = p.source and u.doc_id = p.doc_id and u.q = p.q + 1, lateral (select {own} own)),
    ends as (select source, doc_id, max(q) q from packed group by all),
    emitted as (select source, doc_id, q, 0 e, before c, false rest from packed where before is not null union all select source, doc_id, q, 1, made, false from packed where made is not null
      union all select source, doc_id, q, 2, h, true from packed join ends using (source, doc_id, q) where h is not null),
    outs as (select source, doc_id, rest, {{'text': c.text, 'titles': {merged_titles("list_filter(c.titles, lambda x: trim(x) <> '')")}, 'paras': c.paras, 'kind': c.kind}} c, row_number() over (partition by source, doc_id order by q, e) x, count(*) over (partition by source, doc_id) n from emitted),
    tailed as (select o.source, o.doc_id, o.c, o.x, o.n, r.c r from outs o left join outs r on r.source = o.source and r.doc_id = o.doc_id and r.rest and r.x = o.n and o.x = o.n - 1 and o.n > 1 and length(r.c.text) < {TRAILING} and length(o.c.text) + 2 + length(r.c.text) <= {MOST}
        and r.doc_id in (select doc_id from pages where page_type not in ('visual_or_table', 'visual_or_cover'))),
    joined as (select source, doc_id, x, case when r is null then c else {both('c', 'r')} end c, max(r is not null) over (partition by source, doc_id) gone, n from tailed),
    run as (select source, doc_id, x, c, case when gone then n - 1 else n end n from joined where not (gone and x = n)),
    walk as (select source, doc_id, 1::bigint x, {none} last, {none} made, n from (select distinct source, doc_id, n from run) union all
      select w.source, w.doc_id, case when ahead then w.x + 2 else w.x + 1 end, case when ahead then {both('r.c', 's.c')} when back then {both('w.last', 'r.c')} else r.c end, case when back then {none} else w.last end, w.n
      from walk w join run r on r.source = w.source and r.doc_id = w.doc_id and r.x = w.x left join run s on s.source = w.source and s.doc_id = w.doc_id and s.x = w.x + 1,
      lateral (select s.c is not null and {small('r.c')} and {fit('r.c', 's.c')} ahead), lateral (select not ahead and w.last is not null and {small('r.c')} and {fit('w.last', 'r.c')} back)),
    chunks as (select source, doc_id, 2 * x x, made c from walk where made is not null union all select source, doc_id, 2 * x + 1, last from walk where x > n and last is not null),
    nations as (select 'Table with ' || count(*) || ' rows and 2 columns.' || chr(10) || 'Cell count: ' || 2 * count(*) || '.' || chr(10) || 'Included rows: 1 to ' || count(*) || '.' || chr(10)
      || string_agg('Row ' || r || ' [content]: C1=' || n_nationkey || ' | C2=' || n_name, chr(10) order by r) said from (select *, row_number() over (order by n_nationkey) r from nation)),
    page_heads as (select source, doc_id, {merged_titles("list(heading order by u)")} heads from units where heading is not null group by all),
    every as (select source, doc_id, 0 t, x, case when page_type in ('visual_or_table', 'visual_or_cover') then 'visual' else 'text' end chunk_type, c.kind content_source, c.text as text, c.paras::int paras, c.titles titles from chunks join pages using (source, doc_id)
      union all select enough.source, first, 1, 0, 'table', 'tables', said, 0, coalesce(heads, []) from enough, nations left join page_heads h on h.source = enough.source and h.doc_id = first),
    numbered as (select *, row_number() over (partition by source order by doc_id, t, x) chunk_index from every)"""


def layout_chunks(height: float, line: float) -> str:
    slug = r"lower(regexp_replace(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    return f"""with recursive {_layout(height, line)}
    select case when {slug} = '' then 'document' else {slug} end || '__c' || lpad(chunk_index::varchar, 4, '0') || '__' || chunk_type || '__p' || doc_id || case when t = 1 then '__t001' else '' end chunk_id,
      chunk_index::int chunk_index, source || '.pdf' source_file, chunk_type, content_source, doc_id::int page_start, doc_id::int page_end, text, length(text)::int char_count,
      len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::int line_count, paras::int paragraph_count, array_to_string(titles, ' | ') titles from numbered"""


def layout_chunk_stats(height: float, line: float) -> str:
    return f"""with recursive {_layout(height, line)},
    kinds as (select source, count(*) total_chunks, count(*) filter (chunk_type = 'text') text_chunk_count, count(*) filter (chunk_type = 'table') table_chunk_count, count(*) filter (chunk_type = 'visual') visual_chunk_count from every group by source),
    read as (select p.source, count(*) source_page_count, count(*) filter (coalesce(ok, false)) pages_using_paragraphs from pages p left join usable using (source, doc_id) group by p.source),
    said as (select source, count(*) paragraph_total, count(*) filter (t = '') paragraph_empty from l group by source),
    again as (select source, count(*) n from rep group by source)
    select source || '.pdf' source_file, 'plain' model_id, source_page_count, pages_using_paragraphs, total_chunks, text_chunk_count, table_chunk_count, visual_chunk_count, paragraph_total, paragraph_empty, 0::bigint paragraph_ambiguous_page,
      coalesce(n, 0) repeated_header_footer_candidate_count, source_page_count - pages_using_paragraphs pages_using_line_fallback from read join kinds using (source) join said using (source) left join again using (source)"""


def layout_chunk_coverage(height: float, line: float, whole: str, tokens: str) -> str:
    """whole and tokens are formats of a text without hyphens at line ends, and of its folded words."""
    return f"""with recursive {_layout(height, line)},
    clean as (select source, doc_id, i, {whole.format('line')} w, i = 0 and length(line) < 100 head from l),
    given as (select source, doc_id, string_agg(w, chr(10) || chr(10) order by i) filter (w <> '') said, list(lower(w)) filter (head and w <> '') heads from clean group by all),
    cut as (select source, doc_id, string_agg({whole.format('text')}, chr(10) || chr(10) order by chunk_index) said, array_to_string(flatten(list(titles)), ' || ') titles from numbered where t = 0 group by all),
    a as (select source, doc_id, token, count(*) n from (select source, doc_id, unnest({tokens.format('said')}) token from given) group by all),
    b as (select source, doc_id, token, count(*) n from (select source, doc_id, unnest({tokens.format('said')}) token from cut) group by all),
    o as (select source, sum(a.n) l, sum(b.n) r, sum(case when a.n is not null and b.n is not null then least(a.n, b.n) else 0 end) m from a full join b using (source, doc_id, token) group by source),
    h as (select g.source, sum(coalesce(len(heads), 0)) heads, sum(coalesce(len(list_filter(heads, lambda x: coalesce(contains(lower({whole.format('c.said')}), x), false) or coalesce(contains(lower({whole.format('c.titles')}), x), false))), 0)) covered from given g left join cut c using (source, doc_id) group by g.source),
    n as (select source, count(*) pages from documents group by source),
    made as (select source, count(distinct doc_id) chunk_pages from numbered group by source),
    rates as (select *, round(m::double / nullif(r, 0), 6) p, round(m::double / nullif(l, 0), 6) c from o)
    select source || '.pdf' source_file, round(chunk_pages::double / pages, 6) page_coverage_rate, 1.0::double table_coverage_rate, c source_token_recall, p chunk_token_precision, case when p + c > 0 then round(2 * p * c / (p + c), 6) end chunk_token_f1,
      round(covered::double / nullif(heads, 0), 6) heading_coverage_rate, round(r::double / nullif(l, 0), 6) chunk_text_to_source_token_ratio, 0.0::double cross_page_text_chunk_rate
    from rates join h using (source) join n using (source) join made using (source)"""


def word_errors(tokens: str) -> str:
    """The edit distance of two lists of words row by row: of each row the least of what comes from above, then from the left."""
    side = lambda k: f"max(case when turn % 2 = {k} then text end)"
    above = "list_transform(row, lambda v, k: case when k = 1 then v + 1 else least(v + 1, row[k - 1] + case when b[k - 1] = a[i + 1] then 0 else 1 end) - k + 1 end)"
    return f"""with recursive given as (select conv_id, turn // 2 pair, {side(0)} x, {side(1)} y from conversations group by all having x is not null and y is not null),
    words as (select conv_id, pair, {tokens.format('x')} a, {tokens.format('y')} b from given),
    rows as (select conv_id, pair, 0 i, list_transform(range(len(b) + 1), lambda v: v::bigint) row, a, b from words union all
      select conv_id, pair, i + 1, list_transform(up, lambda v, k: list_min(up[1:k]) + k - 1), a, b
      from rows, lateral (select {above} up) where i < len(a)),
    done as (select conv_id, pair, len(a) n, len(b) k, row[len(b) + 1] e, len(a) + len(b) t, a, b from rows where i = len(a)),
    counts as (select conv_id, pair, sum(least(x, y)) m from (select conv_id, pair, token, sum(x) x, sum(y) y from (select conv_id, pair, unnest(a) token, 1 x, 0 y from words union all select conv_id, pair, unnest(b), 0, 1 from words) group by all) group by all),
    s as (select conv_id, count(*) pages, count(*) filter (n > 0) pages_with_text, sum(e) filter (n > 0) e, sum(n) n, sum(k) k, sum(coalesce(m, 0)) m,
      round(quantile_cont(e::double / n, 0.5) filter (n > 0), 6) page_wer_median, round(quantile_cont(e::double / n, 0.9) filter (n > 0), 6) page_wer_p90 from done left join counts using (conv_id, pair) group by conv_id),
    r as (select *, round(e::double / nullif(n, 0), 6) word_error_rate, round(m::double / nullif(k, 0), 6) "precision", round(m::double / nullif(n, 0), 6) recall from s)
    select conv_id, pages, pages_with_text, page_wer_median, page_wer_p90, word_error_rate, "precision", recall, case when "precision" + recall > 0 then round(2 * "precision" * recall / ("precision" + recall), 6) end f1 from r"""
