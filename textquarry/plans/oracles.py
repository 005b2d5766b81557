"""DuckDB SQL with the results of the registered queries.

Written from the definitions, on the same tables. Analysis steps that need
look-around in Java are written with capture groups, applied twice as matches
may share a neighbour. What SQL cannot express (entities, NFKC, crc32, pages,
streams, ordered folds) has no entry.
"""

from __future__ import annotations

from textquarry.functions.cleaning import INVISIBLE, LINK, MAIL, TAG
from textquarry.functions.lexical import TOKEN
from textquarry.functions.stemmer import duckdb_ctes
from textquarry.functions.stopwords import STOPWORDS
from textquarry.functions.urls import RESERVED_OWNERS, TRACKING
from textquarry.operators.crawl import EXPORT_FIELDS, OUTCOMES

FIELDS = ("nome", "descricao", "rotulos", "readme")
_Q = lambda xs: ", ".join("'" + x + "'" for x in xs)
_E = lambda p: p.replace("'", "''")


def _re(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{_E(pattern)}', '{to}', 'g')"


def _clean(text: str) -> str:
    for pattern, to in ((INVISIBLE, ""), (LINK, " "), (MAIL, " "), (TAG, " ")):
        text = _re(text, pattern, to)
    return text


def _special(text: str) -> str:
    steps = [
        (r"(?i)(^|[^\p{L}\p{N}_+])c\+\+($|[^a-z_+])", r"\1 cpp \2"),
        (r"(?i)(^|[^\p{L}\p{N}_#])c#($|[^\p{L}\p{N}_#])", r"\1 csharp \2"),
        (r"(?i)(^|[^\p{L}\p{N}_#])f#($|[^\p{L}\p{N}_#])", r"\1 fsharp \2"),
        (r"(?i)\basp\.net\b", " aspnet "),
        (r"(?i)(^|[^\p{L}\p{N}_.])\.net\b", r"\1 dotnet "),
        (r"(?i)\bobjective-c\b", " objectivec "),
        (r"(?i)\b([a-z0-9]+)\.js\b", r" \1js "),
    ]
    for pattern, to in steps:
        text = _re(text, pattern, to)
        if pattern.startswith("(?i)(^"):
            text = _re(text, pattern, to)
    return text


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{_E(TOKEN)}')"


def _fold(token: str) -> str:
    return f"strip_accents(replace(lower({token}), 'ß', 'ss'))"


_KEEP = r"length(n) > 0 and length(n) <= 25 and not (length(n) < 2 and regexp_matches(n, '^[\x00-\x7F]*$') and n not in ('c', 'r')) and not (regexp_matches(n, '^\p{Nd}+$') and length(n) > 4)"
_STOP = f"n not in ({_Q(STOPWORDS)})"

_IDEO = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


def _bigrams(parts: str) -> str:
    """A list of tokens with runs of ideographs as bigrams."""
    run = f"case when regexp_matches(r, '[{_IDEO}]') and length(r) > 1 then list_transform(generate_series(1, length(r) - 1), lambda b: substring(r, b, 2)) else [r] end"
    runs = f"regexp_extract_all(x, '[{_IDEO}]+|[^{_IDEO}]+')"
    return f"flatten(list_transform({parts}, lambda x: case when regexp_matches(x, '[{_IDEO}]') then flatten(list_transform({runs}, lambda r: {run})) else [x] end))"


_SEP = "string_split_regex(tok, '[''._-]')"

_FIELDS = """
f as (
  select id doc_id, site,
    concat_ws(' . ', nullif(nome, ''), nullif(dono, '')) nome,
    concat_ws(' . ', nullif(descricao, ''), nullif(resumo, '')) descricao,
    concat_ws(' . ', case when len(topicos) > 0 then array_to_string(topicos, ' . ') end, case when len(categorias) > 0 then array_to_string(categorias, ' . ') end, nullif(linguagem, '')) rotulos,
    coalesce(readme, '') readme
  from projetos
)"""


def _camel(token: str) -> str:
    """Pieces of a camelCase token, blanks between them."""
    text = _re(token, r"['._-]", " ")
    for pattern in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})", r"([a-zA-Z])([^\x00-\x7F])", r"([^\x00-\x7F])([a-zA-Z])"):
        text = _re(_re(text, pattern, r"\1 \2"), pattern, r"\1 \2")
    return f"string_split_regex(trim({text}), ' +')"


_TERMS = f"""{_FIELDS},
scan as (
  {" union all ".join(f"select doc_id, {i} field, {_tokens(_special(_clean(n)))} t from f" for i, n in enumerate(FIELDS))}
), tok as (select doc_id, field, unnest(t) tok, unnest(generate_series(1, len(t))) i from scan),
lists0 as (
  select doc_id, field, i, case when field = 0 then case when len({_camel('tok')}) > 1 then list_concat([array_to_string({_camel('tok')}, '')], {_camel('tok')}) else {_camel('tok')} end
    else string_split_regex(tok, '[''._-]') end l0 from tok
), lists as (select doc_id, field, i, {_bigrams('l0')} l from lists0
), part as (select doc_id, field, i, unnest(l) p, unnest(generate_series(1, len(l))) j from lists),
norm as (select doc_id, field, i, j, {_fold('p')} n from part),
kept as (select doc_id, field, row_number() over (partition by doc_id, field order by i, j) - 1 pos, n token from norm where {_KEEP} and {_STOP})"""

_OCC = f"""{_TERMS}, vocab as (select distinct token from kept),
{duckdb_ctes('vocab')},
occ as (select k.doc_id, k.field, k.pos, s.stem term from kept k join stems s using (token))"""

_LEN = """ids as (select id doc_id, row_number() over (order by id) - 1 unit_id from projetos),
len as (select ids.doc_id, ids.unit_id, coalesce(count(k.token) filter (field = 0), 0) l0, coalesce(count(k.token) filter (field = 1), 0) l1,
  coalesce(count(k.token) filter (field = 2), 0) l2, coalesce(count(k.token) filter (field = 3), 0) l3
  from ids left join kept k using (doc_id) group by 1, 2)"""

_POST = f"""{_OCC}, {_LEN},
post as (select o.term, l.unit_id, o.doc_id, {", ".join(f"count(*) filter (o.field = {i}) tf{i}" for i in range(4))}, count(*) tf from occ o join len l using (doc_id) group by 1, 2, 3),
lex as (select term, count(*) df, sum(tf)::bigint cf from post group by 1)"""


def _query_terms(stem: bool = True) -> str:
    return f"""qt as (select qid, unnest(t) tok, unnest(generate_series(1, len(t))) i from (select qid, {_tokens(_special(_clean('text')))} t from consultas)),
qp as (select qid, i, unnest(l) p, unnest(generate_series(1, len(l))) j from (select qid, i, {_bigrams(_SEP)} l from qt)),
qn as (select qid, i, j, {_fold('p')} n from qp),
qk as (select qid, row_number() over (partition by qid order by i, j) - 1 pos, n token from qn where {_KEEP} and {_STOP}),
""" + (f"qv as (select distinct token from qk), {duckdb_ctes('qv', 'qs')}, q as (select qid, qs.stem term, count(*) qtf, min(pos) pos from qk join qs using (token) group by 1, 2)" if stem else "q as (select qid, token term, count(*) qtf, min(pos) pos from qk group by 1, 2)")


def _top(scores: str, k: int = 10) -> str:
    """Ranked documents from (qid, doc_id, unit_id, score, first)."""
    return f"""{scores},
ranked as (select qid, doc_id, unit_id, score, row_number() over (partition by qid order by round(score, 9) desc, first, unit_id) rank from sc where score > 0),
top as (select qid, rank, doc_id, round(score, 6) score from ranked where rank <= {k})"""


_IDF = "ln(1e0 + (st.n::double - l.df + 0.5e0) / (l.df + 0.5e0))"


def _bm25f(k1="1.2e0", b="0.75e0", w=("3e0", "2e0", "2e0", "1e0")) -> str:
    wtf = " + ".join(f"case when p.tf{i} > 0 then {w[i]} * p.tf{i}::double / ((1e0 - {b}) + {b} * n.l{i}::double / st.a{i}) else 0e0 end" for i in range(4))
    return f"""{_POST}, {_query_terms()},
st as (select greatest(count(*), 1) n, {", ".join(f"greatest(avg(l{i}::double), 1e-9) a{i}" for i in range(4))} from len),
pw as (select q.qid, p.doc_id, p.unit_id, q.pos, q.qtf * {_IDF} idf, {wtf} wtf from q join post p using (term) join lex l using (term) join len n on n.unit_id = p.unit_id cross join st),
sc as (select qid, doc_id, unit_id, sum(idf * wtf / ({k1} + wtf)) score, min(pos) first from pw group by 1, 2, 3)"""


def _bm25(terms: str, stem: bool = True) -> str:
    """One field; ``terms`` ends in occ(doc_id, term)."""
    return f"""{terms}, ids as (select id doc_id, row_number() over (order by id) - 1 unit_id from projetos),
len as (select ids.doc_id, ids.unit_id, count(k.token) l from ids left join kept k using (doc_id) group by 1, 2),
post as (select o.term, n.unit_id, o.doc_id, count(*) tf from occ o join len n using (doc_id) group by 1, 2, 3),
lex as (select term, count(*) df from post group by 1), {_query_terms(stem)},
st as (select greatest(count(*), 1) n, greatest(avg(l::double), 1e-9) a from len),
pw as (select q.qid, p.doc_id, p.unit_id, q.pos, q.qtf * {_IDF} idf, p.tf::double / (0.25e0 + 0.75e0 * n.l::double / st.a) wtf from q join post p using (term) join lex l using (term) join len n on n.unit_id = p.unit_id cross join st),
sc as (select qid, doc_id, unit_id, sum(idf * wtf / (1.2e0 + wtf)) score, min(pos) first from pw group by 1, 2, 3)"""


_PLAIN_OCC = f"{_TERMS}, occ as (select doc_id, field, pos, token term from kept)"


def _chunk_units(size: int, step: int) -> str:
    return f"""{_LEN}, cu as (
  select doc_id, 0 unit_no, 'cabecalho' kind, l0 + l1 + l2 termos, 0 inicio, l0 + l1 + l2 + 200 fim from len
  union all
  select doc_id, i + 1, 'chunk', least({size}, l3 - i * {step}), i * {step}, least(i * {step} + {size}, l3)
  from (select doc_id, l3, unnest(generate_series(0, (case when l3 = 0 then -1 else ceil(greatest(l3 - {size}, 0) / {step}::double)::int end))) i from len)
), un as (select *, row_number() over (order by doc_id, unit_no) - 1 unit_id from cu)"""


def _maxp() -> str:
    return f"""{_OCC}, {_chunk_units(64, 64)},
seg as (
  select u.unit_id, u.doc_id, o.term from un u join occ o on o.doc_id = u.doc_id
  where (u.unit_no = 0 and o.field < 3) or (u.unit_no > 0 and o.field = 3 and o.pos >= u.inicio and o.pos < u.inicio + 64)
), post as (select term, unit_id, doc_id, count(*) tf from seg group by 1, 2, 3),
lex as (select term, count(*) df from post group by 1), {_query_terms()},
st as (select greatest(count(*), 1) n, greatest(avg(termos::double), 1e-9) a from un),
pw as (select q.qid, p.doc_id, p.unit_id, q.pos, q.qtf * {_IDF} idf, p.tf::double / (0.25e0 + 0.75e0 * n.termos::double / st.a) wtf from q join post p using (term) join lex l using (term) join un n on n.unit_id = p.unit_id cross join st),
us as (select qid, doc_id, unit_id, sum(idf * wtf / (1.2e0 + wtf)) score, min(pos) first from pw group by 1, 2, 3),
sc as (select qid, doc_id, max(score) score, min({{'f': first, 'u': unit_id}}).f first, min({{'f': first, 'u': unit_id}}).u unit_id from us group by 1, 2)"""


def _units(kind: str) -> str:
    if kind == "campo":
        body = "select doc_id, 0 unit_no, unit_id, 'campo' kind, l0 + l1 + l2 + l3 termos, 0 inicio, greatest(l0, l1, l2, l3) fim from len"
        return f"with {_TERMS}, {_LEN} {body}"
    if kind == "documento":
        return f"with {_TERMS}, {_LEN} select doc_id, 0 unit_no, unit_id, 'documento' kind, l0 + l1 + l2 + l3 termos, 0 inicio, l0 + l1 + l2 + l3 + 300 fim from len"
    size, step = kind
    return f"with {_TERMS}, {_chunk_units(size, step)} select doc_id, unit_no, unit_id, kind, termos, inicio, fim from un"


_GAPS = f"{_POST}, g as (select term, unit_id, unit_id - coalesce(lag(unit_id) over (partition by term order by unit_id), 0) gap from post)"
_ZIPF = f"{_POST}, z as (select term, cf, row_number() over (order by cf desc, term) posto from lex)"
_CODE = rf"nullif(regexp_extract(lower(trim(resultado)), '^({'|'.join(OUTCOMES)})(?:[^a-z0-9_]|$)', 1), '')"

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?:https?|HTTPS?)://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '')"
_PATH = r"coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^(?:https?|HTTPS?)://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), ''), '/')"


def _canonical(table: str, columns: str) -> str:
    """CTEs up to canon(columns..., canonica) for a table with id and url."""
    return f"""u0 as (select {columns}, {_HOST} h, {_PATH} p, list_filter(string_split(regexp_extract(trim(url), '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '') ps from {table}),
u1 as (select *, list_transform(ps, lambda x: {{'k': split_part(x, '=', 1), 'v': case when contains(x, '=') then regexp_replace(x, '^[^=]*=', '') else '' end}}) kv from u0),
u2 as (select *, array_to_string(list_transform(list_sort(list_filter(kv, lambda x, i: len(list_filter(kv[i + 1:], lambda y: y.k = x.k)) = 0 and x.k not in ({_Q(TRACKING)}) and not starts_with(x.k, 'utm_') and not (x.k = 'page' and x.v = '1'))), lambda x: x.k || '=' || x.v), '&') qs from u1),
canon as (select {columns.replace('url,', 'url,')}, 'https://' || h || case when h in ('github.com', 'gh.example') then case when p = '/' then '/' else regexp_replace(lower(p), '/+$', '') end
  when h in ('sourceforge.net', 'sf.example') and not ends_with(p, '/') and not contains(regexp_extract(p, '[^/]*$', 0), '.') then p || '/' else p end
  || case when qs is not null and qs <> '' then '?' || qs else '' end canonica from u2 where h <> '')"""


_KIND = rf"""case
  when h in ('gh.example', 'github.com') then case
    when regexp_matches(p, '^/topics(?:/[a-z0-9][a-z0-9-]*)?$') then case when qs = '' or try_cast(regexp_extract(qs, '^page=(\d+)$', 1) as bigint) between 2 and 50 then 'listing' end
    when regexp_matches(p, '^/[a-z0-9][a-z0-9-]*/[a-z0-9._-]+$') and qs = '' and split_part(p, '/', 2) not in ({_Q(RESERVED_OWNERS)}) and not ends_with(p, '.git') and split_part(p, '/', 3) not in ('.', '..') then 'project' end
  when h in ('sf.example', 'sourceforge.net') then case
    when regexp_matches(p, '^/projects/[a-z0-9][a-z0-9._-]*/$') then case when qs = '' then 'project' end
    when regexp_matches(p, '^/directory/(?:[a-z0-9][a-z0-9._:+-]*/)*$') then case when qs = '' or try_cast(regexp_extract(qs, '^page=(\d+)$', 1) as bigint) >= 2 then 'listing' end
    when regexp_matches(p, '^/(?:sitemap|directory_sitemap)(?:-\d+)?\.xml$') then case when qs = '' then 'sitemap' end end end"""
_SITE = "case when h in ('gh.example', 'github.com') then 'github' when h in ('sf.example', 'sourceforge.net') then 'sourceforge' end"
_SPLIT = r"regexp_extract(canonica, '^https://([^/?#]*)', 1) h, regexp_extract(canonica, '^https://[^/?#]*([^?#]*)', 1) p, regexp_extract(canonica, '[?](.*)$', 1) qs"

_FILL = [f for f in dict.fromkeys(EXPORT_FIELDS["github"] + EXPORT_FIELDS["sourceforge"]) if f not in ("site", "url", "coletado_em", "status_http")]
_LISTS = ("topicos", "categorias")
_ORDERED = f"""seen as (select distinct on (url, coletado_em) site, tipo, url, {_CODE} code, coletado_em::timestamptz t from visitadas order by url, coletado_em)"""


_WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]+"


def _tidy(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '{_WS}', ' ', 'g')), '')"


def _made_fields() -> str:
    """The fields of the made pages, from the values they are made of."""
    listed = lambda c: f"coalesce(array_to_string(list_filter(list_transform({c}, lambda v: {_tidy('v')}), lambda v, i: v is not null and list_position(list_transform({c}, lambda w: {_tidy('w')}), v) = i), '|'), '')"
    gh, sf = "case when site = 'github' then", "case when site <> 'github' and nome is not null then"
    licence = f"regexp_replace({_tidy('licenca')}, '\\s*license$', '', 'i')"
    return f"""
      select url pagina,
        {gh} lower(chave) when nome is not null then regexp_extract(url, '/projects/([^/]+)/', 1) end chave,
        {gh} split_part(chave, '/', 2) when nome is not null then {_tidy('nome')} end nome,
        {gh} split_part(chave, '/', 1) end dono,
        {gh} {_tidy('descricao')} when nome is not null then {_tidy('descricao')} end descricao,
        {sf} {_tidy('resumo')} end resumo,
        {gh} {listed('topicos')} end topicos,
        {sf} {listed('categorias')} end categorias,
        {gh} {_tidy('linguagem')} when nome is not null then {_tidy('linguagem')} end linguagem,
        {gh} estrelas::bigint end estrelas, {gh} forks::bigint end forks,
        {gh} case when licenca is null then null when {licence} in ('', 'view') then 'Other' else {licence} end when nome is not null then {_tidy('licenca')} end licenca,
        {gh} left({_tidy('readme')}, 100000) end readme,
        {sf} downloads_semana::bigint end downloads_semana, {sf} nota end nota, {sf} num_avaliacoes::bigint end num_avaliacoes,
        {sf} {_tidy('ultima_atualizacao')} end ultima_atualizacao
      from projetos"""


def oracle_sql() -> dict[str, str]:
    readme = _special(_clean("coalesce(readme, '')"))
    stage = f"""{_FIELDS}, tx as (select doc_id, site, concat_ws(chr(10), nome, descricao, rotulos, readme) x from f),
    raw as (select site, 'bruto' etapa, unnest(list_filter(string_split_regex(x, '\\s+'), lambda t: t <> '')) token from tx),
    sp as (select site, unnest({_tokens(_special(_clean('x')))}) tok from tx), pt as (select site, unnest({_bigrams(_SEP)}) p from sp),
    nm as (select site, {_fold('p')} n from pt), kn as (select site, n from nm where {_KEEP}), ks as (select site, n token from kn where {_STOP}),
    vocab as (select distinct token from ks), {duckdb_ctes('vocab')},
    al as (select etapa, site, token from raw union all select 'tokens', site, p from pt union all select 'normalizados', site, n from kn
      union all select 'sem_stopwords', site, token from ks union all select 'stems', site, s.stem from ks join stems s using (token))"""
    return {
        "clean_text": f"select id doc_id, {_clean(chr(99) + 'oalesce(readme, ' + chr(39) * 2 + ')')} limpo from projetos",
        "tokenize": f"select id doc_id, array_to_string({_tokens(readme)}, ' ') tokens from projetos",
        "split_compounds": f"select id doc_id, coalesce(array_to_string(flatten(list_transform({_tokens(readme)}, lambda t: string_split_regex(t, '[''._-]'))), ' '), '') partes from projetos",
        "camel_split": f"with t as (select id, unnest({_tokens('coalesce(nome, ' + chr(39) * 2 + ')')}) token from projetos) select id, token, array_to_string(case when len({_camel('token')}) > 1 then list_concat([array_to_string({_camel('token')}, '')], {_camel('token')}) else {_camel('token')} end, ' ') pecas from t",
        "normalize_filter_tokens": f"with tk as (select unnest({_tokens(readme)}) tok from projetos), nm as (select {_fold('p')} n from (select unnest({_bigrams(_SEP)}) p from tk)) select n token, count(*) n from nm where {_KEEP} group by 1",
        "stopword_filter": f"with tk as (select unnest({_tokens(readme)}) tok from projetos), nm as (select {_fold('p')} n from (select unnest({_bigrams(_SEP)}) p from tk)) select n token, count(*) n from nm where {_KEEP} and {_STOP} group by 1",
        "stem_vocabulary": f"with {_TERMS}, vocab as (select distinct token from kept where field = 3), {duckdb_ctes('vocab')} select token, stem from stems",
        "analysis_stage_counts": f"with {stage} select etapa, site, count(*) tokens, count(distinct token) vocabulario from al group by grouping sets ((etapa), (etapa, site))",
        "field_view": f"with {_FIELDS} select * from f",
        "snippet": "select id doc_id, nullif(linguagem, '') linguagem, estrelas, substring(coalesce(nullif(descricao, ''), nullif(resumo, '')), 1, 300) trecho from projetos",
        "units_field": _units("campo"),
        "units_document": _units("documento"),
        "units_chunk": _units((64, 64)),
        "chunk_overlap": _units((64, 48)),
        "postings_field": f"with {_POST} select term, unit_id, tf0 tf_nome, tf1 tf_descricao, tf2 tf_rotulos, tf3 tf_readme from post",
        "postings_document": f"with {_POST} select term, unit_id, tf from post",
        "postings_unstemmed": f"with {_PLAIN_OCC}, {_LEN} select o.term, l.unit_id, count(*) tf from occ o join len l using (doc_id) group by 1, 2",
        "field_mask": f"with {_POST} select term, unit_id, (case when tf0 > 0 then 1 else 0 end + case when tf1 > 0 then 2 else 0 end + case when tf2 > 0 then 4 else 0 end + case when tf3 > 0 then 8 else 0 end) mascara from post",
        "positions": f"with {_POST} select o.term, l.unit_id, o.field, string_agg(o.pos::varchar, ' ' order by o.pos) pos from occ o join len l using (doc_id) group by 1, 2, 3",
        "lexicon_df_cf": f"with {_POST} select term, df, cf from lex",
        "unit_lengths": f"with {_TERMS}, {_LEN} select unit_id, doc_id, l0 len_nome, l1 len_descricao, l2 len_rotulos, l3 len_readme from len",
        "avg_lengths": f"with {_TERMS}, {_LEN} select count(*) n, round(avg(l0::double), 6) avg_nome, round(avg(l1::double), 6) avg_descricao, round(avg(l2::double), 6) avg_rotulos, round(avg(l3::double), 6) avg_readme from len",
        "posting_gaps": f"with {_GAPS} select term, unit_id, gap from g",
        "vbyte_sizes": f"with {_GAPS} select term, sum(case when gap < 128 then 1 when gap < 16384 then 2 when gap < 2097152 then 3 when gap < 268435456 then 4 else 5 end)::bigint bytes from g group by 1",
        "index_stats": f"""with {_POST}, a as (select count(*) vocabulario, sum(df)::bigint postings, sum(cf)::bigint ocorrencias, max(df) maior_df from lex),
          b as (select count(*) unidades, count(distinct doc_id) documentos, sum(l0)::bigint termos_nome, sum(l1)::bigint termos_descricao, sum(l2)::bigint termos_rotulos, sum(l3)::bigint termos_readme,
            round(avg(l0::double), 6) media_nome, round(avg(l1::double), 6) media_descricao, round(avg(l2::double), 6) media_rotulos, round(avg(l3::double), 6) media_readme from len),
          c as (select sum((tf0 > 0)::int + (tf1 > 0)::int + (tf2 > 0)::int + (tf3 > 0)::int)::bigint n_tfs from post)
          select *, 4 * (postings + n_tfs) + postings + 4 * ocorrencias bytes_sem_compressao from a, b, c""",
        "block_vocabulary": f"with {_POST} select floor((doc_id - 1) / 100.0)::bigint bloco, count(distinct term) vocabulario from post group by 1",
        "term_lookup": f"with {_POST}, {_query_terms()} select term, unit_id, tf0 tf_nome, tf1 tf_descricao, tf2 tf_rotulos, tf3 tf_readme from post where term in (select term from q)",
        "term_detail": f"with {_POST}, {_query_terms()}, d as (select p.*, row_number() over (partition by term order by unit_id) n from post p where term in (select term from q)) select d.term, l.df, l.cf, d.n, d.doc_id, nullif(j.nome, '') nome, nullif(j.url, '') url from d join lex l using (term) join projetos j on j.id = d.doc_id where n <= 15",
        "query_analysis": f"with {_query_terms()} select qid, term, qtf, pos from q",
        "idf_table": f"with {_POST}, st as (select count(*) n from len) select l.term, l.df, round({_IDF}, 6) idf from lex l, st",
        "bm25_topk": f"with {_top(_bm25(_OCC))} select * from top",
        "bm25f_topk": f"with {_top(_bm25f())} select * from top",
        "maxp_topk": f"with {_top(_maxp())} select * from top",
        "bm25f_custom": f"with {_top(_bm25f('0.9e0', '0.4e0', ('5e0', '2e0', '2e0', '0.5e0')))} select * from top",
        "query_workload_topk": f"with {_top(_bm25(_PLAIN_OCC, False))} select * from top",
        "topk_hydrated": f"with {_top(_bm25f())} select r.qid, r.rank, r.doc_id, round(r.score, 3) score, nullif(j.site, '') site, nullif(j.nome, '') nome, nullif(j.url, '') url from ranked r join projetos j on j.id = r.doc_id where rank <= 10",
        "source_share_top10": f"with {_top(_bm25f())} select count(*) resultados, count(*) filter (site = 'github') github, round(count(*) filter (site = 'github') / count(*)::double, 6) parte_github from top join projetos j on j.id = top.doc_id",
        "zipf_ranks": f"with {_ZIPF} select term, cf, posto from z",
        "zipf_fit": f"with {_ZIPF} select round(regr_slope(log10(cf::double), log10(posto::double)), 6) inclinacao, round(regr_intercept(log10(cf::double), log10(posto::double)), 6) intercepto, count(*) pontos from z where posto between 10 and 10000",
        "rank_sample": f"with {_ZIPF}, m as (select max(posto)::double m from z), w as (select distinct round(pow(10e0, log10(m) * i / 399e0))::bigint posto from m, (select unnest(generate_series(0, 399)) i)) select posto, cf from z join w using (posto)",
        "df1_share": f"with {_POST} select count(*) termos, count(*) filter (df = 1) df1, round(count(*) filter (df = 1) / count(*)::double, 6) parte from lex",
        "top_terms_df": f"with {_POST} select term, df, cf from lex order by df desc, term limit 40",
        "heaps_curve": f"with {_OCC}, d as (select doc_id, count(*) n from occ group by 1), v as (select d0 doc_id, count(*) novos from (select term, min(doc_id) d0 from occ group by 1) group by 1) select doc_id, (sum(n) over (order by doc_id))::bigint tokens, (sum(coalesce(novos, 0)) over (order by doc_id))::bigint vocabulario from d left join v using (doc_id)",
        "heaps_fit": f"with {_OCC}, d as (select doc_id, count(*) n from occ group by 1), v as (select d0 doc_id, count(*) novos from (select term, min(doc_id) d0 from occ group by 1) group by 1), c as (select sum(n) over (order by doc_id) t, sum(coalesce(novos, 0)) over (order by doc_id) w from d left join v using (doc_id)) select round(pow(10e0, regr_intercept(log10(w::double), log10(t::double))), 6) k, round(regr_slope(log10(w::double), log10(t::double)), 6) beta from c",
        "url_normalize": f"with {_canonical('fila', 'id, url')} select id, canonica from canon",
        "url_classify": f"with {_canonical('fila', 'id, url')}, s as (select id, {_SPLIT} from canon) select id, {_SITE} site, {_KIND} tipo from s",
        "sitemap_locs": "select distinct site, url loc from fila where tipo = 'project'",
        "vbyte_roundtrip": f"with {_GAPS} select term, sum(case when gap < 128 then 1 when gap < 16384 then 2 when gap < 2097152 then 3 when gap < 268435456 then 4 else 5 end)::bigint bytes, true igual from g group by 1",
        "position_bytes": f"with {_OCC}, pg as (select field, pos - coalesce(lag(pos) over (partition by doc_id, field, term order by pos), 0) gap from occ) select field, count(*) posicoes, sum(case when gap < 128 then 1 when gap < 16384 then 2 when gap < 2097152 then 3 when gap < 268435456 then 4 else 5 end)::bigint bytes from pg group by 1",
        "crc32_bucket": f"""with {_POST}, tb as (select list(t order by i) tb from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end) t from (select unnest(generate_series(0::bigint, 255)) i))),
          by_ as (select term, df, list_transform(generate_series(1, length(hex(encode(term))) // 2), lambda k: ('0x' || substring(hex(encode(term)), 2 * k - 1, 2))::bigint) b from lex),
          cr as (select df, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(tb[xor(c, x) % 256 + 1], c // 256)), 4294967295::bigint) c from by_, tb)
          select (c % 16)::int particao, count(*) termos, sum(df)::bigint postings from cr group by 1""",
        "config_sweep": f"""select 'documento' configuracao, (select count(*) from projetos) unidades, v.* from (with {_POST} select count(*) vocabulario, sum(df)::bigint postings, sum(cf)::bigint ocorrencias from lex) v
          union all select 'campo', (select count(*) from projetos), v.* from (with {_POST} select count(*), sum(df)::bigint, sum(cf)::bigint from lex) v
          union all select 'chunk_64', v.* from (with {_OCC}, {_chunk_units(64, 64)}, seg as (select u.unit_id, o.term from un u join occ o on o.doc_id = u.doc_id where (u.unit_no = 0 and o.field < 3) or (u.unit_no > 0 and o.field = 3 and o.pos >= u.inicio and o.pos < u.inicio + 64)),
            pc as (select term, unit_id, count(*) n from seg group by 1, 2) select (select count(*) from un), count(distinct term), count(*), sum(n)::bigint from pc) v
          union all select 'documento_sem_stemming', v.* from (with {_PLAIN_OCC}, pc as (select term, doc_id, count(*) n from occ group by 1, 2) select (select count(*) from projetos), count(distinct term), count(*), sum(n)::bigint from pc) v""",
        "cjk_bigrams": f"select id doc_id, coalesce(array_to_string({_bigrams(_tokens('coalesce(readme, ' + chr(39) * 2 + ')'))}, ' '), '') tokens from projetos",
        "phrase_search": f"with {_OCC}, {_LEN} select l.unit_id, a.field, a.pos as start from occ a join occ b on a.doc_id = b.doc_id and a.field = b.field and b.pos = a.pos + 1 join len l on l.doc_id = a.doc_id where a.term = 'memori' and b.term = 'stay'",
        "topk_overlap": f"""with a as (with {_top(_bm25(_OCC))} select qid, doc_id from top), b as (with {_top(_bm25f())} select qid, doc_id from top),
          x as (select b.qid, count(a.doc_id) h, count(*) n from b left join a using (qid, doc_id) group by 1)
          select count(*) queries, round(avg(h / 10e0), 6) overlap, round(avg(h / n::double), 6) normalized from x""",
        "greedy_duplicates": """with recursive o as (select row_number() over (order by id) n, id, site, site || '/' || chave k, site || '/' || hash_conteudo h from projetos),
          r as (select 0::bigint n, []::varchar[] ks, []::varchar[] hs, null::bigint id, null::varchar site
            union all select o.n, case when ok then list_append(ks, k) else ks end, case when ok and h is not null then list_append(hs, h) else hs end, case when ok then id end, case when ok then site end
            from (select o.*, r.ks, r.hs, not list_contains(r.ks, o.k) and (o.h is null or not list_contains(r.hs, o.h)) ok from r join o on o.n = r.n + 1) o)
          select site, id from r where id is not null""",
        "link_extract": f"with fl as (select id, url, origem from fila where origem is not null and url is not null), {_canonical('fl', 'id, url, origem')} select distinct origem url, canonica link from canon",
        "url_normalize_exact": f"with {_canonical('fila', 'id, url')} select id, canonica from canon",
        "response_outcomes": f"""with v as (select distinct on (url, coletado_em) coalesce({_CODE}, '') c, status_http s, coalesce(tipo, 'listing') kind, coalesce(bytes, 1) % 7 = 0 img from visitadas order by url, coletado_em)
          select kind, case when c = 'bloqueada_robots' then 'bloqueada_robots' when s is null then 'erro_rede' when s in (301, 302, 303, 307, 308) then 'redirecionada' when s in (429, 503) then 'adiada' when s <> 200 then 'erro_http'
            when kind = 'sitemap' then 'ok' when img then 'tipo_invalido' when kind = 'project' and c = 'soft404' then 'soft404' when kind = 'project' and c = 'duplicada' then 'duplicada' when kind = 'project' then 'projeto' else 'ok' end resultado, count(*) n from v group by 1, 2""",
        "backoff_waits": r"with v as (select profundidade, nullif(regexp_extract(detalhe, '(\d+)', 1), '') pedido from visitadas where status_http >= 400), w as (select *, coalesce(least(try_cast(pedido as double), 300e0), least(5e0 * pow(2e0, coalesce(profundidade, 0)), 300e0)) espera from v) select profundidade, pedido, espera, count(*) n from w group by 1, 2, 3",
        "line_counts": "select site, count(*) linhas from projetos group by 1",
        "target_stop": "with t as (select site, id, count(*) filter (status_http = 200) over (partition by site order by id rows between unbounded preceding and 1 preceding) b from projetos) select site, count(*) paginas, max(id) ate from t where coalesce(b, 0) < 100 group by 1",
        "page_record": """with l as (select *, coalesce(try_cast(substring(coletado_em, 15, 2) as int) % 2 = 1, false) late from visitadas), u as (select distinct url from l where late and url is not null),
          p as (select site, chave, coalesce(try_cast(substring(coletado_em, 15, 2) as int) % 2 = 1, false) late from projetos)
          select (select count(*) from fila where url is null or url not in (select url from u)) fila, (select count(*) from l where not late and (url is null or url not in (select url from u))) + (select count(*) from u) visitas,
            (select count(*) from p where not late) + (select count(*) from (select site, chave from p where late except select site, chave from p where not late)) projetos""",
        "link_priority": f"""with fl as (select id, url, origem from fila where url is not null), {_canonical('fl', 'id, url, origem')},
          o as (select url origem, min(tipo) tipo, min(profundidade) profundidade from visitadas group by 1),
          s as (select canonica, origem, {_SPLIT} from canon),
          k as (select s.*, o.tipo, o.profundidade, {_KIND} k, {_SITE} site,
            regexp_extract(origem, '^https://([^/?#]*)', 1) = h and regexp_extract(origem, '^https://[^/?#]*([^?#]*)', 1) = p and
            list_sort(list_filter(string_split(regexp_extract(origem, '[?](.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'page='))) = list_sort(list_filter(string_split(qs, '&'), lambda x: x <> '' and not starts_with(x, 'page='))) same
            from s join o using (origem))
          select site, k tipo, (case when k = 'project' and tipo in ('listing', 'sitemap') then 0 else 1 end)::int prioridade,
            (case when SAME then profundidade else profundidade + 1 end)::int profundidade, count(*) n from k where k is not null group by 1, 2, 3, 4""".replace("SAME", "(coalesce(same, false) or (tipo = 'sitemap' and k = 'sitemap'))"),
        "html_project_extract": _made_fields(),
        "listing_hints": f"select id, url, {_tidy('linguagem')} linguagem from projetos where site = 'github' and {_tidy('linguagem')} is not null",
        "clean_ws": r"select id, nullif(trim(regexp_replace(descricao, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}]+', ' ', 'g')), '') texto from projetos",
        "content_hash": "with t as (select id, concat_ws(' ', nullif(descricao, ''), nullif(readme, '')) x from projetos) select id, case when length(x) >= 200 then sha1(lower(x)) end sha1 from t",
        "exact_duplicates": "select site, id, row_number() over (partition by site, chave order by id) > 1 por_chave, coalesce(hash_conteudo is not null and row_number() over (partition by site, hash_conteudo order by id) > 1, false) por_hash from projetos",
        "frontier_next": "with r as (select *, row_number() over (partition by site, tipo order by prioridade, profundidade, id, url) n from fila where tipo not in ('sitemap')) select site, tipo, id, url, prioridade, profundidade from r where n = 1",
        "frontier_dedup": f"with {_canonical('fila', 'id, url, site, tipo')}, r as (select *, row_number() over (partition by canonica order by id) n from canon) select id, site, canonica, tipo from r where n = 1 and canonica not in (select url from visitadas where url is not null)",
        "frontier_counts": "with p as (select site, count(*) projetos from projetos group by 1), v as (select site, count(*) baixadas from visitadas where status_http is not null group by 1), f as (select site, count(*) fila from fila group by 1), k as (select site, count(*) conhecidas from (select site, url from visitadas union select site, url from fila) group by 1) select site, coalesce(projetos, 0) projetos, coalesce(baixadas, 0) baixadas, coalesce(fila, 0) fila, conhecidas from k left join p using (site) left join v using (site) left join f using (site)",
        "requeue": f"with l as (select distinct url from visitadas where {_CODE} = 'soft404'), b as (select url from l where url not in (select url from fila)), q as (select url from fila union all select url from b) select count(*) fila, count(distinct url) urls, (select count(*) from visitadas where url not in (select url from l)) visitas from q",
        "seed_cross": "select (p - 1) * 5 + i ordem, 'https://gh.example/topics/' || t || case when p > 1 then '?page=' || p else '' end url from (select unnest(generate_series(1, 30)) p), (select unnest(['python', 'rust', 'search', 'games', 'editor']) t, unnest([0, 1, 2, 3, 4]) i)",
        "hint_left_join": f"with pi as (select 0 id, url, case when json_valid(dados) then coalesce(json_extract_string(dados, '$.linguagem'), json_extract_string(dados, '$.language')) end l from pistas), {_canonical('pi', 'id, url, l')}, h as (select canonica, min(l) l from canon where l is not null group by 1) select p.id, coalesce(p.linguagem, h.l) linguagem, p.linguagem is null and h.l is not null de_pista from projetos p left join h on h.canonica = p.url",
        "robots_match": r"""with u as (select id, row_number() over () rn, regexp_extract(url, '^https?://([^/?#]*)', 1) h, coalesce(nullif(regexp_replace(url, '^https?://[^/?#]*', ''), ''), '/') p from fila),
          r(h, a, x, w) as (values ('gh.example', true, '^', 0), ('gh.example', false, '^/.*/c', 4), ('gh.example', true, '^/topics/', 8), ('gh.example', false, '^/topics/.*[?]page=1', 16),
            ('sf.example', true, '^', 0), ('sf.example', false, '^/directory/', 11), ('sf.example', true, '^/directory/.*page=2', 18), ('sf.example', false, '^/projects/.*-cache', 17)),
          m as (select u.rn, u.id, max(case when regexp_matches(u.p, r.x) then r.w * 2 + r.a::int end) b from u left join r on r.h = u.h group by 1, 2) select id, coalesce(b % 2 = 1, false) allowed from m""",
        "to_int": r"""with t as (select url, json_extract_string(dados, '$.estrelas') texto from pistas where json_valid(dados)),
          r as (select url, texto, lower(regexp_replace(regexp_extract(texto, '[0-9.,]+\s*[kKmM]?', 0), '\s', '', 'g')) r from t where texto is not null),
          b as (select *, replace(regexp_replace(r, '[km]$', ''), ',', '') x from r)
          select url, texto, case when ends_with(r, 'k') then floor(try_cast(x as double) * 1000)::bigint when ends_with(r, 'm') then floor(try_cast(x as double) * 1000000)::bigint else try_cast(replace(x, '.', '') as bigint) end valor from b""",
        "stream_dedup": f"with {_canonical('fila', 'id, url, site')} select distinct canonica, site from canon",
        "stream_hourly": f"select strftime(date_trunc('hour', coletado_em::timestamptz at time zone 'UTC'), '%Y-%m-%d %H:%M') hora, site, count(status_http) paginas, count(*) filter ({_CODE} = 'projeto') projetos from visitadas group by 1, 2",
        "outcome_histogram": f"select site, {_CODE} resultado, count(*) n from visitadas group by 1, 2",
        "status_histogram": "select site, status_http, count(*) n from visitadas where status_http is not null group by 1, 2",
        "error_count": f"select count(status_http) baixadas, coalesce(sum(bytes), 0)::bigint bytes, count(*) filter ({_CODE} in ('erro_http', 'erro_rede')) erros, min(coletado_em) primeira, max(coletado_em) ultima from visitadas",
        "crawl_rate": "with v as (select count(status_http) b from visitadas), e as (select count(*) n, coalesce(sum(segundos), 0e0) s from execucoes) select n execucoes, round(s, 3) segundos, b baixadas, round(case when s > 0 then b / (s / 3600e0) end, 3) paginas_hora from e, v",
        "fill_rate": " union all ".join(f"select site, count(*) total, '{c}' campo, count(*) filter ({'len(' + c + ') > 0' if c in _LISTS else 'octet_length(encode(' + c + '::varchar)) > 0'}) preenchidos from projetos group by site" for c in _FILL),
        "hourly_timeline": f"select substring(coletado_em, 1, 13) || ':00' hora, site, count(status_http) paginas, count(*) filter ({_CODE} = 'projeto') projetos from visitadas group by 1, 2",
        "crawl_summary": f"with v as (select site, {_CODE} resultado, status_http from visitadas) select site, null resultado, null::int status_http, 3 g, count(*) n from v group by 1 union all select site, resultado, null, 1, count(*) from v group by 1, 2 union all select site, null, status_http, 2, count(*) from v group by 1, 3",
        "last_block": "with b as (select site, bloco, count(distinct posicao) paginas, max(posicao + tamanho) fim from visitadas where bloco is not null group by 1, 2) select site, bloco, paginas, fim from (select *, row_number() over (partition by site order by bloco desc) n from b) where n = 1",
        "run_bookkeeping": "select id, coalesce(fim, inicio) ate, round(coalesce(segundos, 0e0), 3) segundos from execucoes",
        "systematic_sample": "with r as (select id, site, nome, readme, row_number() over (partition by site order by id) - 1 rn, greatest(count(*) over (partition by site) // 50, 1) st from projetos) select id, site, nome, case when length(readme) > 500 then 503 else length(readme) end tamanho from r where rn % st = 0 and rn // st < 50",
        "export_jsonl": "select id, site, nome, case when site = 'github' then 13 else 14 end campos from projetos",
        "project_listing": "select id, site, url, coletado_em, status_http, nome from projetos",
        "incident_runs": f"with {_ORDERED}, s as (select site, t, url, code, sum(case when coalesce(code = 'soft404', false) then 0 else 1 end) over (partition by site order by t, url rows unbounded preceding) run from seen where code is distinct from 'bloqueada_robots'), r as (select site, run, count(*) tamanho from s where code = 'soft404' group by 1, 2) select site, tamanho, tamanho // 2 incidentes, count(*) n from r group by 1, 2, 3",
        "hold_backoff": f"with {_ORDERED}, s as (select *, coalesce(code = 'erro_http', false) a, sum(case when coalesce(code = 'erro_http', false) then 0 else 1 end) over (partition by site, tipo order by t, url rows unbounded preceding) run from seen where tipo is not null), h as (select site, tipo, row_number() over (partition by site, tipo, run order by t, url) k from s where a) select site, tipo, least(120e0 * pow(2e0, k - 1), 3600e0) espera, count(*) n from h group by 1, 2, 3",
    }
