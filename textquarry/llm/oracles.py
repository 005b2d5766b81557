"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_PAIRS = r"""
with t as (
  select campo, id, regexp_extract_all(lower(txt), '[\p{L}\p{N}]+') w
  from (select 'readme' campo, id, readme txt from projetos union all select 'descricao', id, descricao from projetos)
  where txt is not null
), k as (select campo, id, w from t where len(w) >= 25),
s as (
  select distinct campo, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
  from (select campo, id, w, unnest(generate_series(1, len(w) - 2)) i from k)
), n as (select campo, id, count(*) n from s group by 1, 2),
c as (
  select a.campo, a.id id_a, b.id id_b, count(*) c
  from s a join s b on a.campo = b.campo and a.g = b.g and a.id < b.id group by 1, 2, 3
)
select c.campo, c.id_a, c.id_b from c
join n x on x.campo = c.campo and x.id = c.id_a join n y on y.campo = c.campo and y.id = c.id_b
where c.c >= 0.6e0 * (x.n + y.n - c.c)
"""

_TERMS = r"""
f as (
  select 'readme' campo, id, unnest(regexp_extract_all(lower(readme), '\p{L}{3,}')) termo from projetos
  union all select 'topicos', id, unnest(list_transform(topicos, lambda v: lower(trim(v)))) from projetos
  union all select 'categorias', id, unnest(list_transform(categorias, lambda v: lower(trim(v)))) from projetos
), o as (select campo, id, termo, count(*) tf from f where termo is not null and termo <> '' group by 1, 2, 3),
d as (select campo, termo, sum(tf)::bigint ocorrencias, count(*) registros from o group by 1, 2),
n as (select campo, count(distinct id) linhas from o group by 1),
m as (
  select d.campo, d.termo, d.ocorrencias, d.registros,
    case when d.registros = 1 then 'rara'
      when d.registros >= (case when d.campo = 'readme' then 0.58e0 else 0.3e0 end) * n.linhas - 1e-9 then 'comum' end marca
  from d join n using (campo)
)
"""


_SCORES = f"""
with recursive {_TERMS},
b as (
  select o.campo, o.id, o.termo, o.tf, d.registros df, d.ocorrencias::double / t.total bg
  from o join d using (campo, termo) join (select campo, sum(ocorrencias)::double total from d group by 1) t using (campo) where o.campo <> 'categorias'
), em as (
  select campo, id, termo, tf, df, bg, tf::double / sum(tf) over (partition by campo, id) p, 0 r from b
  union all
  select campo, id, termo, tf, df, bg, e / sum(e) over (partition by campo, id), r + 1
  from (select *, tf * (0.1e0 * p) / (0.1e0 * p + 0.9e0 * bg) e from em where r < 60)
)
select id, campo, termo, tf, df, round(p, 6) score from em where r = 60
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS,
        "p4_found": f"with {_TERMS} select o.id, o.campo, o.termo from o join d using (campo, termo) where o.campo <> 'categorias' and d.registros between 2 and 8 and (o.campo = 'topicos' or o.tf >= 4)",
        "p5_found": f"with {_TERMS} select campo, termo, marca from m where marca is not null",
        "p6_bounds": "select recipiente, (select count(distinct doc_id) from documents where length(text) > 0) textos, 0::bigint acima, 0::bigint diferentes, 0::bigint partidos from (select distinct recipiente from recipientes where capacidade_tokens > 0)",
        "p7_bounds": "select distinct mistura, source, 0::bigint dobrados, 0::bigint acima, 0::bigint vazios from metas_mistura",
        "p4_scores": _SCORES,
        "p5_frequencies": f"with {_TERMS} select campo, termo, ocorrencias, registros, marca from m",
    }
