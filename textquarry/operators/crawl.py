"""Relational side of a crawl: queue, visits, duplicates, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textquarry.functions.plan import sums_before
from textquarry.functions.urls import SITES, Sites, canonical_native, classify, is_pagination, site_of
from textquarry.session import cut

# Outcomes that count as errors, and the export's columns.
ERROR_RESULTS = ("erro_http", "erro_rede")
EXPORT_FIELDS = {
    "github": ("site", "url", "coletado_em", "status_http", "nome", "dono", "descricao", "topicos", "linguagem", "estrelas", "forks", "licenca", "readme"),
    "sourceforge": ("site", "url", "coletado_em", "status_http", "nome", "descricao", "resumo", "categorias", "licenca", "linguagem", "downloads_semana", "nota", "num_avaliacoes", "ultima_atualizacao"),
}
OUTCOMES = ("projeto", "ok", "redirecionada", "soft404", "duplicada", "erro_http", "erro_rede", "bloqueada_robots", "tipo_invalido")


# ------------------------------------------------------------------ queue


def enqueue(found: DataFrame, known: DataFrame) -> DataFrame:
    """New queue rows: of every canonical url the row found first (least id),
    unless it is known."""
    first = Window.partitionBy("canonica").orderBy("id")
    fresh = found.withColumn("canonica", canonical_native(F.col("url"))).where("canonica is not null")
    fresh = fresh.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return fresh.join(known.select(F.col("url").alias("canonica")), "canonica", "left_anti")


def next_urls(queue: DataFrame, held: tuple[str, ...] = ()) -> DataFrame:
    """The next url of every site and kind that is not held: by priority,
    depth, then arrival. A minimum of structs is combined before the shuffle."""
    open_ = queue.where(~F.col("tipo").isin(*held)) if held else queue
    least = F.min(F.struct("prioridade", "profundidade", "id", "url")).alias("x")
    return open_.groupBy("site", "tipo").agg(least).select("site", "tipo", "x.id", "x.url", "x.prioridade", "x.profundidade")


def requeue(queue: DataFrame, visits: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted urls leave the visits and return to the queue."""
    back = visits.join(wanted.select("url"), "url", "left_semi").select("site", "url", "tipo", "profundidade").dropDuplicates(["url"])
    have = queue.select("url").distinct()
    return queue.unionByName(back.join(have, "url", "left_anti"), allowMissingColumns=True), visits.join(wanted.select("url"), "url", "left_anti")


def seeds(spark: SparkSession, base: str, names: list[str], pages: int) -> DataFrame:
    """Seed urls, page by page over all topics; both lists are parameters."""
    topic = spark.createDataFrame(list(enumerate(names)), "n int, topico string")
    page = spark.range(1, pages + 1).select(F.col("id").alias("pagina"))
    url = F.concat(F.lit(base), "topico", F.when(F.col("pagina") > 1, F.concat(F.lit("?page="), F.col("pagina"))).otherwise(""))
    return page.join(F.broadcast(topic)).select((F.col("pagina") * len(names) - len(names) + F.col("n")).alias("ordem"), url.alias("url"))


def link_rows(links: DataFrame, max_depth: int | None = None, sites: Sites = SITES) -> DataFrame:
    """(url, tipo, profundidade, prioridade, destino, redirecionada) to queue
    rows: a further page or a sitemap of a sitemap keeps the depth, a redirect
    keeps depth and priority, others are one deeper; projects found on lists
    come first."""
    kind = classify(F.col("destino"), sites)
    same = is_pagination(F.col("url"), F.col("destino")) | ((F.col("tipo") == "sitemap") & (F.col("destino_tipo") == "sitemap"))
    depth = F.when(F.col("redirecionada") | same, F.col("profundidade")).otherwise(F.col("profundidade") + 1)
    first = F.when(F.col("redirecionada"), F.col("prioridade")).when((F.col("destino_tipo") == "project") & F.col("tipo").isin("listing", "sitemap"), 0).otherwise(1)
    out = links.withColumn("destino_tipo", kind).where("destino_tipo is not null").select(
        site_of(F.col("destino"), sites).alias("site"), F.col("destino").alias("url"), F.col("destino_tipo").alias("tipo"), first.cast("int").alias("prioridade"), depth.cast("int").alias("profundidade"), F.col("url").alias("origem")
    )
    return out if max_depth is None else out.where(F.col("profundidade") <= max_depth)


# ----------------------------------------------------------------- visits


def outcome(responses: DataFrame) -> DataFrame:
    """Outcome of replayed responses (allowed, status, kind, content_type,
    xml, is_project, duplicate, error, location)."""
    kind, status = F.col("kind"), F.col("status")
    result = (
        F.when(~F.col("allowed"), "bloqueada_robots")
        .when(status.isNull(), "erro_rede")
        .when(status.isin(301, 302, 303, 307, 308), "redirecionada")
        .when(status.isin(429, 503), "adiada")
        .when(status != 200, "erro_http")
        .when((kind == "sitemap") & ~F.contains("content_type", F.lit("xml")) & ~F.col("xml"), "tipo_invalido")
        .when(kind == "sitemap", "ok")
        .when(~F.contains("content_type", F.lit("html")), "tipo_invalido")
        .when((kind == "project") & ~F.col("is_project"), "soft404")
        .when((kind == "project") & F.col("duplicate"), "duplicada")
        .when(kind == "project", "projeto")
        .otherwise("ok")
    )
    return responses.withColumn("resultado", result)


def result_code(text: Column) -> Column:
    """The outcome code a free result text starts with, null for others."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), rf"^({'|'.join(OUTCOMES)})(?:[^a-z0-9_]|$)", 1), F.lit(""))


def _runs(rows: DataFrame, by: tuple[str, ...], ends: Column, band: Column) -> DataFrame:
    """Rows with ``run``, the number of rows of the same ``by`` up to here where
    ``ends`` holds, in the order of ``ordem``. ``band`` is a whole number that
    never falls in that order; rows are counted by bands and inside them."""
    keyed = rows.withColumn("_ends", F.when(ends, 1).otherwise(0)).withColumn("_band", F.coalesce(band.cast("long"), F.lit(-(1 << 62))))
    starts = sums_before(keyed.groupBy(*by, "_band").agg(F.sum("_ends").alias("n")), "_band", by, _start="n")
    inside = Window.partitionBy(*by, "_band").orderBy("ordem")
    return keyed.withColumn("_in", F.sum("_ends").over(inside)).join(starts, [*by, "_band"]).withColumn("run", F.col("_start") + F.col("_in")).drop("_ends", "_band", "_in", "_start")


def incident_runs(visits: DataFrame, threshold: int = 10, band: Column | None = None) -> DataFrame:
    """Runs of suspicious outcomes in a row, by site: (site, run, inicio, fim,
    tamanho, incidentes). Blocked rows are transparent, any other outcome ends a
    run. ``visits`` has site, ordem and resultado, and suspeita, a boolean;
    ``band`` divides a site's visits among tasks, see ``_runs``."""
    seen = visits.where((F.col("resultado") != "bloqueada_robots") | F.col("resultado").isNull())
    breaks = _runs(seen, ("site",), ~F.coalesce("suspeita", F.lit(False)), F.lit(0) if band is None else band)
    runs = breaks.where("suspeita").groupBy("site", "run").agg(F.min("ordem").alias("inicio"), F.max("ordem").alias("fim"), F.count("*").alias("tamanho"))
    return runs.withColumn("incidentes", F.floor(F.col("tamanho") / threshold))


def hold_backoff(failures: DataFrame, first: float = 120.0, most: float = 3600.0, band: Column | None = None) -> DataFrame:
    """Waiting time after every response that asked to wait: doubling within a
    run of them, by site and kind; a success starts again. ``failures`` has site,
    tipo, ordem and adiada, a boolean; ``band`` as for ``_runs``."""
    runs = _runs(failures, ("site", "tipo"), ~F.col("adiada"), F.lit(0) if band is None else band)
    inside = Window.partitionBy("site", "tipo", "run").orderBy("ordem")
    held = runs.where("adiada").withColumn("n", F.row_number().over(inside))
    return held.select("site", "tipo", "ordem", F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(F.col("n") - 1, F.lit(30))), F.lit(most)).alias("espera"))


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.coalesce(F.when(retry_after.rlike(r"^\d+$"), F.least(retry_after.try_cast("double"), F.lit(300.0))), F.least(5.0 * F.pow(F.lit(2.0), attempt), F.lit(300.0)))


# ------------------------------------------------------------- duplicates


def exact_duplicates(projects: DataFrame) -> DataFrame:
    """Rows that a crawl would drop by one criterion each: not the first of
    their (site, key), or not the first of their (site, hash)."""
    arrival = ["id"]
    key, digest = Window.partitionBy("site", "chave").orderBy(*arrival), Window.partitionBy("site", "hash_conteudo").orderBy(*arrival)
    known = projects.where("hash_conteudo is not null").select("site", "id", F.row_number().over(digest).alias("nh"))
    return (
        projects.select("site", "id", F.row_number().over(key).alias("nk"))
        .join(known, ["site", "id"], "left")
        .select("site", "id", (F.col("nk") > 1).alias("por_chave"), F.coalesce(F.col("nh") > 1, F.lit(False)).alias("por_hash"))
    )


def greedy_duplicates(projects: DataFrame) -> DataFrame:
    """Ids of the saved rows (site, id) under both criteria at once, in order
    of arrival: a row that is dropped does not drop later ones.

    Of rows with equal key and hash only the first can be saved. Then, round by
    round, a row that is the first of its key and of its hash among the open
    ones is saved, and the rows that share one with it are dropped; a round
    takes minima only, so a key or hash may have any number of rows."""
    nodes = projects.select("site", "id", F.col("chave").alias("k"), F.col("hash_conteudo").alias("h")).groupBy("site", "k", "h").agg(F.min("id").alias("id"))
    # rows without a key or hash share none
    known = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.concat(F.lit("i"), F.col("id").cast("string")))
    open_, saved = cut(nodes.select("site", "id", known("k").alias("k"), known("h").alias("h"))), []
    while not open_.isEmpty():
        first_k = open_.groupBy("site", "k").agg(F.min("id").alias("mk"))
        first_h = open_.groupBy("site", "h").agg(F.min("id").alias("mh"))
        seen = open_.join(first_k, ["site", "k"]).join(first_h, ["site", "h"])
        now = cut(seen.where("id = mk and id = mh").select("site", "id", "k", "h"))
        saved.append(now.select("site", "id"))
        left = open_.join(now.select("site", "k"), ["site", "k"], "left_anti").join(now.select("site", "h"), ["site", "h"], "left_anti")
        open_ = cut(left.select("site", "id", "k", "h"))
    return reduce(DataFrame.unionByName, saved) if saved else nodes.select("site", "id")


# ------------------------------------------------------------ page records


def record_pages(queue: DataFrame, visits: DataFrame, projects: DataFrame, batch: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queue, visits and projects after a batch of pages: a page's url
    leaves the queue, its visit replaces an older one of the url, its project
    is added unless its (site, chave) is known. Of several rows of a batch for
    one url or key the last by ``coletado_em``, or the first by id, counts.
    Applied again, a batch changes nothing."""
    newest = Window.partitionBy("url").orderBy(F.desc(F.to_timestamp("coletado_em")), F.desc("coletado_em"))
    last = batch.where("url is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    first = Window.partitionBy("site", "chave").orderBy("id")
    new = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(projects.select("site", "chave"), ["site", "chave"], "left_anti").select(projects.columns)
    urls = last.select("url")
    return queue.join(urls, "url", "left_anti").select(queue.columns), visits.join(urls, "url", "left_anti").select(visits.columns).unionByName(last.select(visits.columns)), projects.unionByName(new)


def until_target(pages: DataFrame, target: int) -> DataFrame:
    """The pages a crawl takes until each site has ``target`` projects, in
    arrival order: rows with fewer projects of their site before them. ``pages``
    has site, ordem (a whole number) and projeto, a boolean."""
    done = _runs(pages, ("site",), F.coalesce("projeto", F.lit(False)), F.floor(F.col("ordem") / 4096))
    return done.withColumn("antes", F.col("run") - F.coalesce(F.col("projeto"), F.lit(False)).cast("int")).where(F.col("antes") < target).drop("run")


# ---------------------------------------------------------------- reports


def hints(projects: DataFrame, hint_rows: DataFrame) -> DataFrame:
    """Language of a project, from the hint of its listing where it has none;
    broken hints and other keys give nothing."""
    data = F.coalesce(F.get_json_object("dados", "$.linguagem"), F.get_json_object("dados", "$.language"))
    given = hint_rows.select(canonical_native(F.col("url")).alias("url"), data.alias("pista")).where("pista is not null").groupBy("url").agg(F.min("pista").alias("pista"))
    return projects.select("id", "url", "linguagem").join(given, "url", "left").select("id", F.coalesce("linguagem", "pista").alias("linguagem"), (F.col("linguagem").isNull() & F.col("pista").isNotNull()).alias("de_pista"))


def last_blocks(visits: DataFrame) -> DataFrame:
    """Of every site the last block, its pages and its end."""
    blocks = visits.where("bloco is not null").groupBy("site", "bloco").agg(F.countDistinct("posicao").alias("paginas"), F.max(F.col("posicao") + F.col("tamanho")).alias("fim"))
    return blocks.groupBy("site").agg(F.max_by(F.struct("bloco", "paginas", "fim"), "bloco").alias("x")).select("site", "x.*")


def outcome_histogram(visits: DataFrame) -> DataFrame:
    return visits.groupBy("site", result_code(F.col("resultado")).alias("resultado")).agg(F.count("*").alias("n"))


def status_histogram(visits: DataFrame) -> DataFrame:
    return visits.where("status_http is not null").groupBy("site", "status_http").agg(F.count("*").alias("n"))


def visit_totals(visits: DataFrame) -> DataFrame:
    code = result_code(F.col("resultado"))
    return visits.agg(
        F.count("status_http").alias("baixadas"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(code.isin(*ERROR_RESULTS)).alias("erros"),
        F.min("coletado_em").alias("primeira"),
        F.max("coletado_em").alias("ultima"),
    )


def crawl_rate(visits: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs, seconds and pages an hour; no rate where no time was counted."""
    pages = visits.agg(F.count("status_http").alias("baixadas"))
    time = runs.agg(F.count("*").alias("execucoes"), F.coalesce(F.sum("segundos"), F.lit(0.0)).alias("segundos"))
    both = time.join(F.broadcast(pages))
    return both.select("execucoes", F.round("segundos", 3).alias("segundos"), "baixadas", F.round(F.when(F.col("segundos") > 0, F.col("baixadas") / (F.col("segundos") / 3600.0)), 3).alias("paginas_hora"))


def fill_rates(projects: DataFrame) -> DataFrame:
    """Filled values of every exported field by site, in one pass."""
    names = [f for f in dict.fromkeys(EXPORT_FIELDS["github"] + EXPORT_FIELDS["sourceforge"]) if f not in ("site", "url", "coletado_em", "status_http")]
    kinds = dict(projects.dtypes)
    filled = lambda f: F.count_if(F.size(f) > 0) if kinds[f].startswith("array") else F.count_if(F.octet_length(F.col(f).cast("string")) > 0)
    wide = projects.groupBy("site").agg(F.count("*").alias("total"), *[filled(f).alias(f) for f in names])
    return wide.select("site", "total", F.inline(F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("preenchidos")) for f in names])))


def hourly_timeline(visits: DataFrame) -> DataFrame:
    """Pages and projects by hour of the written time and site."""
    code = result_code(F.col("resultado"))
    return visits.groupBy(F.concat(F.substring("coletado_em", 1, 13), F.lit(":00")).alias("hora"), "site").agg(F.count("status_http").alias("paginas"), F.count_if(code == "projeto").alias("projetos"))


def crawl_summary(visits: DataFrame) -> DataFrame:
    """Counts by site, by outcome and by status in one pass over the visits."""
    base = visits.select("site", result_code(F.col("resultado")).alias("resultado"), "status_http")
    sets = base.groupingSets([["site"], ["site", "resultado"], ["site", "status_http"]], "site", "resultado", "status_http")
    return sets.agg(F.grouping_id().cast("int").alias("g"), F.count("*").alias("n"))


def site_counts(projects: DataFrame, visits: DataFrame, queue: DataFrame) -> DataFrame:
    """Projects, downloads, queued and known urls of every site."""
    parts = projects.select("site", F.lit("projetos").alias("o"), F.lit(None).cast("string").alias("u")).unionByName(visits.where("status_http is not null").select("site", F.lit("baixadas").alias("o"), F.lit(None).cast("string").alias("u")))
    parts = parts.unionByName(queue.select("site", F.lit("fila").alias("o"), F.lit(None).cast("string").alias("u")))
    counts = parts.groupBy("site").agg(*[F.count_if(F.col("o") == o).alias(o) for o in ("projetos", "baixadas", "fila")])
    known = visits.select("site", "url").unionByName(queue.select("site", "url")).distinct().groupBy("site").agg(F.count("*").alias("conhecidas"))
    return counts.join(known, "site", "left")


def systematic_sample(projects: DataFrame, size: int = 50, readme_chars: int = 500) -> DataFrame:
    """Every (n // size)-th project of a site by id, ``size`` at most, narrow
    columns first; wide columns are joined for the chosen ids only."""
    ids = projects.select("site", "id")
    counts = ids.groupBy("site").agg(F.greatest(F.floor(F.count("*") / size), F.lit(1)).alias("passo"))
    ranges = ids.withColumn("faixa", F.floor(F.col("id") / 4096))
    sizes = ranges.groupBy("site", "faixa").agg(F.count("*").alias("n"))
    before = Window.partitionBy("site").orderBy("faixa").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("site", "faixa", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inicio"))
    local = Window.partitionBy("site", "faixa").orderBy("id")
    numbered = ranges.withColumn("r", F.row_number().over(local) - 1).join(starts, ["site", "faixa"]).select("site", "id", (F.col("inicio") + F.col("r")).alias("rn"))
    chosen = numbered.join(F.broadcast(counts), "site").where((F.col("rn") % F.col("passo") == 0) & (F.col("rn") / F.col("passo") < size)).select("id")
    cut = F.when(F.length("readme") > readme_chars, F.concat(F.substring("readme", 1, readme_chars), F.lit("..."))).otherwise(F.col("readme"))
    return projects.join(chosen, "id", "left_semi").withColumn("readme", cut)
