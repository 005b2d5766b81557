"""Registry of the queries, one or more an operator, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, functions as F

from textquarry.functions import cleaning, html as pages_html, lexical, robots, urls, vbyte
from textquarry.functions.lexical import FIELDS, Analyzer
from textquarry.functions.stemmer import stem_vocabulary
from textquarry.operators import analytics, crawl, index as ix, ranking
from textquarry.operators.fields import IndexConfig, field_view, metadata, unit_numbers, units
from textquarry.session import spread
from textquarry.sources.jsonl import export_json
from textquarry.sources.tables import table

#: Entities and compatibility forms have no SQL counterpart; queries with an
#: oracle leave them as they are, ``clean_text_full`` and ``search_full`` do not.
PLAIN = Analyzer(decoded=False)
UNSTEMMED = Analyzer(decoded=False, stemming=False)


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def _fields(spark, sf_dir):
    return spread(field_view(_t(spark, sf_dir, "projetos")))


def _index(spark, sf_dir, granularity="campo", **options):
    """The written index of the projects; queries of one configuration share it."""
    analyzer = options.pop("analyzer", PLAIN)
    # chunks and unstemmed terms are only searched
    positions = options.pop("positions", True) or (analyzer == PLAIN and granularity != "chunk")
    return ix.kept_index(_t(spark, sf_dir, "projetos"), IndexConfig(granularity=granularity, analyzer=analyzer, positions=positions, **options))


def _joined(tokens):
    return F.array_join(tokens, " ")


# ------------------------------------------------------------------- text


def clean_text(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", cleaning.strip_noise(F.col("readme")).alias("limpo"))


def clean_text_full(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", cleaning.clean_text(F.col("readme")).alias("limpo"))


def tokenize(spark, sf_dir):
    text = lexical.special_terms(cleaning.clean_text(F.col("readme"), decoded=False))
    return _fields(spark, sf_dir).select("doc_id", _joined(lexical.scan_tokens(text)).alias("tokens"))


def split_compounds(spark, sf_dir):
    text = lexical.special_terms(cleaning.clean_text(F.col("readme"), decoded=False))
    return _fields(spark, sf_dir).select("doc_id", _joined(lexical.split_compounds(lexical.scan_tokens(text))).alias("partes"))


def camel_split(spark, sf_dir):
    tokens = F.explode(lexical.scan_tokens(F.coalesce("nome", F.lit(""))))
    return _t(spark, sf_dir, "projetos").select("id", tokens.alias("token")).select("id", "token", _joined(lexical.camel_pieces(F.col("token"))).alias("pecas"))


def cjk_bigrams(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", _joined(lexical.ideograph_bigrams(lexical.scan_tokens(F.col("readme")))).alias("tokens"))


def _token_counts(arrays):
    return arrays.select(F.explode_outer("t").alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))


def normalize_filter_tokens(spark, sf_dir):
    return _token_counts(_fields(spark, sf_dir).select(PLAIN.normalized(F.col("readme")).alias("t")))


def stopword_filter(spark, sf_dir):
    return _token_counts(_fields(spark, sf_dir).select(PLAIN.terms(F.col("readme")).alias("t")))


def stem_words(spark, sf_dir):
    words = _fields(spark, sf_dir).select(F.explode(PLAIN.terms(F.col("readme"))).alias("token"))
    return stem_vocabulary(words)


def analysis_stage_counts(spark, sf_dir):
    return analytics.stage_counts(analytics.stages(_fields(spark, sf_dir), PLAIN))


# ------------------------------------------------------------------ index


def fields(spark, sf_dir):
    return field_view(_t(spark, sf_dir, "projetos"))


def snippet(spark, sf_dir):
    return metadata(_t(spark, sf_dir, "projetos")).select("doc_id", "linguagem", "estrelas", "trecho")


def _unit_rows(spark, sf_dir, **config):
    config = IndexConfig(analyzer=PLAIN, **config)
    rows = units(ix.kept_analysis(_t(spark, sf_dir, "projetos"), PLAIN), config)
    size = F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(s["terms"]))
    first = F.array_min(F.transform("segments", lambda s: s["base"]))
    last = F.array_max(F.transform("segments", lambda s: s["base"] + F.size(s["terms"])))
    return rows.join(unit_numbers(rows), ["doc_id", "unit_no"]).select("doc_id", "unit_no", "unit_id", "kind", size.alias("termos"), first.alias("inicio"), last.alias("fim"))


def units_field(spark, sf_dir):
    return _unit_rows(spark, sf_dir, granularity="campo")


def units_document(spark, sf_dir):
    return _unit_rows(spark, sf_dir, granularity="documento")


def units_chunk(spark, sf_dir):
    return _unit_rows(spark, sf_dir, granularity="chunk", chunk=64)


def chunk_overlap(spark, sf_dir):
    return _unit_rows(spark, sf_dir, granularity="chunk", chunk=64, overlap=16)


def postings_field(spark, sf_dir):
    p = _index(spark, sf_dir).postings
    return p.select("term", "unit_id", *[F.col("tf")[i].alias(f"tf_{f}") for i, f in enumerate(FIELDS)])


def postings_document(spark, sf_dir):
    return _index(spark, sf_dir, "documento").postings.select("term", "unit_id", F.col("tf")[0].alias("tf"))


def postings_unstemmed(spark, sf_dir):
    return _index(spark, sf_dir, "documento", analyzer=UNSTEMMED).postings.select("term", "unit_id", F.col("tf")[0].alias("tf"))


def field_mask(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("term", "unit_id", ix.field_mask(F.col("tf")).alias("mascara"))


def positions(spark, sf_dir):
    return _index(spark, sf_dir).positions.select("term", "unit_id", "field", F.array_join(F.transform("pos", lambda p: p.cast("string")), " ").alias("pos"))


def lexicon_df_cf(spark, sf_dir):
    return _index(spark, sf_dir).lexicon.select("term", "df", "cf")


def unit_lengths(spark, sf_dir):
    return _index(spark, sf_dir).units.select("unit_id", "doc_id", *[F.col("len")[i].alias(f"len_{f}") for i, f in enumerate(FIELDS)])


def avg_lengths(spark, sf_dir):
    a = ranking.average_lengths(_index(spark, sf_dir))
    return a.select("n", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in FIELDS])


def posting_gaps(spark, sf_dir):
    return ix.gaps(_index(spark, sf_dir).postings)


def vbyte_sizes(spark, sf_dir):
    g = ix.gaps(_index(spark, sf_dir).postings)
    return g.groupBy("term").agg(F.sum(ix.vbyte_size(F.col("gap"))).alias("bytes"))


def vbyte_roundtrip(spark, sf_dir, block=4096):
    """Blocks of every term's gaps encoded and decoded again."""
    g = ix.gaps(_index(spark, sf_dir).postings).groupBy("term", F.floor(F.col("unit_id") / block).alias("b"))
    gaps = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "gap"))), lambda s: s["gap"]).alias("gaps"))
    coded = gaps.withColumn("codigo", vbyte.vbyte_encode(F.col("gaps")))
    blocks = coded.select("term", F.octet_length("codigo").alias("bytes"), (vbyte.vbyte_decode(F.col("codigo")) == F.col("gaps")).alias("igual"))
    return blocks.groupBy("term").agg(F.sum("bytes").alias("bytes"), F.min("igual").alias("igual"))


def position_bytes(spark, sf_dir):
    """Bytes of the position gaps of every field in the variable-byte code."""
    g = ix.position_gaps(_index(spark, sf_dir).positions)
    size = F.aggregate(F.transform("gaps", ix.vbyte_size), F.lit(0), lambda acc, n: acc + n)
    return g.groupBy("field").agg(F.sum(F.size("gaps")).alias("posicoes"), F.sum(size).alias("bytes"))


def config_sweep(spark, sf_dir):
    """Units, vocabulary, postings and occurrences of several configurations."""
    named = {"documento": _index(spark, sf_dir, "documento"), "campo": _index(spark, sf_dir), "chunk_64": _index(spark, sf_dir, "chunk", positions=False, chunk=64), "documento_sem_stemming": _index(spark, sf_dir, "documento", analyzer=UNSTEMMED, positions=False)}
    rows = [ix.collection_statistics(i).select(F.lit(n).alias("configuracao"), "unidades", "vocabulario", "postings", "ocorrencias") for n, i in named.items()]
    return reduce(lambda x, y: x.unionByName(y), rows)


def crc32_bucket(spark, sf_dir):
    return _index(spark, sf_dir).lexicon.groupBy(ix.bucket_of(F.col("term"), 16).alias("particao")).agg(F.count("*").alias("termos"), F.sum("df").alias("postings"))


def index_stats(spark, sf_dir):
    return ix.collection_statistics(_index(spark, sf_dir))


def block_vocabulary(spark, sf_dir):
    i = _index(spark, sf_dir)
    return ix.block_vocabulary(i.units, i.postings, 100)


# ---------------------------------------------------------- access, ranking


def _workload(spark, sf_dir):
    return _t(spark, sf_dir, "consultas").select("qid", "text")


def term_lookup(spark, sf_dir):
    """Postings of the terms of the workload, in order of units."""
    i = _index(spark, sf_dir)
    words = ranking.query_terms(_workload(spark, sf_dir), PLAIN).select("term").distinct()
    return i.postings.join(words, "term", "left_semi").select("term", "unit_id", *[F.col("tf")[k].alias(f"tf_{f}") for k, f in enumerate(FIELDS)])


def term_detail(spark, sf_dir):
    """df, cf and the first 15 postings with their names, of the workload's terms."""
    i = _index(spark, sf_dir)
    words = ranking.query_terms(_workload(spark, sf_dir), PLAIN).select("term").distinct()
    first = Window.partitionBy("term").orderBy("unit_id")
    hit = i.postings.join(words, "term", "left_semi").withColumn("n", F.row_number().over(first)).where("n <= 15")
    named = hit.join(i.units.select("unit_id", "doc_id"), "unit_id").join(i.documents.select("doc_id", "nome", "url"), "doc_id")
    return named.join(i.lexicon, "term").select("term", "df", "cf", "n", "doc_id", "nome", "url")


def query_analysis(spark, sf_dir):
    return ranking.query_terms(_workload(spark, sf_dir), PLAIN)


def idf_table(spark, sf_dir):
    return ranking.idf_table(_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def _search(spark, sf_dir, granularity, k=10, analyzer=PLAIN, chunk=64, **options):
    i = _index(spark, sf_dir, granularity, analyzer=analyzer, positions=False, **({"chunk": chunk} if granularity == "chunk" else {}))
    return i, ranking.search(i, _workload(spark, sf_dir), k, **options)


def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir, "documento")[1]


def bm25f_topk(spark, sf_dir):
    return _search(spark, sf_dir, "campo")[1]


def maxp_topk(spark, sf_dir):
    return _search(spark, sf_dir, "chunk")[1]


def bm25f_custom(spark, sf_dir):
    return _search(spark, sf_dir, "campo", k1=0.9, b=0.4, weights={"nome": 5.0, "readme": 0.5})[1]


def query_workload_topk(spark, sf_dir):
    """The flagship: unstemmed BM25 over documents, all queries in one plan."""
    return _search(spark, sf_dir, "documento", analyzer=UNSTEMMED)[1]


def search_full(spark, sf_dir):
    return _search(spark, sf_dir, "campo", analyzer=Analyzer())[1]


def topk_hydrated(spark, sf_dir):
    i, top = _search(spark, sf_dir, "campo")
    return ranking.hydrate(top, i.documents).select("qid", "rank", "doc_id", F.round("score", 3).alias("score"), "site", "nome", "url")


def topk_overlap(spark, sf_dir):
    return ranking.overlap(_search(spark, sf_dir, "documento")[1], _search(spark, sf_dir, "campo")[1])


def source_share_top10(spark, sf_dir):
    i, top = _search(spark, sf_dir, "campo")
    sites = top.join(i.documents.select("doc_id", "site"), "doc_id")
    return sites.agg(F.count("*").alias("resultados"), F.count_if(F.col("site") == "github").alias("github"), F.round(F.count_if(F.col("site") == "github") / F.count("*"), 6).alias("parte_github"))


def phrase_search(spark, sf_dir):
    return ranking.phrase_units(_index(spark, sf_dir), ["memori", "stay"])


# -------------------------------------------------------------- analytics


def zipf_ranks(spark, sf_dir):
    return analytics.zipf_ranks(_index(spark, sf_dir, positions=False).lexicon)


def zipf_fit(spark, sf_dir):
    return analytics.zipf_fit(analytics.zipf_ranks(_index(spark, sf_dir, positions=False).lexicon))


def rank_sample(spark, sf_dir):
    return analytics.rank_sample(analytics.zipf_ranks(_index(spark, sf_dir, positions=False).lexicon))


def df1_share(spark, sf_dir):
    return analytics.df1_share(_index(spark, sf_dir, positions=False).lexicon)


def top_terms_df(spark, sf_dir):
    return analytics.top_terms(_index(spark, sf_dir, positions=False).lexicon)


def _document_terms(spark, sf_dir):
    """A row an occurrence would join the stems once each; a row a distinct
    token of a document, with its count, is joined instead."""
    rows = units(ix.kept_analysis(_t(spark, sf_dir, "projetos"), PLAIN), IndexConfig(granularity="documento", analyzer=PLAIN))
    counted = ix.occurrences(rows).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return ix.with_stems(counted).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


def heaps_curve(spark, sf_dir):
    return analytics.heaps_curve(_document_terms(spark, sf_dir))


def heaps_fit(spark, sf_dir):
    return analytics.heaps_fit(analytics.heaps_curve(_document_terms(spark, sf_dir)))


# ------------------------------------------------------------------ crawl


def url_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "fila").select("id", urls.canonical_native(F.col("url")).alias("canonica"))


def url_normalize_exact(spark, sf_dir):
    return _t(spark, sf_dir, "fila").select("id", urls.canonical(F.col("url")).alias("canonica"))


def url_classify(spark, sf_dir):
    c = urls.canonical_native(F.col("url"))
    return _t(spark, sf_dir, "fila").select("id", c.alias("u")).select("id", urls.site_of(F.col("u")).alias("site"), urls.classify(F.col("u")).alias("tipo"))


LINKS_A_PAGE, LOCS_A_MAP = 500, 1000


def _parts(rows, by, size):
    """Rows with ``parte``: those of one ``by`` in parts of about ``size``."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("long").alias("_m"))
    return rows.join(sizes, by).withColumn("parte", F.pmod(F.xxhash64("url"), F.col("_m")))


def _pages(spark, sf_dir):
    """Listing pages put together from the queue: of every origin the links
    that were found on it, some hundreds a page."""
    q = _parts(_t(spark, sf_dir, "fila").where("origem is not null and url is not null").select("origem", "url").distinct(), "origem", LINKS_A_PAGE)
    links = F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit('<a href="'), u, F.lit('#top">x</a>'))), "")
    return q.groupBy(F.col("origem").alias("url"), "parte").agg(F.concat(F.lit("<html><body>"), links, F.lit("</body></html>")).alias("html"))


def link_extract(spark, sf_dir):
    """Distinct links of every origin, read from its pages."""
    found = F.explode(pages_html.extract_links(F.col("html"), F.col("url")))
    return _pages(spark, sf_dir).select("url", found.alias("link")).distinct()


def sitemap_locs(spark, sf_dir):
    q = _parts(_t(spark, sf_dir, "fila").where("tipo = 'project'").select("site", "url").distinct(), "site", LOCS_A_MAP)
    maps = q.groupBy("site", "parte").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>")))).alias("xml"))
    return maps.select("site", F.explode(pages_html.sitemap_locs(F.col("xml"))).alias("loc"))


def to_int(spark, sf_dir):
    raw = F.get_json_object("dados", "$.estrelas")
    return _t(spark, sf_dir, "pistas").select("url", raw.alias("texto"), cleaning.to_int(raw).alias("valor")).where("texto is not null")


def clean_ws(spark, sf_dir):
    return _t(spark, sf_dir, "projetos").select("id", cleaning.squeeze(F.col("descricao")).alias("texto"))


def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "projetos").select("id", cleaning.content_hash(F.col("descricao"), F.col("readme")).alias("sha1"))


def exact_duplicates(spark, sf_dir):
    return crawl.exact_duplicates(_t(spark, sf_dir, "projetos"))


def greedy_duplicates(spark, sf_dir):
    return crawl.greedy_duplicates(_t(spark, sf_dir, "projetos"))


def frontier_next(spark, sf_dir):
    return crawl.next_urls(_t(spark, sf_dir, "fila"), held=("sitemap",))


def frontier_dedup(spark, sf_dir):
    return crawl.enqueue(_t(spark, sf_dir, "fila"), _t(spark, sf_dir, "visitadas")).select("id", "site", "canonica", "tipo")


def frontier_counts(spark, sf_dir):
    return crawl.site_counts(_t(spark, sf_dir, "projetos"), _t(spark, sf_dir, "visitadas"), _t(spark, sf_dir, "fila"))


def requeue(spark, sf_dir):
    visits = _t(spark, sf_dir, "visitadas")
    lost = visits.where(crawl.result_code(F.col("resultado")) == "soft404").select("url").distinct()
    queue, rest = crawl.requeue(_t(spark, sf_dir, "fila").select("site", "url", "tipo", "profundidade"), visits, lost)
    return queue.agg(F.count("*").alias("fila"), F.countDistinct("url").alias("urls")).join(F.broadcast(rest.agg(F.count("*").alias("visitas"))))


def seed_cross(spark, sf_dir):
    return crawl.seeds(spark, "https://gh.example/topics/", ["python", "rust", "search", "games", "editor"], 30)


def hint_left_join(spark, sf_dir):
    return crawl.hints(_t(spark, sf_dir, "projetos"), _t(spark, sf_dir, "pistas"))


ROBOTS = {
    "gh.example": "User-agent: *\nDisallow: /*/c\nAllow: /topics/\nDisallow: /topics/*?page=1\nCrawl-delay: 1\n",
    "sf.example": "User-agent: *\nDisallow: /directory/\nAllow: /directory/*page=2\nDisallow: /projects/*-cache\nSitemap: https://sf.example/sitemap.xml\n",
}


def robots_match(spark, sf_dir):
    rows = [r for host, text in ROBOTS.items() for r in robots.rule_rows(host, 200, text)]
    rules = spark.createDataFrame(rows, robots.RULE_SCHEMA)
    return robots.allowed(_t(spark, sf_dir, "fila").select("id", "url"), rules).select("id", "allowed")


def link_priority(spark, sf_dir):
    """Queue rows that the links of every origin give, at its kind and depth."""
    origin = _t(spark, sf_dir, "visitadas").groupBy("url").agg(F.min("tipo").alias("tipo"), F.min("profundidade").alias("profundidade"))
    links = _t(spark, sf_dir, "fila").select("id", F.col("origem").alias("url"), urls.canonical_native(F.col("url")).alias("destino")).where("url is not null")
    rows = links.join(origin, "url").withColumn("prioridade", F.lit(1)).withColumn("redirecionada", F.lit(False))
    return crawl.link_rows(rows).groupBy("site", "tipo", "prioridade", "profundidade").agg(F.count("*").alias("n"))


def outcome_histogram(spark, sf_dir):
    return crawl.outcome_histogram(_t(spark, sf_dir, "visitadas"))


def status_histogram(spark, sf_dir):
    return crawl.status_histogram(_t(spark, sf_dir, "visitadas"))


def error_count(spark, sf_dir):
    return crawl.visit_totals(_t(spark, sf_dir, "visitadas"))


def crawl_rate(spark, sf_dir):
    return crawl.crawl_rate(_t(spark, sf_dir, "visitadas"), _t(spark, sf_dir, "execucoes"))


def fill_rate(spark, sf_dir):
    return crawl.fill_rates(_t(spark, sf_dir, "projetos"))


def hourly_timeline(spark, sf_dir):
    return crawl.hourly_timeline(_t(spark, sf_dir, "visitadas"))


def crawl_summary(spark, sf_dir):
    return crawl.crawl_summary(_t(spark, sf_dir, "visitadas"))


def last_block(spark, sf_dir):
    return crawl.last_blocks(_t(spark, sf_dir, "visitadas"))


def run_bookkeeping(spark, sf_dir):
    e = _t(spark, sf_dir, "execucoes")
    return e.select("id", F.coalesce("fim", "inicio").alias("ate"), F.round(F.coalesce("segundos", F.lit(0.0)), 3).alias("segundos"))


def systematic_sample(spark, sf_dir):
    s = crawl.systematic_sample(_t(spark, sf_dir, "projetos"))
    return s.select("id", "site", "nome", F.length("readme").alias("tamanho"))


def export_jsonl(spark, sf_dir):
    p = _t(spark, sf_dir, "projetos")
    return p.select("id", "site", export_json(p).alias("linha")).select("id", "site", F.get_json_object("linha", "$.nome").alias("nome"), F.size(F.json_object_keys("linha")).alias("campos"))


def project_listing(spark, sf_dir):
    return _t(spark, sf_dir, "projetos").select("id", "site", "url", "coletado_em", "status_http", "nome").orderBy("id")


def _in_order(visits):
    """Visits numbered by site in order of time, one row a delivery."""
    seen = visits.dropDuplicates(["url", "coletado_em"])
    at = F.to_timestamp("coletado_em")
    code = crawl.result_code(F.col("resultado"))
    return seen.select("site", "tipo", "url", code.alias("resultado"), at.alias("t"), F.struct(at, "url").alias("ordem"), (F.coalesce(code == "soft404", F.lit(False))).alias("suspeita"))


def incident_runs(spark, sf_dir):
    runs = crawl.incident_runs(_in_order(_t(spark, sf_dir, "visitadas")), threshold=2, band=F.floor(F.unix_timestamp("t") / 3600))
    return runs.groupBy("site", "tamanho", "incidentes").agg(F.count("*").alias("n"))


def hold_backoff(spark, sf_dir):
    held = _in_order(_t(spark, sf_dir, "visitadas")).where("tipo is not null").withColumn("adiada", F.coalesce(F.col("resultado") == "erro_http", F.lit(False)))
    return crawl.hold_backoff(held, band=F.floor(F.unix_timestamp("t") / 3600)).groupBy("site", "tipo", "espera").agg(F.count("*").alias("n"))


def _responses(spark, sf_dir):
    """Answers put together from the visits' columns."""
    v = _t(spark, sf_dir, "visitadas").dropDuplicates(["url", "coletado_em"])
    code = F.coalesce(crawl.result_code(F.col("resultado")), F.lit(""))
    content = F.when(F.col("tipo") == "sitemap", "application/xml").when(F.coalesce("bytes", F.lit(1)) % 7 == 0, "image/png").otherwise("text/html; charset=utf-8")
    return v.select("url", "coletado_em", (code != "bloqueada_robots").alias("allowed"), F.col("status_http").alias("status"), F.coalesce("tipo", F.lit("listing")).alias("kind"), content.alias("content_type"), F.lit(False).alias("xml"), (code != "soft404").alias("is_project"), (code == "duplicada").alias("duplicate"))


def response_outcomes(spark, sf_dir):
    return crawl.outcome(_responses(spark, sf_dir)).groupBy("kind", "resultado").agg(F.count("*").alias("n"))


def backoff_waits(spark, sf_dir):
    """Waits of failed visits: attempts by depth, Retry-After from the detail."""
    v = _t(spark, sf_dir, "visitadas").where("status_http >= 400")
    asked = F.nullif(F.regexp_extract("detalhe", r"(\d+)", 1), F.lit(""))
    wait = crawl.backoff(F.coalesce("profundidade", F.lit(0)), asked)
    return v.select("profundidade", asked.alias("pedido"), wait.alias("espera")).groupBy("profundidade", "pedido", "espera").agg(F.count("*").alias("n"))


def line_counts(spark, sf_dir):
    """Lines of every site's export."""
    p = _t(spark, sf_dir, "projetos")
    return p.select("site", export_json(p).alias("linha")).where(F.length("linha") > 0).groupBy("site").agg(F.count("*").alias("linhas"))


def page_record(spark, sf_dir):
    """Rows of the state after the pages of odd minutes are recorded."""
    visits, projects = _t(spark, sf_dir, "visitadas"), _t(spark, sf_dir, "projetos")
    late = F.coalesce(F.substring("coletado_em", 15, 2).try_cast("int") % 2 == 1, F.lit(False))
    state = crawl.record_pages(_t(spark, sf_dir, "fila"), visits.where(~late), projects.where(~late), visits.where(late), projects.where(late))
    counts = [df.agg(F.count("*").alias(n)) for df, n in zip(state, ("fila", "visitas", "projetos"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


def target_stop(spark, sf_dir):
    """Rows of the queue order that a crawl with a target of 100 projects takes."""
    p = _t(spark, sf_dir, "projetos").select("site", F.col("id").alias("ordem"), (F.col("status_http") == 200).alias("projeto"))
    return crawl.until_target(p, 100).groupBy("site").agg(F.count("*").alias("paginas"), F.max("ordem").alias("ate"))


def _made_pages(spark, sf_dir):
    """Pages of both sites made of the projects' own values."""
    p = _t(spark, sf_dir, "projetos")
    esc = lambda c: F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def put(c, before, after=""):
        return F.coalesce(F.concat(F.lit(before), esc(c if isinstance(c, Column) else F.col(c)), F.lit(after)), F.lit(""))

    def each(c, before, after):
        return F.concat_ws("", F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: put(t, before, after)))

    code = F.concat(
        put("chave", '<meta name="octolytics-dimension-repository_nwo" content="', '"><div><h2>About</h2>'), put("descricao", "<p>", "</p>"), each("topicos", '<a href="/topics/x">', "</a>"),
        put("licenca", '<a href="#LICENSE-1-ov-file">', "</a>"), F.lit("</div>"), put("linguagem", '<span itemprop="programmingLanguage">', "</span>"),
        put("estrelas", '<a id="repo-stars-counter-star" title="', '"></a>'), put("forks", '<a id="repo-network-counter" title="', '"></a>'), put("readme", '<article class="markdown-body">', "</article>"),
    )
    forge = F.concat(
        put("url", '<meta property="og:url" content="', '">'), put("nome", '<h1 itemprop="name">', "</h1>"), put("resumo", '<h2 class="summary">', "</h2>"), put("descricao", '<p itemprop="description">', "</p>"),
        each("categorias", '<span itemprop="applicationCategory">', "</span>"), put("licenca", '<section class="project-info"><h3>License</h3>', "</section>"),
        put("linguagem", '<section class="project-info"><h4>Programming Language</h4><a>', "</a></section>"), put("downloads_semana", '<div class="as-h2"><span class="label">Downloads:</span> ', " This Week</div>"),
        put("ultima_atualizacao", '<div class="as-h2"><span class="label">Last Update:</span><time datetime="', '">x</time></div>'),
        F.lit('<div itemprop="aggregateRating">'), put("nota", '<meta itemprop="ratingValue" content="', '">'), put("num_avaliacoes", '<span itemprop="ratingCount">', "</span>"), F.lit("</div>"),
    )
    return spread(p.select("url", "site", F.when(F.col("site") == "github", code).otherwise(forge).alias("html")))


def html_project_extract(spark, sf_dir):
    """Every field of both sites read back from pages made of the values."""
    found = pages_html.extract_projects(_made_pages(spark, sf_dir))
    lists = {c: F.array_join(c, "|").alias(c) for c in ("topicos", "categorias")}
    return found.select("pagina", *[lists.get(c, F.col(c)) for c in found.columns if c not in ("pagina", "url")])


def listing_hints(spark, sf_dir):
    """Languages read from listing cards, one a project page."""
    card = F.concat(F.lit('<article><h3><a href="/">x</a> <a href="'), "url", F.lit('">y</a></h3><span itemprop="programmingLanguage"> '), "linguagem", F.lit("</span></article>"))
    pages = _t(spark, sf_dir, "projetos").where("site = 'github' and linguagem is not null").select("id", "url", card.alias("html"))
    return spread(pages).select("id", F.inline(pages_html.extract_cards(F.col("html"), F.col("url")))).select("id", "url", "linguagem")


# -------------------------------------------------------------- streaming


def _stream(spark, sf_dir, name):
    from textquarry.streaming.crawl import stream_of

    return stream_of(spark, f"{sf_dir}/{name}.parquet")


def stream_dedup(spark, sf_dir):
    from textquarry.streaming.crawl import run_new_urls

    return run_new_urls(_stream(spark, sf_dir, "fila"), "dedup").select("canonica", "site")


def stream_incident(spark, sf_dir):
    from textquarry.streaming.crawl import incidents, run_available

    return run_available(incidents(_stream(spark, sf_dir, "visitadas"), threshold=2), "incident")


def stream_hourly(spark, sf_dir):
    from textquarry.streaming.crawl import hourly_counts, run_available

    counts = run_available(hourly_counts(_stream(spark, sf_dir, "visitadas")), "hourly", latest=("hora", "site"))
    return counts.withColumn("hora", F.date_format("hora", "yyyy-MM-dd HH:mm"))


def queries() -> dict:
    listed = (
        clean_text, clean_text_full, tokenize, split_compounds, camel_split, cjk_bigrams, normalize_filter_tokens, stopword_filter, stem_words,
        analysis_stage_counts, fields, snippet, units_field, units_document, units_chunk, chunk_overlap, postings_field, postings_document,
        postings_unstemmed, field_mask, positions, lexicon_df_cf, unit_lengths, avg_lengths, posting_gaps, vbyte_sizes, vbyte_roundtrip,
        crc32_bucket, index_stats, block_vocabulary, term_lookup, term_detail, query_analysis, idf_table, bm25_topk, bm25f_topk, maxp_topk,
        bm25f_custom, query_workload_topk, search_full, topk_hydrated, topk_overlap, source_share_top10, phrase_search, zipf_ranks, zipf_fit,
        rank_sample, df1_share, top_terms_df, heaps_curve, heaps_fit, url_normalize, url_normalize_exact, url_classify, link_extract,
        sitemap_locs, to_int, clean_ws, content_hash, exact_duplicates, greedy_duplicates, frontier_next, frontier_dedup, frontier_counts,
        requeue, seed_cross, hint_left_join, robots_match, link_priority, outcome_histogram, status_histogram, error_count, crawl_rate,
        fill_rate, hourly_timeline, crawl_summary, last_block, run_bookkeeping, systematic_sample, export_jsonl, project_listing,
        incident_runs, hold_backoff, html_project_extract, listing_hints, position_bytes, config_sweep, response_outcomes, backoff_waits, line_counts, page_record, target_stop, stream_dedup, stream_incident, stream_hourly,
    )
    renamed = {"fields": "field_view", "stem_words": "stem_vocabulary"}
    return {renamed.get(f.__name__, f.__name__): f for f in listed}
