"""URLs, pages, robots, queue, incidents, duplicates, streams."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import html, robots, urls
from textquarry.operators import crawl

URLS = {
    "HTTP://WWW.GitHub.com:80/PSF/Requests/?utm_source=x&b=2&a=1#top": "https://github.com/psf/requests?a=1&b=2",
    "https://github.com/topics/python?page=1": "https://github.com/topics/python",
    "https://github.com/topics/python?page=2&page=3": "https://github.com/topics/python?page=3",
    "https://sourceforge.net/projects//seven": "https://sourceforge.net/projects/seven/",
    "https://sourceforge.net/sitemap.xml": "https://sourceforge.net/sitemap.xml",
    "https://github.com": "https://github.com/",
    "mailto:a@b.c": None,
    "": None,
}
KINDS = {
    "https://github.com/topics": "listing",
    "https://github.com/topics/c?page=50": "listing",
    "https://github.com/topics/c?page=51": None,
    "https://github.com/psf/requests": "project",
    "https://github.com/sponsors/psf": None,
    "https://github.com/psf/requests.git": None,
    "https://github.com/psf/requests?tab=x": None,
    "https://sourceforge.net/projects/seven/": "project",
    "https://sourceforge.net/directory/games/?page=4": "listing",
    "https://sourceforge.net/sitemap-3.xml": "sitemap",
    "https://example.org/x": None,
}


def test_canonical(spark):
    assert {u: urls.canonical_url(u) for u in URLS} == URLS
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: (r.a, r.b) for r in df.select("u", urls.canonical(F.col("u")).alias("a"), urls.canonical_native(F.col("u")).alias("b")).collect()}
    assert got == {u: (c, c) for u, c in URLS.items()}
    assert urls.canonical_url("../x", "https://github.com/a/b/c") == "https://github.com/a/x"


def test_classify(spark):
    df = spark.createDataFrame([(u,) for u in KINDS], "u string")
    assert {r.u: r.k for r in df.select("u", urls.classify(F.col("u")).alias("k")).collect()} == KINDS


def test_pages():
    page = '<a href="/b/c">x</a><a href="/b/c#y">x</a><link rel="next" href="?page=2"><form method="get" action="/topics/c?page=1"><input name="page" value="3"></form>'
    assert html.page_links(page, "https://github.com/topics/c") == ["https://github.com/b/c", "https://github.com/topics/c?page=2", "https://github.com/topics/c?page=3"]
    card = '<article><h3><a href="/a">a</a><a href="/a/b">b</a></h3><span itemprop="programmingLanguage"> Go </span></article>'
    assert html.listing_cards(card, "https://github.com/") == {"https://github.com/a/b": "Go"}
    assert html.repository("<p>nothing</p>") is None
    repo = html.repository('<meta name="octolytics-dimension-repository_nwo" content="A/B"><div><h2>About</h2><p> x  y </p><a href="/topics/t">t</a><a href="#MIT-1-ov-file">MIT license</a></div><a id="repo-stars-counter-star" title="1,234"></a><article class="markdown-body entry">Read &amp; me</article>')
    assert (repo["chave"], repo["descricao"], repo["topicos"], repo["licenca"], repo["estrelas"], repo["readme"]) == ("a/b", "x y", ["t"], "MIT", 1234, "Read & me")
    forge = html.project('<meta property="og:url" content="https://sourceforge.net/projects/seven/"><h1 itemprop="name">Seven</h1><section class="project-info"><h4>License</h4> <a>LGPL</a></section><div class="as-h2"><span class="label">Downloads:</span> 11.5k</div>')
    assert (forge["chave"], forge["licenca"], forge["downloads_semana"]) == ("seven", "LGPL", 11500)


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a/*.pdf$\nDisallow: /b\nAllow: /b/ok\nSitemap: https://h/s.xml\nUser-agent: Other\nDisallow: /\n"
    rows = robots.rule_rows("h", 200, text) + robots.rule_rows("gone", 404, "") + robots.rule_rows("down", 503, "")
    rules = spark.createDataFrame(rows, robots.RULE_SCHEMA)
    want = {"https://h/a/x.pdf": False, "https://h/a/x.pdfx": True, "https://h/b/1": False, "https://h/b/ok/1": True, "https://gone/x": True, "https://down/x": False, "https://unknown/x": False}
    got = robots.allowed(spark.createDataFrame([(u,) for u in want], "url string"), rules)
    assert {r.url: r.allowed for r in got.collect()} == want
    assert robots.parse_robots(text)["sitemaps"] == ["https://h/s.xml"]


def test_greedy_duplicates(spark):
    rows = [(1, "s", "a", "h1"), (2, "s", "a", "h2"), (3, "s", "b", "h2"), (4, "s", "c", "h1"), (5, "s", "d", None), (6, "s", "d", "h9"), (7, "t", "a", "h1")]
    df = spark.createDataFrame(rows, "id long, site string, chave string, hash_conteudo string")
    # 2 falls to the key of 1, so its hash does not drop 3
    assert sorted(r.id for r in crawl.greedy_duplicates(df).collect()) == [1, 3, 5, 7]


def test_incidents_and_holds(spark):
    codes = ["soft404"] * 3 + ["bloqueada_robots"] + ["soft404"] * 2 + ["ok"] + ["soft404"]
    visits = spark.createDataFrame([("s", i, c, c == "soft404") for i, c in enumerate(codes)], "site string, ordem int, resultado string, suspeita boolean")
    got = [(r.tamanho, r.incidentes) for r in crawl.incident_runs(visits, threshold=5).orderBy("inicio").collect()]
    assert got == [(5, 1), (1, 0)]
    held = spark.createDataFrame([("s", "p", i, a) for i, a in enumerate([True] * 7 + [False, True])], "site string, tipo string, ordem int, adiada boolean")
    assert [r.espera for r in crawl.hold_backoff(held).orderBy("ordem").collect()] == [120, 240, 480, 960, 1920, 3600, 3600, 120]


@pytest.mark.parametrize("status,kind,want", [(None, "project", "erro_rede"), (302, "project", "redirecionada"), (503, "listing", "adiada"), (404, "listing", "erro_http"), (200, "listing", "ok"), (200, "project", "projeto")])
def test_outcomes(spark, status, kind, want):
    df = spark.createDataFrame([(True, status, kind, "text/html", False, True, False)], "allowed boolean, status int, kind string, content_type string, xml boolean, is_project boolean, duplicate boolean")
    assert crawl.outcome(df).first().resultado == want


def test_runs_by_bands(spark):
    """Runs and waits are the same however the rows are divided."""
    rows = [("s" if i % 3 else "t", "p", i, i * 7 % 5 < 3) for i in range(400)]
    df = spark.createDataFrame(rows, "site string, tipo string, ordem int, suspeita boolean").withColumn("resultado", F.when(F.col("suspeita"), "soft404").otherwise("ok")).withColumn("adiada", F.col("suspeita"))
    bands = [None, F.floor(F.col("ordem") / 7), F.when(F.col("ordem") > 50, F.floor(F.col("ordem") / 10))]
    for made in (lambda b: crawl.incident_runs(df, 3, band=b).select("site", "inicio", "fim", "tamanho"), lambda b: crawl.hold_backoff(df, band=b).select("site", "ordem", "espera")):
        assert len({tuple(sorted(map(tuple, made(b).collect()))) for b in bands}) == 1


def test_page_record_changes_nothing_twice(spark):
    queue = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "id long, url string")
    visits = spark.createDataFrame([("u0", "2024-01-01T00:00:00Z", 200), ("u1", "2024-01-01T00:00:00Z", 500)], "url string, coletado_em string, status_http int")
    projects = spark.createDataFrame([(1, "s", "a", "old")], "id long, site string, chave string, nome string")
    batch = spark.createDataFrame([("u1", "2024-01-02T00:00:00Z", 404), ("u1", "2024-01-03T00:00:00Z", 200), ("u9", None, 200)], visits.schema)
    found = spark.createDataFrame([(9, "s", "a", "new"), (5, "s", "b", "first"), (7, "s", "b", "second")], projects.schema)
    one = crawl.record_pages(queue, visits, projects, batch, found)
    two = crawl.record_pages(*one, batch, found)
    for frames in (one, two):
        assert sorted((r.id for r in frames[0].collect())) == [2, 3]
        assert sorted((r.url, r.status_http) for r in frames[1].collect()) == [("u0", 200), ("u1", 200), ("u9", 200)]
        assert sorted((r.chave, r.nome) for r in frames[2].collect()) == [("a", "old"), ("b", "first")]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    from textquarry.streaming import crawl as live

    def deliver(n, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / n))

    queue = "id long, site string, url string"
    deliver("fila", [(1, "s", "https://gh.example/a/b"), (2, "s", "https://gh.example/a/b#x"), (3, "s", "https://gh.example/c/d")], queue)
    new = lambda: sorted(r.canonica for r in live.run_new_urls(live.stream_of(spark, str(tmp_path / "fila")), "d", folder=str(tmp_path / "d")).collect())
    assert new() == ["https://gh.example/a/b", "https://gh.example/c/d"]
    deliver("fila", [(4, "s", "https://gh.example/c/d"), (5, "s", "https://gh.example/e/f")], queue)
    assert new() == ["https://gh.example/a/b", "https://gh.example/c/d", "https://gh.example/e/f"] == new()

    visits = "url string, site string, status_http int, resultado string, coletado_em string"
    deliver("v", [("a", "s", 200, "projeto", "2024-01-01T10:05:00Z"), ("b", "s", 200, "ok", "2024-01-01T10:50:00Z")], visits)
    hours = lambda: sorted((r.hora.hour, r.paginas, r.projetos) for r in live.run_available(live.hourly_counts(live.stream_of(spark, str(tmp_path / "v"))), "h", folder=str(tmp_path / "h"), latest=("hora", "site")).collect())
    assert hours() == [(10, 2, 1)]
    deliver("v", [("c", "s", None, "projeto", "2024-01-01T10:59:00Z"), ("d", "s", 200, "ok", "2024-01-01T11:00:00Z")], visits)
    assert hours() == [(10, 2, 2), (11, 1, 0)] == hours()
