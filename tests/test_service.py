"""Command line, service and sinks, end to end on a small index."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from test_search import SEVEN, projects
from textquarry import cli
from textquarry.api import SearchService, answer, clamp_k, serve
from textquarry.operators.fields import IndexConfig
from textquarry.sources import jsonl, pages


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("service")
    projects(spark, SEVEN).write.parquet(str(path / "in.parquet"))
    cli.main(["index", "--entrada", str(path / "in.parquet"), "--saida", str(path / "i"), "--particoes", "3"])
    return SearchService(spark, str(path / "i"), IndexConfig(partitions=3))


def test_search_over_http(service):
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    body = json.load(urllib.request.urlopen(f"{base}/api/buscar?q=python&k=3"))
    assert [r["rank"] for r in body["resultados"]] == [1, 2, 3] and body["resultados"][0]["doc_id"] == 0
    assert body["termos"] == [{"termo": "python", "df": 4, "cf": 8}]
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{base}/api/buscar?q=%20")
    assert e.value.code == 400
    server.shutdown()


def test_term_and_info(service):
    status, body = answer(service, "/api/termo?t=python")
    assert status == 200 and body["df"] == 4 and [p["unit_id"] for p in body["postings"]] == [0, 1, 2, 3]
    assert answer(service, "/api/info")[1]["unidades"] == 7
    assert answer(service, "/api/buscar?q=inexistentexyz")[1]["resultados"] == []
    assert [clamp_k(x) for x in ("0", "99", "x", None, "7")] == [1, 50, 10, 10, 7]


def test_json_lines_round_trip(spark, tmp_path):
    table = projects(spark, SEVEN).withColumn("status_http", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(200))
    jsonl.export_projects(table, str(tmp_path / "out"))
    back = jsonl.read_projects(spark, str(tmp_path / "out"))
    assert sorted(r.nome for r in back.collect()) == sorted(n for n, _, _ in SEVEN)
    assert jsonl.read_projects(spark, str(tmp_path / "out"), limit=2).count() == 2


def test_page_store(spark, tmp_path):
    rows = spark.createDataFrame([("github", f"https://h/{i}", f"<p>{i}</p>") for i in range(20)], "site string, url string, html string")
    pages.append_pages(rows, str(tmp_path / "p"), block=6)
    assert pages.read_page(spark, str(tmp_path / "p"), "https://h/7", "github").first().html == "<p>7</p>"
    import hashlib
    from pathlib import Path

    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(tmp_path / "p").rglob("*.parquet")}
    assert want.items() <= {r.arquivo: r.sha256 for r in pages.file_digests(spark, str(tmp_path / "p")).collect()}.items()
    visits = spark.createDataFrame([("github", "https://h/3", "b1", 40), ("github", "https://h/3", "b1", 40), ("github", "https://h/4", "b1", 80)], "site string, url string, bloco string, posicao long")
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert [r.html for r in pages.read_stored(stored, visits, "github", "b1", 40).collect()] == ["<p>3</p>"]
    assert pages.read_stored(stored, visits, "github", "b2", 40).count() == 0


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1), ('say "x"', None), ("ção", 3)], "t string, n int")
    pages.csv_sink(df, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("escape", '"').schema("t string, n int").csv(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
