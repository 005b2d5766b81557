"""JSON lines of projects: reading with a fixed schema and exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.operators.crawl import EXPORT_FIELDS

PROJECT_SCHEMA = (
    "site string, url string, coletado_em string, status_http int, nome string, dono string, descricao string, resumo string, "
    "topicos array<string>, categorias array<string>, linguagem string, estrelas int, forks int, licenca string, readme string, "
    "downloads_semana int, nota double, num_avaliacoes int, ultima_atualizacao string"
)


def read_projects(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Projects of a JSON-lines file; blank lines are skipped. ``limit`` counts
    physical lines, blank ones included."""
    lines = spark.read.text(path)
    if limit:
        lines = lines.limit(limit)
    return lines.where(F.trim("value") != "").select(F.from_json("value", PROJECT_SCHEMA).alias("p")).select("p.*")


def export_projects(projects: DataFrame, path: str, batch: int = 500) -> None:
    """One JSON object a line in order of id, each site with its own columns,
    nulls included. Rows are range-partitioned by id, so every file is sorted
    and the files are in order."""
    out = projects.select("id", "site", export_json(projects).alias("value"))
    out.repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def export_json(projects: DataFrame):
    """The JSON text of a row with the columns of its site."""
    have = set(projects.columns)
    text = F.to_json(F.struct(*[c for c in projects.columns if c != "id"]), {"ignoreNullFields": "false"})
    for site, fields in EXPORT_FIELDS.items():
        own = F.struct(*[F.col(f) for f in fields if f in have])
        text = F.when(F.col("site") == site, F.to_json(own, {"ignoreNullFields": "false"})).otherwise(text)
    return text
