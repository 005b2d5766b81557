"""Command line: index, search and report.

    python -m textquarry.cli index  --entrada projetos.jsonl --saida indice
    python -m textquarry.cli search "editor markdown" --indice indice --k 10
    python -m textquarry.cli term   python --indice indice
    python -m textquarry.cli serve  --indice indice --port 8000
    python -m textquarry.cli report --tabelas pasta
    python -m textquarry.cli sweep  --entrada projetos.parquet --saida tabela.csv
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession, functions as F

from textquarry.functions.lexical import Analyzer
from textquarry.operators import crawl, index as ix
from textquarry.operators.fields import IndexConfig
from textquarry.sources.jsonl import read_projects
from textquarry.sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry")
    sub = p.add_subparsers(dest="command", required=True)
    options = argparse.ArgumentParser(add_help=False)
    options.add_argument("--granularidade", default="campo", choices=("documento", "campo", "chunk"))
    options.add_argument("--tamanho-chunk", type=int, default=256)
    options.add_argument("--sobreposicao", type=int, default=0)
    options.add_argument("--sem-posicoes", action="store_true")
    options.add_argument("--sem-stopwords", action="store_true", help="keep stopwords")
    options.add_argument("--sem-stemming", action="store_true")
    options.add_argument("--particoes", type=int, default=16)
    index = sub.add_parser("index", parents=[options])
    index.add_argument("--entrada", required=True, help="JSON lines or a Parquet table of projects")
    index.add_argument("--saida", required=True)
    index.add_argument("--limite", type=int, default=0)
    for name in ("search", "term", "serve"):
        one = sub.add_parser(name, parents=[options])
        if name != "serve":
            one.add_argument("text")
        one.add_argument("--indice", required=True)
        one.add_argument("--k", type=int, default=10)
        one.add_argument("--port", type=int, default=8000)
    sweep = sub.add_parser("sweep")
    sweep.add_argument("--entrada", required=True, help="a Parquet table of projects")
    sweep.add_argument("--saida", required=True, help="folder of the CSV")
    report = sub.add_parser("report")
    report.add_argument("--tabelas", required=True)
    return p


def config_of(args) -> IndexConfig:
    analyzer = Analyzer(remove_stopwords=not args.sem_stopwords, stemming=not args.sem_stemming)
    return IndexConfig(granularity=args.granularidade, chunk=args.tamanho_chunk, overlap=args.sobreposicao, positions=not args.sem_posicoes, partitions=args.particoes, analyzer=analyzer).validate()


def read_input(spark: SparkSession, path: str, limit: int = 0):
    """Projects of a Parquet table, or of JSON lines with ids in line order."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.limit(limit) if limit else df
    return read_projects(spark, path, limit).withColumn("id", F.monotonically_increasing_id())


def report(spark: SparkSession, folder: str) -> list[str]:
    visits, projects, queue, runs = (table(spark, folder, t) for t in ("visitadas", "projetos", "fila", "execucoes"))
    lines = []
    for title, df in (
        ("totals", crawl.visit_totals(visits)),
        ("rate", crawl.crawl_rate(visits, runs)),
        ("by site", crawl.site_counts(projects, visits, queue)),
        ("outcomes", crawl.outcome_histogram(visits).orderBy("site", F.desc("n"))),
        ("status", crawl.status_histogram(visits).orderBy("site", F.desc("n"))),
        ("filled fields", crawl.fill_rates(projects).orderBy("site", "campo")),
    ):
        lines.append(f"--- {title}")
        lines += [json.dumps(r.asDict(), ensure_ascii=False, default=str) for r in df.collect()]  # a report of few rows
    return lines


#: Configurations of the sweep: granularity, chunks, positions, analysis, buckets.
SWEEP = {
    "documento": IndexConfig(granularity="documento"),
    "campo": IndexConfig(),
    **{f"chunk_{n}": IndexConfig(granularity="chunk", chunk=n) for n in (64, 128, 256, 512)},
    **{f"chunk_{n}_sobrep_{n // 4}": IndexConfig(granularity="chunk", chunk=n, overlap=n // 4) for n in (128, 256)},
    "documento_sem_posicoes": IndexConfig(granularity="documento", positions=False),
    "campo_sem_posicoes": IndexConfig(positions=False),
    "sem_stopwords": IndexConfig(analyzer=Analyzer(remove_stopwords=False)),
    "sem_stemming": IndexConfig(analyzer=Analyzer(stemming=False)),
    "sem_stopwords_sem_stemming": IndexConfig(analyzer=Analyzer(remove_stopwords=False, stemming=False)),
    **{f"particoes_{n}": IndexConfig(partitions=n) for n in (1, 64, 256)},
}


def sweep(projects, configurations: dict[str, IndexConfig] = SWEEP):
    """A row a configuration: units, vocabulary, postings, occurrences, raw
    bytes, and the seconds of its build from the kept analysis."""
    out = None
    for name, config in configurations.items():
        ix.kept_analysis(projects, config.analyzer)
        began = time.time()
        index = ix.kept_index(projects, config)
        row = ix.collection_statistics(index).select(F.lit(name).alias("configuracao"), "unidades", "vocabulario", "postings", "ocorrencias", "bytes_sem_compressao", F.lit(round(time.time() - began, 2)).alias("segundos"))
        out = row if out is None else out.unionByName(row)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("textquarry").getOrCreate()
    if args.command == "report":
        print("\n".join(report(spark, args.tabelas)))
        return
    if args.command == "sweep":
        sweep(read_input(spark, args.entrada)).coalesce(1).write.mode("overwrite").csv(args.saida, header=True)
        return
    config = config_of(args)
    if args.command == "index":
        built = ix.build(read_input(spark, args.entrada, args.limite), config)
        ix.write(built, args.saida)
        built.release()
        return
    from textquarry.api import SearchService, serve

    service = SearchService(spark, args.indice, config)
    if args.command == "serve":
        serve(service, args.port).serve_forever()
    else:
        out = service.search(args.text, args.k) if args.command == "search" else service.term(args.text)
        print(json.dumps(out, ensure_ascii=False, indent=1, default=str))


if __name__ == "__main__":
    main()
