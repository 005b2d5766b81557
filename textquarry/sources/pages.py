"""Raw pages: an append-only Parquet store addressed by url."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 1000
PIECE = 1 << 22


def append_pages(pages: DataFrame, path: str, block: int = BLOCK) -> None:
    """(site, url, html) appended in files of at most ``block`` pages, by site,
    sorted by url so that a point read skips row groups."""
    (
        pages.repartitionByRange("site", "url")
        .sortWithinPartitions("site", "url")
        .write.mode("append")
        .option("maxRecordsPerFile", block)
        .option("compression", "zstd")
        .partitionBy("site")
        .parquet(path)
    )


def read_page(spark: SparkSession, path: str, url: str, site: str | None = None) -> DataFrame:
    """The stored page of a url; site prunes partitions, url row groups."""
    pages = spark.read.parquet(path)
    return pages.where((F.col("url") == url) & (F.col("site") == site if site else F.lit(True)))


def read_stored(pages: DataFrame, visits: DataFrame, site: str, bloco: str, posicao: int) -> DataFrame:
    """The page at an address (site, block, position), by the visit that has
    it; an address delivered twice gives the page once."""
    at = visits.where((F.col("site") == site) & (F.col("bloco") == bloco) & (F.col("posicao") == posicao)).select("site", "url").distinct()
    return pages.where(F.col("site") == site).join(F.broadcast(at), ["site", "url"])  # one address has one url


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path. Files are read in pieces by the task
    that has them, never as one value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for name, length in zip(pdf["path"], pdf["length"]):
                store, at = fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                rows.append((name.rsplit("/", 1)[-1], length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["arquivo", "length", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.replace("path", F.lit("file:/"), F.lit("file:///")).alias("path"), "length")
    return files.mapInPandas(run, "arquivo string, length long, sha256 string")


def csv_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
