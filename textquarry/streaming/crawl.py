"""Incremental counterparts of the crawl operators."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textquarry.functions.urls import canonical_native
from textquarry.operators.crawl import result_code
from textquarry.session import ensure_checkpoint_dir, path_of

_RUN_STATE = "tamanho long"
_INCIDENT = "site string, url string, coletado_em string, tamanho long"


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table as a stream of files with its schema read once."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    if os.path.isdir(path):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def canonical_rows(queue: DataFrame) -> DataFrame:
    """Queue rows with their canonical url, those without one left out."""
    return queue.withColumn("canonica", canonical_native(F.col("url"))).where("canonica is not null")


def hourly_counts(visits: DataFrame, late: str = "30 days") -> DataFrame:
    """Pages an hour by site in event time, with a watermark for late rows."""
    timed = visits.withColumn("t", F.to_timestamp("coletado_em")).withWatermark("t", late)
    return timed.groupBy(F.window("t", "1 hour").alias("w"), "site").agg(F.count("status_http").alias("paginas"), F.count_if(result_code(F.col("resultado")) == "projeto").alias("projetos")).select(F.col("w.start").alias("hora"), "site", "paginas", "projetos")


def incidents(visits: DataFrame, threshold: int = 10) -> DataFrame:
    """A row whenever a site has given ``threshold`` suspicious answers in a
    row; blocked rows are transparent, any other answer starts again."""

    def step(key, batches, state: GroupState):
        run = state.get[0] if state.exists else 0
        rows = []
        for pdf in batches:
            for url, when, code in zip(pdf["url"], pdf["coletado_em"], pdf["codigo"]):
                if code == "bloqueada_robots":
                    continue
                run = run + 1 if code == "soft404" else 0
                if run >= threshold:
                    rows.append((key[0], url, when, run))
                    run = 0
        state.update((run,))
        yield pd.DataFrame(rows, columns=["site", "url", "coletado_em", "tamanho"])

    coded = visits.select("site", "url", "coletado_em", result_code(F.col("resultado")).alias("codigo"))
    return coded.groupBy("site").applyInPandasWithState(step, _INCIDENT, _RUN_STATE, "append", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession, name: str, folder: str | None) -> str:
    return folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{os.urandom(6).hex()}"


def _written(spark: SparkSession, path: str) -> bool:
    fs, at = path_of(spark, path)
    return fs.exists(at)


def run_available(stream: DataFrame, name: str, *, folder: str | None = None, latest: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that is there into a table and return it. In the
    same ``folder`` it goes on where it ended; without one it starts anew.

    With ``latest`` the stream's rows are updates, of which the last of every
    key counts: every batch writes its own, once, and a window is forgotten by
    the watermark instead of being kept for ever."""
    spark, base = stream.sparkSession, _folder(stream.sparkSession, name, folder)
    if not latest:
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{base}/out")

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/lote={n}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    if not _written(spark, f"{base}/out"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{base}/out")
    values = [c for c in stream.columns if c not in latest]
    return rows.groupBy(*latest).agg(*[F.max_by(c, "lote").alias(c) for c in values]).select(stream.columns)


def run_new_urls(queue: DataFrame, name: str, *, folder: str | None = None) -> DataFrame:
    """Queue rows whose canonical url was not queued before. The known urls are
    the table written so far, not the state of the stream; a batch that is run
    again writes the same rows again."""
    spark, base = queue.sparkSession, _folder(queue.sparkSession, name, folder)
    rows = canonical_rows(queue)

    def save(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates(["canonica"])
        if _written(session, f"{base}/out"):
            known = session.read.parquet(f"{base}/out")
            if "lote" in known.columns:
                fresh = fresh.join(known.where(F.col("lote") < n).select("canonica"), "canonica", "left_anti")
        fresh.select(rows.columns).write.mode("overwrite").parquet(f"{base}/out/lote={n}")

    rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(rows.columns) if _written(spark, f"{base}/out") else spark.createDataFrame([], rows.schema)
