"""BM25, BM25F and best-passage ranking of batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.functions.lexical import Analyzer
from textquarry.functions.stemmer import stem_vocabulary
from textquarry.operators.index import Index

K1, B = 1.2, 0.75
WEIGHTS = {"nome": 3.0, "descricao": 2.0, "rotulos": 2.0, "readme": 1.0, "texto": 1.0}


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(qid, text) to (qid, term, qtf, pos): the analyzed terms of a query, how
    often each occurs and where it occurs first."""
    tokens = queries.select("qid", F.posexplode(analyzer.terms(F.col("text"))).alias("pos", "token"))
    if analyzer.stemming:
        tokens = tokens.join(stem_vocabulary(tokens), "token").withColumnRenamed("stem", "term")
    else:
        tokens = tokens.withColumnRenamed("token", "term")
    return tokens.groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), N the number of units."""
    return F.ln(1.0 + (n.cast("double") - df + 0.5) / (df + 0.5))


def idf_table(index: Index) -> DataFrame:
    n = index.units.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return index.lexicon.join(F.broadcast(n)).select("term", "df", "cf", F.round(idf(F.col("df"), F.col("n")), 9).alias("idf"))


def average_lengths(index: Index) -> DataFrame:
    """One row: units and mean length of every field, empty units included."""
    return index.units.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("n"),
        *[F.greatest(F.coalesce(F.avg(F.col("len")[i].cast("double")), F.lit(0.0)), F.lit(1e-9)).alias(f"avg_{f}") for i, f in enumerate(index.config.fields)],
    )


def unit_scores(index: Index, terms: DataFrame, *, k1: float = K1, b: float = B, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, unit_id, score, first): scores of all units with any query term.

    Postings are filtered by the query terms before anything else; the terms
    of a workload are broadcast by Spark where they are few, the statistics are
    one row. ``first`` is the earliest query position that touches the unit."""
    w = WEIGHTS | (weights or {})
    stats = F.broadcast(average_lengths(index))
    hit = index.postings.join(terms, "term").join(index.lexicon.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi"), "term")
    hit = hit.join(index.units.select("unit_id", "len"), "unit_id").join(stats)
    weighted = F.lit(0.0)
    for i, f in enumerate(index.config.fields):
        norm = (1.0 - b) + b * F.col("len")[i].cast("double") / F.col(f"avg_{f}")
        weighted = weighted + F.when(F.col("tf")[i] > 0, w.get(f, 1.0) * F.col("tf")[i].cast("double") / norm).otherwise(0.0)
    scored = hit.withColumn("wtf", weighted).withColumn("part", F.col("qtf") * idf(F.col("df"), F.col("n")) * F.col("wtf") / (k1 + F.col("wtf")))
    return scored.groupBy("qid", "unit_id").agg(F.sum("part").alias("score"), F.min("pos").alias("first"))


def document_scores(index: Index, scores: DataFrame) -> DataFrame:
    """Best unit of every document (MaxP); with one unit a document, itself."""
    docs = index.units.select("unit_id", "doc_id")
    best = scores.join(docs, "unit_id").groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.min(F.struct("first", "unit_id")).alias("seen"))
    return best.where("score > 0").select("qid", "doc_id", "score", F.col("seen.first").alias("first"), F.col("seen.unit_id").alias("unit_id"))


def top_k(scores: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(qid, rank, doc_id, score). Ties go to the document first touched: the
    lowest query position, then the lowest unit."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "first", "unit_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", F.round("score", digits).alias("score"))


def search(index: Index, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """The k best documents of every query (qid, text), all in one plan. A
    query without known terms gives no row."""
    terms = query_terms(queries, index.config.analyzer)
    return top_k(document_scores(index, unit_scores(index, terms, **options)), k)


def hydrate(results: DataFrame, documents: DataFrame, columns=("site", "nome", "url", "trecho")) -> DataFrame:
    return results.join(documents.select("doc_id", *columns), "doc_id")


def overlap(results: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """Mean over the queries of |A and B| / k; ``normalized`` divides by the
    size of the baseline's list instead."""
    a = results.select("qid", "doc_id", F.lit(1).alias("hit"))
    base = baseline.select("qid", "doc_id").join(a, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("hit").alias("both"), F.count("*").alias("n"))
    return base.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("both") / float(k)), 6).alias("overlap"), F.round(F.avg(F.col("both") / F.col("n")), 6).alias("normalized"))


def phrase_units(index: Index, terms: list[str]) -> DataFrame:
    """Units holding the terms one after another in one field (beyond ranked
    retrieval; needs positions)."""
    if index.positions is None:
        raise ValueError("the index has no positions")
    wanted = index.positions.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    starts = index.positions.join(F.broadcast(wanted), "term").select("unit_id", "field", "i", F.explode(F.transform("pos", lambda p: p - F.col("i"))).alias("start"))
    return starts.groupBy("unit_id", "field", "start").agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(terms)).select("unit_id", "field", "start")
