"""Collection statistics: analysis stages, Zipf and Heaps curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textquarry.functions.cleaning import clean_text
from textquarry.functions.lexical import FIELDS, Analyzer
from textquarry.functions.plan import once, sums_before
from textquarry.functions.stemmer import stem_vocabulary
from textquarry.functions.stopwords import STOPWORDS
from textquarry.session import cut


def stages(fields_: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, site, etapa, token) of the five analysis stages."""
    text = F.concat_ws("\n", *FIELDS)
    base = fields_.select("doc_id", "site", text.alias("text"))
    normal = analyzer.normalized(F.col("text"))
    arrays = F.array(
        F.struct(F.lit("bruto").alias("etapa"), F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("t")),
        F.struct(F.lit("tokens").alias("etapa"), analyzer.tokens(F.col("text")).alias("t")),
        F.struct(F.lit("normalizados").alias("etapa"), normal.alias("t")),
    )
    made = cut(once(base, "doc_id", "site", stages=arrays))  # three branches read it
    rows = made.select("doc_id", "site", F.inline("stages")).select("doc_id", "site", "etapa", F.explode("t").alias("token"))
    kept = rows.where((F.col("etapa") == "normalizados") & ~F.col("token").isin(*STOPWORDS)).withColumn("etapa", F.lit("sem_stopwords"))
    vocabulary = stem_vocabulary(kept)
    stems = kept.join(vocabulary, "token").select("doc_id", "site", F.lit("stems").alias("etapa"), F.col("stem").alias("token"))
    return rows.unionByName(kept).unionByName(stems)


def stage_counts(stage_rows: DataFrame) -> DataFrame:
    """Tokens and distinct tokens of every stage, in all and by site."""
    counted = stage_rows.groupBy("etapa", "site", "token").agg(F.count("*").alias("n"))
    return counted.groupingSets([["etapa"], ["etapa", "site"]], "etapa", "site").agg(F.sum("n").alias("tokens"), F.countDistinct("token").alias("vocabulario"))


EXACT = 64


def zipf_ranks(lexicon: DataFrame) -> DataFrame:
    """Terms by falling frequency with their rank, without one task for all:
    terms are numbered inside bands, bands are summed up. The low frequencies,
    which most terms have, are a band each, divided by the terms' beginnings;
    above them a band is a quarter of a power of two."""
    cf, low = F.col("cf"), F.col("cf") <= EXACT
    band = -F.when(low, cf).otherwise(EXACT + 1 + F.floor(F.log2(cf / F.lit(float(EXACT))) * 4)).cast("long")
    keyed = lexicon.select("term", "cf", band.alias("band"), F.when(low, F.substring("term", 1, 2)).otherwise("").alias("start"))
    counts = keyed.groupBy("band", "start").agg(F.count("*").alias("n"))
    bands = sums_before(counts.groupBy("band").agg(F.sum("n").alias("n")), "band", above="n")  # a few hundred rows
    inside = Window.partitionBy("band").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("band", "start", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before")).join(F.broadcast(bands), "band")
    local = Window.partitionBy("band", "start").orderBy(F.desc("cf"), "term")
    return keyed.withColumn("at", F.row_number().over(local)).join(starts, ["band", "start"]).select("term", "cf", (F.col("above") + F.col("before") + F.col("at")).alias("posto"))


def zipf_fit(ranks: DataFrame, low: int = 10, high: int = 10_000) -> DataFrame:
    """Least squares of log10 frequency on log10 rank."""
    x, y = F.log10(F.col("posto").cast("double")), F.log10(F.col("cf").cast("double"))
    fit = ranks.where(F.col("posto").between(low, high)).select(x.alias("x"), y.alias("y"))
    return fit.agg(F.round(F.regr_slope("y", "x"), 6).alias("inclinacao"), F.round(F.regr_intercept("y", "x"), 6).alias("intercepto"), F.count("*").alias("pontos"))


def rank_sample(ranks: DataFrame, points: int = 400) -> DataFrame:
    """About ``points`` ranks evenly spaced in the logarithm; the list of ranks
    is computed from the vocabulary's size and holds ``points`` values at most."""
    size = ranks.agg(F.max("posto").alias("m"))
    wanted = size.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.round(F.pow(F.lit(10.0), F.log10(F.col("m").cast("double")) * i / (points - 1))).cast("long")))).alias("posto"))
    return ranks.join(F.broadcast(wanted), "posto").select("posto", "cf")


def df1_share(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count("*").alias("termos"), F.count_if(F.col("df") == 1).alias("df1"), F.round(F.count_if(F.col("df") == 1) / F.count("*"), 6).alias("parte"))


def top_terms(lexicon: DataFrame, documents: int | None = None, k: int = 40) -> DataFrame:
    """The k terms of the most units."""
    return lexicon.orderBy(F.desc("df"), "term").limit(k).select("term", "df", "cf")


def heaps_curve(counts: DataFrame, width: int = 256) -> DataFrame:
    """(doc_id, term, n) to (doc_id, tokens, vocabulario): running totals in
    document order. The
    counts are summed by ranges of documents first, then inside each range."""
    counted = cut(counts)
    firsts = counted.groupBy("term").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("novos"))
    sizes = counted.groupBy("doc_id").agg(F.sum("n").alias("n"))
    per = sizes.join(firsts, "doc_id", "left").select("doc_id", "n", F.coalesce("novos", F.lit(0)).alias("novos"), F.floor(F.col("doc_id") / width).alias("faixa"))
    totals = per.groupBy("faixa").agg(F.sum("n").alias("tn"), F.sum("novos").alias("tv"))
    starts = sums_before(totals, "faixa", sn="tn", sv="tv")
    inside = Window.partitionBy("faixa").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return per.join(starts, "faixa").select("doc_id", (F.col("sn") + F.sum("n").over(inside)).alias("tokens"), (F.col("sv") + F.sum("novos").over(inside)).alias("vocabulario"))


def heaps_fit(curve: DataFrame) -> DataFrame:
    """V = K T^beta by least squares on the logarithms."""
    x, y = F.log10(F.col("tokens").cast("double")), F.log10(F.col("vocabulario").cast("double"))
    fit = curve.select(x.alias("x"), y.alias("y")).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return fit.select(F.round(F.pow(F.lit(10.0), "a"), 6).alias("k"), F.round("b", 6).alias("beta"))


def clean_lengths(fields_: DataFrame, decoded: bool = True) -> DataFrame:
    return fields_.select("doc_id", F.length(clean_text(F.col("readme"), decoded=decoded)).alias("tamanho"))
