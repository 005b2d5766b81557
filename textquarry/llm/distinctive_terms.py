"""How distinctive a term is per record: a parsimonious language model.

A record's term frequencies are taken as a mixture of a model of the record
and the background model of the collection (cf / total). Expectation-
maximisation separates them:

    e_t = tf_t * w p_t / (w p_t + (1 - w) c_t)        p_t = e_t / sum(e)

with the record's share ``w``. What the background explains ends near zero,
what is the record's own ends high, and the converged p_t ranks the terms.

The background is broadcast for the heavy terms only, those with at least
1/HEAVY of the field's occurrences, of which there are at most HEAVY a field;
the others are joined by a shuffle, where none of them is hot.

Defined results: null or empty texts give no rows, ties in the score keep all
rows, repeated ids of one field count as one record with the terms of both,
and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.term_frequency import _PAIRS, _count_in_record
from textquarry.session import cut

HEAVY = 2000
RECORD_SHARE = 0.1
ROUNDS = 60


def parsimonious(tf: np.ndarray, background: np.ndarray, share: float = RECORD_SHARE, rounds: int = ROUNDS, eps: float = 1e-6) -> np.ndarray:
    """Converged term probabilities of one record."""
    p = tf / tf.sum()
    for _ in range(rounds):
        e = tf * (share * p) / (share * p + (1 - share) * background)
        new = e / e.sum()
        if np.abs(new - p).max() < eps:
            return new
        p = new
    return p


def _em(share: float, rounds: int):
    """The same for a batch of records at once, always ``rounds`` rounds, so
    that a record's result does not depend on its batch."""

    @F.pandas_udf("array<double>")
    def em(tf: pd.Series, bg: pd.Series) -> pd.Series:
        if not len(tf):
            return pd.Series([], dtype=object)
        sizes = np.array([len(t) for t in tf])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n, rest = np.concatenate(tf.to_list()).astype(float), (1 - share) * np.concatenate(bg.to_list()).astype(float)
        p = n / np.repeat(np.add.reduceat(n, starts), sizes)
        for _ in range(rounds):
            own = share * p
            e = n * own / (own + rest)
            p = e / np.repeat(np.add.reduceat(e, starts), sizes)
        return pd.Series(np.split(p, starts[1:]), dtype=object)

    return em


def term_counts(terms: DataFrame) -> DataFrame:
    """(campo, id, terms) to (campo, termo, id, n), counted inside the record."""
    pairs = terms.select("campo", "id", "terms").mapInArrow(_count_in_record, _PAIRS)
    return pairs.groupBy("campo", "id", "termo").agg(F.sum("n").alias("n"))


def distinctive_terms(terms: DataFrame, *, share: float = RECORD_SHARE, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """(campo, id, terms) to (campo, id, termo, tf, df, score): every term of
    every record with its converged probability."""
    counts = cut(term_counts(terms))  # read by statistics and by the join
    stats = counts.groupBy("campo", "termo").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    totals = stats.groupBy("campo").agg(F.sum("cf").alias("total"))
    stats = stats.join(F.broadcast(totals), "campo").withColumn("bg", F.col("cf") / F.col("total"))
    hot = stats.where(F.col("bg") >= 1.0 / heavy).select("campo", "termo", F.col("df").alias("hdf"), F.col("bg").alias("hbg"))
    cold = stats.where(F.col("bg") < 1.0 / heavy).select("campo", "termo", F.col("df").alias("cdf"), F.col("bg").alias("cbg"))
    tagged = counts.join(F.broadcast(hot), ["campo", "termo"], "left")
    known = tagged.where("hdf is not null").select("campo", "id", "termo", "n", F.col("hdf").alias("df"), F.col("hbg").alias("bg"))
    rest = tagged.where("hdf is null").join(cold.hint("merge"), ["campo", "termo"]).select("campo", "id", "termo", "n", F.col("cdf").alias("df"), F.col("cbg").alias("bg"))
    per = (
        known.unionByName(rest)
        .groupBy("campo", "id")
        .agg(F.collect_list(F.struct("termo", "n", "df", "bg")).alias("t"))
        .withColumn("p", _em(share, rounds)(F.col("t.n").cast("array<double>"), F.col("t.bg")))
    )
    return per.select("campo", "id", F.explode(F.arrays_zip("t", "p")).alias("x")).select(
        "campo", "id", F.col("x.t.termo").alias("termo"), F.col("x.t.n").alias("tf"), F.col("x.t.df").alias("df"), F.col("x.p").alias("score")
    )
