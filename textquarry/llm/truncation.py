"""Texts cut off by field limits or transfers that ended early.

Per source and unit (code points, bytes) the lengths get a log-normal
distribution fitted by maximum likelihood with right-censoring: values at a
candidate limit, a length far more frequent than its neighbours, count as "at
least this long" (EM for the censored normal of the logarithms). The censoring
posterior of a value at limit L is

    (n_L / N) / (n_L / N + f(L))

with the fitted density f. It is the prior of a text at a limit, uncapped; the
prior of other texts is one rate, fitted along. The evidence of the ending is
its class: a cut mark, an open code block, a list item unlike the ends of list
items elsewhere, a heading, a short line and so on. At limits its weight is the
log-likelihood ratio between texts at limits and complete texts, fitted by EM;
away from limits, where nothing tells cut texts from complete ones but their
ends, it is a fixed one (``START``, which counts as ``GUESS`` texts at limits).
A text that ends a sentence, a block or with a closing line does not end inside
anything and is no case wherever it ends.

A closing line ("Thanks") ends a share of ``FORMULA_SHARE`` of all texts at
least, which bounds their number by 1/FORMULA_SHARE and lets them be broadcast,
and is rarely continued on lines elsewhere.

Defined results: null, empty and blank texts are not cut. Repeated texts each
count, statistics count a text once. A null source is a source of its own.
Whole texts are read, of any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.plan import once
from textquarry.llm.text import wide_enough
from textquarry.session import cut

FORMULA_SHARE = 0.0003
#: First guess of every open ending's log-odds of a cut, before the prior.
START = {
    "mark": 9.0, "fence": 8.0, "table": 7.0, "dots": 7.0, "dots_after_sentence": 0.0, "number": 7.0, "heading": 2.0, "item_shorter": 6.5, "item_unlike": 5.5,
    "item": 0.0, "url": 0.0, "version": -1.0, "signature": -2.0, "notice": 5.0, "fields": 0.0, "letter": 0.0, "short": 4.5, "line": 7.0,
}
GUESS = 20.0
RATE = 0.02
_LIMITS = "source string, unit string, limit long, n long, posterior double, mu double, sigma double"

_LIST_ITEM = r"^\s{0,8}(?:[-*+•]|\d{1,3}[.)])\s"
_SENTENCE_END = r"[.!?。！？][\"'”’»)\]*_`]*$"
_DOTS = r"(?:\.\.\.|…)$"
_GREETING = r"^\p{L}[\p{L}\s]{0,30},$"
_MARK = r"(?:\((?:more|mais|más|mehr|suite|continued|cont\.?)\)|\[(?:\.\.\.|…)\]|[^\s»]*\s»|>>|\x{FFFD})$"


def censored_fit(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Log-normal (mu, sigma) by EM; ``censored`` marks right-censored values."""
    from math import erf, pi, sqrt

    x, w = np.log(lengths.astype(float)), counts.astype(float)
    mu = float(np.average(x, weights=w))
    sigma = max(float(np.sqrt(np.average((x - mu) ** 2, weights=w))), 0.05)
    for _ in range(rounds):
        z = (x - mu) / sigma
        tail = np.array([max(0.5 * (1 - erf(v / sqrt(2))), 1e-12) for v in z])
        hazard = np.exp(-z * z / 2) / sqrt(2 * pi) / tail
        first = np.where(censored, mu + sigma * hazard, x)
        second = np.where(censored, mu * mu + sigma * sigma + sigma * (x + mu) * hazard, x * x)
        new_mu = float(np.average(first, weights=w))
        new_sigma = float(np.sqrt(max(np.average(second, weights=w) - new_mu**2, 0.0025)))
        done = abs(new_mu - mu) + abs(new_sigma - sigma) < 1e-6
        mu, sigma = new_mu, new_sigma
        if done:
            break
    return mu, sigma


def _limits_of(histogram: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and unit with their posteriors."""
    h = histogram.sort_values("len")
    source, unit = h["source"].iloc[0], h["unit"].iloc[0]
    lengths, counts = h["len"].to_numpy(), h["n"].to_numpy()
    total = counts.sum()
    running = np.concatenate([[0], np.cumsum(counts)])
    near = (running[np.searchsorted(lengths, lengths + 25, "right")] - running[np.searchsorted(lengths, lengths - 25, "left")] - counts) / 50
    spike = (counts >= 5) & (counts >= 4 * near + 3) & (lengths >= 40) & (counts >= 0.003 * total)
    mu, sigma = censored_fit(lengths, counts, spike)
    rows = []
    for v, c in zip(lengths[spike], counts[spike]):
        z = (np.log(v) - mu) / sigma
        density = np.exp(-z * z / 2) / (v * sigma * np.sqrt(2 * np.pi))
        natural = max(density, near[lengths == v][0] / total)
        rows.append((source, unit, int(v), int(c), float((c / total) / (c / total + natural)), mu, sigma))
    return pd.DataFrame(rows, columns=["source", "unit", "limit", "n", "posterior", "mu", "sigma"])


def length_limits(texts: DataFrame) -> DataFrame:
    """(doc_id, text, source) to the candidate limits of every source."""
    sizes = {"th": F.xxhash64("text"), "chars": F.length("text").cast("long"), "bytes": F.octet_length("text").cast("long")}
    return _limits(texts.where(F.col("text").rlike(r"\S")).select(F.coalesce("source", F.lit("")).alias("source"), *[c.alias(n) for n, c in sizes.items()]))


def _limits(sized: DataFrame) -> DataFrame:
    """A group is a histogram, one row a distinct length, not the source's rows."""
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    # a text counts once, however often it is repeated
    lengths = sized.select("source", "th", "chars", "bytes").distinct().select("source", units.alias("x"))
    histogram = lengths.groupBy("source", "x.unit", "x.len").agg(F.count("*").alias("n"))
    return histogram.groupBy("source", "unit").applyInPandas(_limits_of, _LIMITS)


def _endings(texts: DataFrame) -> DataFrame:
    """The features of every text's end."""
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\s+$", "")
    base = once(
        wide_enough(texts.where(F.col("text").rlike(r"\S"))),
        "doc_id",
        source=F.coalesce("source", F.lit("")),
        chars=F.length("text").cast("long"),
        bytes=F.octet_length("text").cast("long"),
        th=F.xxhash64("text"),
        lines=F.split(body, "\n"),
    )
    last = F.element_at("lines", -1)
    above = F.coalesce(F.try_element_at("lines", F.lit(-2)), F.lit(""))
    before = F.filter(F.slice("lines", 1, F.size("lines") - 1), lambda v: F.trim(v) != "")
    return base.withColumns(
        {
            "last": F.trim(last),
            "before": F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")),
            "fences": F.size(F.filter("lines", lambda v: v.startswith("```"))),
            "sibling": F.when(above.rlike(_LIST_ITEM), F.size(F.split(F.trim(above), r"\s+"))).otherwise(0),
        }
    ).withColumns({"words": F.size(F.split("last", r"\s+")), "tail": F.lower(F.regexp_extract("last", r"([\p{L}\p{N}\-]+)[^\p{L}\p{N}]*$", 1)), "shape": _shape(F.col("last"), F.col("before"))})


def _shape(last: Column, before: Column) -> Column:
    """The last line with its variable parts left out: the middle of a link,
    names in a signature, digits of a version."""
    link = r"(https?://[^\s/]+)/\S*/([^\s/]+)/?$"
    return (
        F.when(before.rlike(_GREETING) & (F.size(F.split(last, r"\s+")) <= 3), F.concat(before, F.lit(" *")))
        .when(last.rlike(link), F.regexp_replace(last, link, "$1/*/$2"))
        .when(last.rlike(r"^(?:--|—)\s"), F.regexp_replace(last, r"\p{Lu}[\p{L}\p{N}\-]*(?:\s\p{L}[\p{L}\p{N}\-]*(?=\s))?", "*"))
        .when(last.rlike(r"^v?\d+(?:\.\d+)+$"), F.lit("0.0"))
        .otherwise(last)
    )


def _kind(last: Column) -> Column:
    return (
        F.when(last.startswith("```"), "fence")
        .when(last.startswith("|"), "table")
        .when(last.startswith("#"), "head")
        .when(last.rlike(_LIST_ITEM), "list")
        .otherwise("text")
    )


def _closing_lines(slim: DataFrame, lines: DataFrame) -> DataFrame:
    """Shapes of closing lines. ``lines`` is (th, at, line), all but the last."""
    n = slim.select("th").distinct().count()
    formulas = slim.groupBy("shape").agg(F.countDistinct("th").alias("df"), F.max("words").alias("words")).where((F.col("df") >= 3) & (F.col("df") >= FORMULA_SHARE * n))
    formulas = cut(formulas)  # at most 1/FORMULA_SHARE rows
    sizes = [r[0] for r in formulas.select("words").distinct().collect()]
    words = F.split(F.trim("line"), r"\s+")
    starts = F.transform(F.filter(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"), lambda k: k < F.size("w")), lambda k: F.array_join(F.slice("w", 1, k), " "))
    longer = (
        lines.select("th", "at", words.alias("w"))
        .select("th", "at", F.explode(starts).alias("shape"))
        .join(F.broadcast(formulas.select("shape")), "shape")
        .groupBy("shape")
        .agg(F.countDistinct("th", "at").alias("longer"))
    )
    return formulas.join(longer, "shape", "left").where(F.col("df") >= 0.25 * F.coalesce("longer", F.lit(0))).select("shape", F.lit(True).alias("closing"))


def _ending_class() -> Column:
    """The class of an open ending; null where nothing is left open."""
    last = F.col("last")
    bare = F.trim(F.regexp_replace(last, _DOTS, ""))
    shorter = F.col("words") <= 0.7 * F.col("sibling")
    closed = F.lit(None).cast("string")
    return (
        F.when(~last.rlike(r"[\p{L}\p{N}]") & (F.col("chars") < 20), closed)
        .when(last.rlike(_MARK), "mark")
        .when(F.coalesce("closing", F.lit(False)) & (F.col("kind") != "list"), closed)
        .when((F.col("fences") % 2 == 1), "fence")
        .when(F.col("kind") == "fence", closed)
        .when(F.col("kind") == "table", F.when(last.rlike(r"\|$"), closed).otherwise("table"))
        .when(last.rlike(_DOTS), F.when(bare.rlike(_SENTENCE_END), "dots_after_sentence").otherwise("dots"))
        .when(last.rlike(_SENTENCE_END), F.when((F.col("words") == 1) & last.rlike(r"^\d+\.$"), "number").otherwise(closed))
        .when(F.col("kind") == "head", "heading")
        .when((F.col("kind") == "list"), F.when(shorter, "item_shorter").when(F.col("item_ends").isNull(), "item_unlike").otherwise("item"))
        .when(last.rlike(r"(?i)(?:^|\s)(?:https?://|www\.)[^\s/]+\.\p{L}{2,}/\S+$"), "url")
        .when(last.rlike(r"(?:[:;]-?[)D(]|\p{So})$"), closed)
        .when(last.rlike(r"^v?\d+(?:\.\d+)+$"), "version")
        .when(last.rlike(r"^(?:--|—|©|\(c\))"), F.when((F.col("words") >= 3) & last.rlike(r"(?i)(?:team|authors|equipe|equipo)$"), "signature").otherwise("notice"))
        .when(last.rlike(r"^\p{Lu}\p{L}{2,15}:\s") & last.rlike(r":(?:\s[\p{L}\p{N}+#.\-]+,)*\s[\p{L}\p{N}+#.\-]+$") & last.contains(","), "fields")
        .when((F.col("words") <= 3) & F.col("before").rlike(_GREETING), "letter")
        .when(F.col("words") <= 2, "short")
        .otherwise("line")
    )


def fit_endings(counts: pd.DataFrame, rounds: int = 100) -> tuple[dict[str, float], float]:
    """Log-likelihood ratio of every class at limits and the log-odds of a cut
    away from limits, by EM. ``counts`` is (ending, odds, n): texts of an ending
    class ("" for closed ones) by their censoring log-odds, null away from
    limits. Texts at limits show how cut texts end, those away how complete
    ones do, but for the cut ones among them, which ``START`` tells apart."""
    names = ["", *START]
    at = counts["ending"].map(names.index).to_numpy(int)
    odds, n = counts["odds"].to_numpy(float), counts["n"].to_numpy(float)
    away = np.isnan(odds)
    guess = np.array([-50.0, *START.values()])
    rate, ratio = np.log(RATE / (1 - RATE)), guess.copy()
    held = np.bincount(at, weights=n * ~away, minlength=len(names))
    total = lambda q: np.bincount(at, weights=n * q, minlength=len(names)) + 0.5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.where(away, rate + guess[at], odds + ratio[at]), -500, 500)))
        cut_, whole = total(np.where(away, 0, p)), total(np.where(away, 1 - p, 0))
        seen = np.log(cut_ / cut_[1:].sum()) - np.log(whole / whole.sum())
        new = np.where(guess < -49, guess, (held * seen + GUESS * guess) / (held + GUESS))
        share = ((n * p)[away].sum() + GUESS * RATE) / (n[away].sum() + GUESS)
        moved = np.abs(new - ratio).max() + abs(np.log(share / (1 - share)) - rate)
        ratio, rate = new, float(np.log(share / (1 - share)))
        if moved < 1e-6:
            break
    return dict(zip(names[1:], ratio[1:].tolist())), rate


def truncated_texts(texts: DataFrame, *, threshold: float = 0.5, use_lengths: bool = True) -> DataFrame:
    """(doc_id, text, source) to (doc_id, source, ending, censored, p_cut,
    is_cut) for every text that is not null or blank."""
    ends = _endings(texts).withColumn("kind", _kind(F.col("last")))
    slim = cut(ends.select("doc_id", "source", "chars", "bytes", "th", "last", "before", "fences", "sibling", "shape", "words", "tail", "kind"))
    lines = ends.select("th", F.posexplode(F.slice("lines", 1, F.size("lines") - 1)).alias("at", "line")).where(F.trim("line") != "")

    # words that end list items elsewhere
    item_ends = (
        lines.where(F.col("line").rlike(_LIST_ITEM))
        .select("th", "at", F.lower(F.regexp_extract("line", r"([\p{L}\p{N}\-]+)[^\p{L}\p{N}]*$", 1)).alias("tail"))
        .groupBy("tail")
        .agg(F.countDistinct("th", "at").alias("item_ends"))
        .where("item_ends >= 2")
    )
    marked = slim.join(F.broadcast(_closing_lines(slim, lines)), "shape", "left")
    as_item = marked.where("kind = 'list'").join(item_ends, "tail", "left")
    rest = marked.where("kind != 'list'").withColumn("item_ends", F.lit(None).cast("long"))
    known = rest.unionByName(as_item.select(rest.columns)).withColumn("ending", _ending_class())

    limits = _limits(slim).where(F.col("posterior") >= 0.5 if use_lengths else F.lit(False))
    one = limits.groupBy("source").agg(F.collect_list(F.when(F.col("unit") == "chars", F.struct("limit", "posterior"))).alias("lc"), F.collect_list(F.when(F.col("unit") == "bytes", F.struct("limit", "posterior"))).alias("lb"))

    def at(limits_: str, size: Column) -> Column:
        return F.array_max(F.transform(F.filter(limits_, lambda v: v["limit"] == size), lambda v: v["posterior"]))

    posed = known.join(one, "source", "left").withColumn("censored", F.greatest(at("lc", F.col("chars")), at("lb", F.col("bytes"))))
    posed = cut(posed.select("doc_id", "source", "th", "ending", "censored", F.ln(F.col("censored") / F.greatest(1 - F.col("censored"), F.lit(1e-12))).alias("odds")))
    # a row an ending class and quarter of log-odds
    counts = posed.groupBy(F.coalesce("ending", F.lit("")).alias("ending"), (F.round(F.col("odds") * 4) / 4).alias("odds")).agg(F.countDistinct("th").alias("n")).toPandas()
    ratio, rate = fit_endings(counts)
    told = lambda of: F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("ending"))
    z = F.when(F.col("odds").isNull(), told(START) + F.lit(rate)).otherwise(told(ratio) + F.col("odds"))
    p = F.when(F.col("ending").isNull(), 0.0).otherwise(1 / (1 + F.exp(-z)))
    return posed.withColumn("p_cut", p).select("doc_id", "source", "ending", F.coalesce("censored", F.lit(0.0)).alias("censored"), "p_cut", (F.col("p_cut") > threshold).alias("is_cut"))


def truncation_rates(texts: DataFrame) -> DataFrame:
    """Texts, cut texts and the rate of every source."""
    return truncated_texts(texts).groupBy("source").agg(F.count("*").alias("textos"), F.count_if("is_cut").alias("cortados"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("taxa"))
