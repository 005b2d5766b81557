"""Template residue, filler, error pages and script notices.

Labelled exemplars (``residue_exemplars``) form an inverted index from terms,
words and pairs of neighbouring words, to exemplars. A value is tokenized with
unfilled placeholders of any syntax as one term. Values holding a key term of
some exemplar are looked up; over passage windows of the exemplar's length the
TF-IDF containment, the share of the exemplar's weight that the window holds,
is computed, and values with a high-coverage window come out. Weights are
document frequencies over all values of all columns given.

The key terms of an exemplar are its heaviest terms, as many as leave less
than the threshold's weight: a window at the threshold holds one of them, so
the filter loses nothing. Exemplars and their terms are constants of the code,
which bounds everything broadcast or brought to the driver here.

Defined results: a null value is no case, nor is an empty or blank one. Values
repeated under one key give one row. Every window of a long text is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.plan import once
from textquarry.llm import residue_exemplars as ex
from textquarry.llm.text import wide_enough
from textquarry.session import cut

THRESHOLD = 0.72
SALTS = 16

_HTML = r"(?i)</?(?:p|br|h[1-6]|b|i|u|em|strong|span|div|a|ul|ol|li|img|code|pre|table|tr|td|th|tbody|thead|hr|small|sup|sub|font|center|section|article|blockquote|kbd|details|summary_|picture|source|video)(?:\s[^<>]{0,500})?/?>"
_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*"
_FIELD = rf"(?:{'|'.join(ex.FIELD_NAMES)}|[\p{{L}}]+(?:[._][\p{{L}}]+)+)"
# unmistakable syntaxes take any name, the others known or dotted ones
_MARKS = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"\$\(\s*{_NAME}\s*\)",
    rf"@@{_NAME}@@",
    r"__[\p{L}]+(?:[._][\p{L}]+)*__",
    rf"%{_NAME}%",
    rf"(?i)\{{\s*{_FIELD}\s*\}}",
    rf"(?i)\[\s*{_FIELD}\s*\](?!\()",
    rf"(?i)<\s*{_FIELD}\s*>",
    rf"(?i)(?<![\p{{L}}\p{{N}}:]):{_FIELD}:(?![\p{{L}}\p{{N}}:])",
]
_TERM = r"[\p{L}\p{N}]+"
_TAIL = r"\s*(?:\|\s*[\p{L}\p{N}]+|\(#\w+\))\s*$"


def residue_tokens(value: Column) -> Column:
    """Lower-cased words, numbers as ``0``, placeholders as one word."""
    text = F.regexp_replace(value, _HTML, " ")
    for mark in _MARKS:
        text = F.regexp_replace(text, mark, f" {ex.MARK} ")
    text = F.regexp_replace(F.regexp_replace(text, _TAIL, ""), _TAIL, "")
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), F.lit(_TERM), F.lit(0))


def _split(text: str) -> list[str]:
    return text.lower().split()


def _terms(tokens: list[str]) -> list[str]:
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


LENGTHS = {"near": 4, "run": 5, "bag": 1}


def _numbered(exemplars: list[tuple[str, str, str]]) -> list[tuple[int, str, str, list[str], int]]:
    """(number, label, scope, terms, words) of (label, scope, text)."""
    rows = []
    for n, (label, scope, text) in enumerate(exemplars):
        tokens = _split(text)
        terms = tokens if scope in LENGTHS else _terms(tokens)
        rows.append((n, label, scope, list(dict.fromkeys(terms)), LENGTHS.get(scope, len(tokens))))
    return rows


def _value_terms(tokens: Column) -> Column:
    """Structs (at, term) of the words and neighbouring pairs."""
    words = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("term")))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.transform(pairs, lambda t, i: F.struct(i.alias("at"), t.alias("term"))))


def template_residue(values: DataFrame, exemplars: list[tuple[str, str, str]] | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """(tabela, chave, valor) to (tabela, chave, rotulo, cobertura): one row a
    key with residue, its best label and that match's containment. ``exemplars``
    is the labelled table (label, scope, text), see ``residue_exemplars``."""
    spark = values.sparkSession
    rows = _numbered(ex.EXEMPLARS if exemplars is None else exemplars)
    vocabulary = sorted({t for r in rows for t in r[3]})
    texts = values.where(F.trim("valor") != "").select("tabela", "chave", "valor", F.xxhash64("valor").alias("vh"))
    # a value is looked at once, however many rows have it
    distinct = wide_enough(texts.groupBy("vh", "valor").agg(F.count("*").alias("n")))
    base = once(distinct, "vh", "n", tok=residue_tokens(F.col("valor")))
    # tokens are made once for the frequencies and the look-up
    base = cut(base.select("vh", "n", F.size("tok").alias("words"), "tok").where("words > 0"))

    # document frequencies of the index's terms over all values, one pass
    vocab = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    counted = (
        base.select("n", F.explode(F.array_distinct(F.transform(_value_terms(F.col("tok")), lambda s: s["term"]))).alias("term"))
        .join(F.broadcast(vocab), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
    )
    total = base.agg(F.lit(None).cast("string").alias("term"), F.coalesce(F.sum("n"), F.lit(0)).alias("df"))
    found = {r["term"]: r["df"] for r in counted.unionByName(total).collect()}  # at most the vocabulary
    n = found.pop(None, 0)
    idf = {t: math.log((n + 2) / (found.get(t, 0) + 1)) for t in vocabulary}

    index, info, keys = [], [], set()
    for number, _, scope, terms, words in rows:
        weights = sorted(((idf[t], t) for t in terms), reverse=True)
        mass = sum(w for w, _ in weights) or 1.0
        index += [(t, number, w / mass) for w, t in weights]
        info.append((number, scope, words))
        if scope == "near":
            continue
        rest = mass if scope in ("part", "whole") else float("inf")
        for w, t in weights:
            if rest < threshold * mass:
                break
            keys.add(t)
            rest -= w
    index_df = spark.createDataFrame(index, "term string, e int, share double")
    info_df = spark.createDataFrame(info, "e int, scope string, len int")
    hits = (
        once(base, "vh", "words", terms=_value_terms(F.col("tok")))
        .where(F.arrays_overlap(F.transform("terms", lambda s: s["term"]), F.array(*[F.lit(k) for k in sorted(keys)])))
        .select("vh", "words", F.inline_outer("terms"))
        .join(F.broadcast(index_df), "term")
        .join(F.broadcast(info_df), "e")
        # every stretch of one length lies in one of the half-overlapping windows of two
        .withColumn("span", F.when(F.col("scope") == "bag", F.lit(1 << 30)).otherwise(F.col("len") + 1))
        .withColumn("w", F.explode(F.array(F.floor(F.col("at") / F.col("span")), F.floor(F.col("at") / F.col("span")) - 1)))
        .where("w >= 0 or at < span")
    )
    bags = hits.where("scope = 'bag' and w = 0 and instr(term, ' ') = 0").groupBy("vh", "e").agg(
        F.lit("bag").alias("scope"), (F.count("*") / F.first("words")).alias("cover")
    )
    windows = (
        hits.where("scope != 'bag'")
        .groupBy("vh", "e", "scope", "w")
        .agg(F.first("words").alias("words"), F.first("len").alias("len"), F.first("span").alias("span"), F.collect_list(F.struct("at", "term", "share")).alias("h"))
    )

    def held(h: Column, start: Column, span: Column, value) -> Column:
        inside = F.filter(h, lambda x: (x["at"] >= start) & (x["at"] < start + span))
        distinct = F.array_distinct(F.transform(inside, lambda x: F.struct(x["term"], value(x).alias("v"))))
        return F.aggregate(distinct, F.lit(0.0), lambda acc, x: acc + x["v"])

    best = F.array_max(F.transform("h", lambda s: held(F.col("h"), s["at"], F.col("span"), lambda x: x["share"])))
    run = F.array_max(F.transform("h", lambda s: F.size(F.filter("h", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + 5))).cast("double") / 5))
    slack = F.when(F.col("len") <= 2, 0).otherwise(2)
    scored = windows.select("vh", "e", "scope", F.when(F.col("scope") == "run", run).otherwise(best).alias("cover"), (F.col("words") <= F.col("len") + slack).alias("fits"), "words")
    kept = scored.where(
        ((F.col("scope") == "part") & (F.col("cover") >= threshold))
        | ((F.col("scope") == "whole") & F.col("fits") & (F.col("cover") >= threshold))
        | ((F.col("scope") == "run") & ((F.col("cover") >= 0.8) | (F.col("cover") * 5 >= F.col("words"))))
        | ((F.col("scope") == "near") & (F.col("cover") > 0.99))
    ).select("vh", "e", "scope", "cover")
    kept = kept.unionByName(bags.where("cover >= 0.999"))
    names = F.element_at(F.create_map(*[F.lit(x) for r in rows for x in r[:2]]), F.col("e"))
    told = kept.withColumn("rotulo", names)
    # a placeholder counts unless a negative exemplar speaks of placeholders
    plain = F.when((F.col("scope") != "near") & (F.col("rotulo") != "marcador"), F.col("cover"))
    found_values = (
        told.groupBy("vh")
        .agg(F.max(F.col("scope") == "near").alias("about"), F.max_by("rotulo", plain).alias("other"), F.max(plain).alias("cover"), F.max(F.col("rotulo") == "marcador").alias("marked"))
        .where("cover is not null or (marked and not about)")
        .select("vh", F.when(F.col("marked") & ~F.col("about"), "marcador").otherwise(F.col("other")).alias("rotulo"), F.coalesce("cover", F.lit(1.0)).alias("cobertura"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    # rows of one frequent value are spread over the salts
    keyed = texts.select("tabela", "chave", "vh", F.pmod(F.xxhash64("chave"), F.lit(SALTS)).cast("int").alias("salt"))
    return keyed.join(found_values.hint("merge"), ["vh", "salt"]).groupBy("tabela", "chave").agg(F.min("rotulo").alias("rotulo"), F.max("cobertura").alias("cobertura"))
