"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textquarry.llm import distinctive_terms as dt
from textquarry.llm import entity_match as em
from textquarry.llm import mixing, near_duplicates as nd, packing, residue, term_frequency as tf, truncation
from textquarry.llm.text import letter_terms, list_values, wide_enough
from textquarry.llm.tokens import token_count
from textquarry.session import cut
from textquarry.sources.tables import table

#: The domains of this project's sources, for problem 7.
DOMAINS = {
    "readme_github": "paginas",
    "descricao_sourceforge": "paginas",
    "listagem": "paginas",
    "wiki": "paginas",
    "notas_versao": "paginas",
    "forum": "conversa",
    "lista_email": "conversa",
    "avaliacoes": "conversa",
    "chat": "conversa",
}
COMMON = {"readme": 0.58, "topicos": 0.30, "categorias": 0.30}


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("text")) for c in ("readme", "descricao")]))
    return table(spark, sf_dir, "projetos").select("id", "readme", "descricao").select("id", both.alias("x")).select("x.campo", "id", "x.text")


def p1_found(spark, sf_dir):
    """Edited copies: pairs with 0.6 of their distinct word triples in common."""
    return nd.near_duplicate_pairs(_long_texts(spark, sf_dir), threshold=0.6, width=3, min_tokens=25)


def p1_classes(spark, sf_dir):
    """The class of every readme and description, five words, 0.8."""
    return nd.near_duplicate_classes(_long_texts(spark, sf_dir), threshold=0.8, width=5, min_tokens=5)


def _residue_values(spark, sf_dir):
    p = table(spark, sf_dir, "projetos").select(F.lit("projetos").alias("tabela"), F.col("id").cast("string").alias("chave"), F.col("descricao").alias("valor"))
    v = table(spark, sf_dir, "visitadas").select(F.lit("visitadas").alias("tabela"), F.col("url").alias("chave"), F.col("resultado").alias("valor"))
    return p.unionByName(v).where(F.col("valor").isNotNull())


def p2_found(spark, sf_dir):
    """Values that hold template residue."""
    return residue.template_residue(_residue_values(spark, sf_dir)).select("tabela", "chave")


def p2_labels(spark, sf_dir):
    """Rows with residue by table and label."""
    return residue.template_residue(_residue_values(spark, sf_dir)).groupBy("tabela", "rotulo").agg(F.count("*").alias("linhas"), F.round(F.min("cobertura"), 4).alias("menor_cobertura"))


def _matches(spark, sf_dir):
    return em.match_entities(table(spark, sf_dir, "projetos"))


def p3_found(spark, sf_dir):
    """Pairs of one row of each site for the same project."""
    return _matches(spark, sf_dir).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def p3_matches(spark, sf_dir):
    """The pairs with their confidence."""
    return _matches(spark, sf_dir).select(F.col("a").alias("id_github"), F.col("b").alias("id_sourceforge"), F.round("confianca", 4).alias("confianca"))


def _distinctive(spark, sf_dir):
    fields = {"readme": letter_terms(F.col("readme")), "topicos": list_values(F.col("topicos"))}
    return dt.distinctive_terms(tf.field_terms(table(spark, sf_dir, "projetos").select("id", "readme", "topicos"), fields))


def p4_found(spark, sf_dir):
    """Characteristic terms: frequent in their row, rare in all rows."""
    scored = _distinctive(spark, sf_dir).where(F.col("score") > 0)
    rare = F.col("df").between(2, 8)
    return scored.where(rare & ((F.col("campo") == "topicos") | (F.col("tf") >= 4))).select("id", "campo", "termo")


def p4_scores(spark, sf_dir):
    """Every term of every row with its score."""
    return _distinctive(spark, sf_dir).select("id", "campo", "termo", "tf", "df", F.round("score", 6).alias("score"))


def p4_top_terms(spark, sf_dir):
    """The ten most characteristic terms of every row."""
    rank = Window.partitionBy("campo", "id").orderBy(F.desc("score"), "termo")
    return _distinctive(spark, sf_dir).withColumn("posto", F.row_number().over(rank)).where("posto <= 10").select("id", "campo", "posto", "termo", F.round("score", 6).alias("score"))


def _marked(spark, sf_dir):
    fields = {"readme": letter_terms(F.col("readme")), "topicos": list_values(F.col("topicos")), "categorias": list_values(F.col("categorias"))}
    return tf.marked_frequencies(tf.field_terms(table(spark, sf_dir, "projetos").select("id", *fields), fields), COMMON)


def p5_found(spark, sf_dir):
    """Terms found in one row only or in too many."""
    return _marked(spark, sf_dir).where("marca is not null").select("campo", "termo", "marca")


def p5_frequencies(spark, sf_dir):
    """Occurrences and rows of every distinct term, and its mark."""
    return _marked(spark, sf_dir).select("campo", "termo", "ocorrencias", "registros", "marca")


def _packed(spark, sf_dir):
    items = cut(packing.sized(table(spark, sf_dir, "documents")))
    return packing.harmonic_packing(items, packing.capacities_of(table(spark, sf_dir, "recipientes")))


def p6_packing(spark, sf_dir):
    """The container of every text of documents for every capacity."""
    return _packed(spark, sf_dir)


def p6_unused(spark, sf_dir):
    """Containers and unused space of every capacity."""
    return packing.unused_space(_packed(spark, sf_dir))


def _mixed(spark, sf_dir, stretch=1.0):
    docs = wide_enough(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    sized = cut(docs.select("doc_id", "source", mixing.language_of(F.col("lang")).alias("idioma"), token_count(F.col("text")).alias("tokens")).dropDuplicates(["doc_id"]))
    budgets, shares = mixing.plan_mixtures(sized, table(spark, sf_dir, "metas_mistura"), domains=DOMAINS, stretch=stretch)
    return mixing.mix_sources(sized, budgets), shares


def p7_chosen(spark, sf_dir):
    """The chosen documents of every mixture with their repetitions."""
    return _mixed(spark, sf_dir)[0].select("mistura", "doc_id", "source", "tokens", "repeticoes")


def p7_shares(spark, sf_dir):
    """Target and actual share of every source."""
    return mixing.actual_shares(*_mixed(spark, sf_dir))


def p7_short(spark, sf_dir):
    """Shares at twice the size that the caps allow: sources at their cap fall
    short and their siblings take over."""
    return mixing.actual_shares(*_mixed(spark, sf_dir, stretch=2.0))


def p7_bounds(spark, sf_dir):
    """Per mixture and source: rows chosen twice, rows beyond the cap, rows of
    no text; all 0 in a right choice."""
    chosen = _mixed(spark, sf_dir, stretch=2.0)[0]
    goals = table(spark, sf_dir, "metas_mistura").select("mistura", "source", "max_repeticoes").distinct()
    per = chosen.groupBy("mistura", "source").agg((F.count("*") - F.countDistinct("doc_id")).alias("dobrados"), F.max("repeticoes").alias("m"), F.count_if(F.col("tokens") < 1).alias("vazios"))
    joined = goals.join(per, ["mistura", "source"], "left")
    return joined.select("mistura", "source", F.coalesce("dobrados", F.lit(0)).alias("dobrados"), (F.coalesce("m", F.lit(0)) > F.col("max_repeticoes")).cast("long").alias("acima"), F.coalesce("vazios", F.lit(0)).alias("vazios"))


def p6_bounds(spark, sf_dir):
    """Per container kind: texts placed, containers above the capacity, texts
    with other tokens than they have, texts split though they fit."""
    items = cut(packing.sized(table(spark, sf_dir, "documents")))
    placed = cut(packing.harmonic_packing(items, packing.capacities_of(table(spark, sf_dir, "recipientes"))))
    boxes = placed.groupBy("recipiente", "capacidade", "container").agg(F.sum("tokens").alias("n")).groupBy("recipiente").agg(F.count_if(F.col("n") > F.col("capacidade")).alias("acima"))
    texts = placed.groupBy("recipiente", "capacidade", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("partes")).join(items, "doc_id", "left")
    whole = texts.groupBy("recipiente").agg(F.count("*").alias("textos"), F.count_if(~F.col("n").eqNullSafe(F.col("tokens"))).alias("diferentes"), F.count_if((F.col("partes") > 1) & (F.col("tokens") <= F.col("capacidade"))).alias("partidos"))
    return whole.join(boxes, "recipiente").select("recipiente", "textos", "acima", "diferentes", "partidos")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def p8_found(spark, sf_dir):
    """Documents whose text was cut off."""
    return truncation.truncated_texts(_documents(spark, sf_dir)).where("is_cut").select("doc_id")


def p8_rates(spark, sf_dir):
    """How often each source cuts."""
    return truncation.truncation_rates(_documents(spark, sf_dir))


def queries():
    return {
        f.__name__: f
        for f in (p1_found, p1_classes, p2_found, p2_labels, p3_found, p3_matches, p4_found, p4_scores, p4_top_terms, p5_found, p5_frequencies, p6_packing, p6_unused, p6_bounds, p7_chosen, p7_shares, p7_short, p7_bounds, p8_found, p8_rates)
    }
