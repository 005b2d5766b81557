"""Field view, document metadata and index units."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.functions.lexical import FIELDS, Analyzer
from textquarry.functions.plan import once, sums_before

SNIPPET = 300
FIELD_GAP = 100
#: Keys of a document that are kept beside the index, where they hold a value.
METADATA = (
    "site", "url", "nome", "dono", "linguagem", "estrelas", "forks", "licenca", "topicos", "categorias",
    "downloads_semana", "nota", "num_avaliacoes", "ultima_atualizacao", "coletado_em",
)


@dataclass(frozen=True)
class IndexConfig:
    """Options of an index; see ``validate`` for what is refused."""

    granularity: str = "campo"  # documento, campo or chunk
    chunk: int = 256
    overlap: int = 0
    positions: bool = True
    partitions: int = 16
    block: int = 10_000
    analyzer: Analyzer = field(default_factory=Analyzer)

    def validate(self) -> "IndexConfig":
        if self.granularity not in ("documento", "campo", "chunk"):
            raise ValueError(f"unknown granularity: {self.granularity}")
        if self.granularity == "chunk" and not 0 <= self.overlap < self.chunk:
            raise ValueError("the overlap must be smaller than the chunk")
        if self.partitions < 1 or self.block < 1 or self.chunk < 1:
            raise ValueError("partitions, block and chunk must be positive")
        return self

    @property
    def fields(self) -> tuple[str, ...]:
        return FIELDS if self.granularity == "campo" else ("texto",)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" . ", *parts)


def _known(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def field_view(projects: DataFrame) -> DataFrame:
    """The four text fields of every project; doc_id is its id."""
    return projects.select(
        F.col("id").alias("doc_id"),
        "site",
        _joined(_known("nome"), _known("dono")).alias("nome"),
        _joined(_known("descricao"), _known("resumo")).alias("descricao"),
        _joined(F.col("topicos"), F.col("categorias"), _known("linguagem")).alias("rotulos"),
        F.coalesce("readme", F.lit("")).alias("readme"),
    )


def metadata(projects: DataFrame) -> DataFrame:
    """Metadata of every document: null, empty texts and empty lists are absent,
    zeros stay; with a snippet of the description or the summary."""
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) if dict(projects.dtypes)[c] == "string" else F.when(F.size(c) > 0, F.col(c)).alias(c) if dict(projects.dtypes)[c].startswith("array") else F.col(c) for c in METADATA]
    text = F.coalesce(_known("descricao"), _known("resumo"))
    return projects.select(F.col("id").alias("doc_id"), *kept, F.substring(text, 1, SNIPPET).alias("trecho"))


def analyzed(fields_: DataFrame, analyzer: Analyzer) -> DataFrame:
    """The fields as arrays of unstemmed terms."""
    return once(fields_, "doc_id", "site", **{f: analyzer.terms(F.col(f), f) for f in FIELDS})


def _segment(number: int, terms: Column, base: Column) -> Column:
    return F.struct(F.lit(number).alias("field"), terms.alias("terms"), base.cast("int").alias("base"))


def _gapped(names: tuple[str, ...]) -> Column:
    """The fields one after another in one text field, gaps between them."""
    out, base = [], F.lit(0)
    for name in names:
        out.append(_segment(0, F.col(name), base))
        base = base + F.size(name) + FIELD_GAP
    return F.array(*out)


def units(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(doc_id, unit_no, kind, segments): what a posting points at. A chunk's
    positions count from the start of the whole readme."""
    config.validate()
    if config.granularity == "campo":
        return docs.select("doc_id", F.lit(0).alias("unit_no"), F.lit("campo").alias("kind"), F.array(*[_segment(i, F.col(f), F.lit(0)) for i, f in enumerate(FIELDS)]).alias("segments"))
    if config.granularity == "documento":
        return docs.select("doc_id", F.lit(0).alias("unit_no"), F.lit("documento").alias("kind"), _gapped(FIELDS).alias("segments"))
    step = config.chunk - config.overlap
    size = F.size("readme")
    count = F.when(size == 0, 0).otherwise(1 + F.ceil(F.greatest(size - config.chunk, F.lit(0)) / step)).cast("int")
    header = F.struct(F.lit("cabecalho").alias("kind"), _gapped(FIELDS[:3]).alias("segments"))
    windows = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("chunk").alias("kind"), F.array(_segment(0, F.slice("readme", i * step + 1, F.lit(config.chunk)), i * step)).alias("segments")),
    )
    return docs.select("doc_id", F.posexplode(F.concat(F.array(header), windows)).alias("unit_no", "u")).select("doc_id", "unit_no", "u.kind", "u.segments")


def unit_numbers(unit_rows: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, unit_no, unit_id) with dense numbers in document order. Units
    are counted by ranges of ids, the counts are summed up, and only the units
    of one range are numbered together, so no task sees all of them."""
    keyed = unit_rows.select("doc_id", "unit_no", F.floor(F.col("doc_id") / width).alias("range"))
    starts = sums_before(keyed.groupBy("range").agg(F.count("*").alias("n")), "range", start="n")
    local = Window.partitionBy("range").orderBy("doc_id", "unit_no")
    return keyed.withColumn("at", F.row_number().over(local) - 1).join(starts, "range").select("doc_id", "unit_no", (F.col("start") + F.col("at")).alias("unit_id"))
