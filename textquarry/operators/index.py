"""Inverted index: postings, positions, lexicon, lengths, statistics."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textquarry.functions.lexical import Analyzer
from textquarry.functions.stemmer import stem_vocabulary
from textquarry.operators.fields import IndexConfig, analyzed, field_view, metadata, unit_numbers, units
from textquarry.session import cut, drop_cut, ensure_checkpoint_dir, freed_shuffles, path_of, spread


def bucket_of(term: Column, partitions: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(partitions)).cast("int")


def bucket_number(term: str, partitions: int) -> int:
    """The same for a term known to the driver, for partition pruning."""
    return zlib.crc32(term.encode()) % partitions


def with_stems(rows: DataFrame, token: str = "token") -> DataFrame:
    """Replace the token column by the index term. The stemmer runs once for
    every distinct token; Spark broadcasts the vocabulary where it is small."""
    vocabulary = stem_vocabulary(rows, token)
    return rows.join(vocabulary.withColumnRenamed("token", token), token).drop(token).withColumnRenamed("stem", "term")


def occurrences(unit_rows: DataFrame) -> DataFrame:
    """(doc_id, unit_no, field, pos, token)."""
    segment = unit_rows.select("doc_id", "unit_no", F.inline_outer("segments"))
    return segment.select("doc_id", "unit_no", "field", "base", F.posexplode_outer("terms").alias("at", "token")).where("token is not null").select("doc_id", "unit_no", "field", (F.col("base") + F.col("at")).alias("pos"), "token")


@dataclass
class Index:
    """The tables of an index."""

    config: IndexConfig
    units: DataFrame  # doc_id, unit_no, unit_id, kind, len: array<int>
    postings: DataFrame  # term, unit_id, tf: array<int>
    positions: DataFrame | None  # term, unit_id, field, pos: array<int>
    lexicon: DataFrame  # term, df, cf
    documents: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what ``build`` keeps on disk."""
        for df in self.kept:
            drop_cut(df)


def build(projects: DataFrame, config: IndexConfig, analysis: DataFrame | None = None) -> Index:
    """The index of a table of projects, from their written ``analysis`` if
    there is one."""
    config.validate()
    # cut, as lengths, postings and positions each read them: the plans of the
    # later tables would hold those of the earlier ones, the stemmer's among
    # them, and the driver all of them
    made = cut(analyzed(spread(field_view(projects)), config.analyzer), free=True) if analysis is None else analysis
    rows = units(made, config)
    n = len(config.fields)
    lengths = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.aggregate(F.filter("segments", lambda s: s["field"] == f), F.lit(0), lambda a, s: a + F.size(s["terms"])))
    sized = rows.withColumn("len", lengths).select("doc_id", "unit_no", "kind", "len")
    numbered = cut(unit_numbers(rows).join(sized, ["doc_id", "unit_no"]), free=True)
    occ = occurrences(rows)
    # one row a distinct token of a unit's field before anything is joined
    packed = occ.groupBy("token", "doc_id", "unit_no", "field").agg(F.count("*").cast("int").alias("tf"), *([F.collect_list("pos").alias("pos")] if config.positions else []))
    if config.analyzer.stemming:
        packed = with_stems(packed)
    else:
        packed = packed.withColumnRenamed("token", "term")
    packed = packed.join(numbered.select("doc_id", "unit_no", "unit_id"), ["doc_id", "unit_no"])
    packed = cut(packed.select("term", "unit_id", "field", "tf", *(["pos"] if config.positions else [])), free=True)
    tf = F.array(*[F.sum(F.when(F.col("field") == i, F.col("tf")).otherwise(0)).cast("int") for i in range(n)])
    postings = cut(packed.groupBy("term", "unit_id").agg(tf.alias("tf")), free=True)
    positions = packed.groupBy("term", "unit_id", "field").agg(F.sort_array(F.flatten(F.collect_list("pos"))).alias("pos")) if config.positions else None
    total = F.aggregate("tf", F.lit(0), lambda a, x: a + x)
    lexicon = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(total).alias("cf"))
    return Index(config, numbered, postings, positions, lexicon, metadata(projects), (numbered, packed, postings, *([made] if analysis is None else [])))


def field_mask(tf: Column) -> Column:
    """1, 2, 4, 8 for the fields a posting occurs in."""
    bits = F.transform(tf, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseOR(x))


def gaps(postings: DataFrame, band: int = 1 << 16) -> DataFrame:
    """Unit numbers of every term as gaps, the first one as it is. A term's
    units are taken by bands, each with the last unit of the bands before, so
    that no task sees all postings of a frequent term."""
    keyed = postings.select("term", "unit_id", F.floor(F.col("unit_id") / band).alias("band"))
    ends = keyed.groupBy("term", "band").agg(F.max("unit_id").alias("last"))
    ends = ends.select("term", "band", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("band")).alias("before"))
    local = Window.partitionBy("term", "band").orderBy("unit_id")
    return keyed.withColumn("prior", F.lag("unit_id").over(local)).join(ends, ["term", "band"]).select("term", "unit_id", (F.col("unit_id") - F.coalesce("prior", "before")).alias("gap"))


def position_gaps(positions: DataFrame) -> DataFrame:
    """Positions of every posting as gaps, the first one as it is."""
    before = F.concat(F.array(F.lit(0)), F.slice("pos", 1, F.size("pos") - 1))
    return positions.select("term", "unit_id", "field", F.zip_with("pos", before, lambda p, q: p - q).alias("gaps"))


def vbyte_size(number: Column) -> Column:
    """Bytes of a number in the variable-byte code."""
    return F.when(number < 1 << 7, 1).when(number < 1 << 14, 2).when(number < 1 << 21, 3).when(number < 1 << 28, 4).otherwise(5)


def collection_statistics(index: Index) -> DataFrame:
    """One row of counts over the whole collection."""
    n = len(index.config.fields)
    words = index.lexicon.agg(F.count("*").alias("vocabulario"), F.sum("df").alias("postings"), F.sum("cf").alias("ocorrencias"), F.max("df").alias("maior_df"))
    sizes = index.units.agg(
        F.count("*").alias("unidades"),
        F.countDistinct("doc_id").alias("documentos"),
        *[F.sum(F.col("len")[i]).alias(f"termos_{f}") for i, f in enumerate(index.config.fields)],
        *[F.round(F.avg(F.col("len")[i]), 6).alias(f"media_{f}") for i, f in enumerate(index.config.fields)],
    )
    tfs = index.postings.agg(F.sum(F.size(F.filter("tf", lambda x: x > 0))).alias("n_tfs"))
    out = words.join(F.broadcast(sizes)).join(F.broadcast(tfs))  # one row each
    raw = 4 * (F.col("postings") + F.col("n_tfs")) + (F.col("postings") if n > 1 else F.lit(0)) + (4 * F.col("ocorrencias") if index.config.positions else F.lit(0))
    return out.withColumn("bytes_sem_compressao", raw)


def block_vocabulary(index_units: DataFrame, postings: DataFrame, block: int) -> DataFrame:
    """Distinct terms of every block of documents."""
    docs = index_units.select("unit_id", F.floor((F.col("doc_id") - 1) / block).alias("bloco"))
    return postings.select("term", "unit_id").join(docs, "unit_id").select("bloco", "term").distinct().groupBy("bloco").agg(F.count("*").alias("vocabulario"))


# --------------------------------------------------------------- on disk


BAND = 1 << 20  # units whose postings one task writes, of a bucket


def write(index: Index, path: str) -> None:
    """Tables sorted by term inside the buckets they are partitioned by, so
    that a lookup reads one bucket and skips by row-group statistics. All is
    written beside the path first, which is replaced at the end: a reader finds
    the old index or the new one, never a part."""
    spark, new = index.units.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    p = index.config.partitions
    tables = {"postings": index.postings, "lexicon": index.lexicon} | ({"positions": index.positions} if index.positions is not None else {})
    for name, df in tables.items():
        keyed = df.withColumn("bucket", bucket_of(F.col("term"), p))
        listed = name != "lexicon"
        keyed = keyed.repartition("bucket", F.floor(F.col("unit_id") / BAND)) if listed else keyed.repartition("bucket")
        with freed_shuffles(spark):
            keyed.sortWithinPartitions("bucket", "term", *(["unit_id"] if listed else [])).write.partitionBy("bucket").parquet(f"{new}/{name}")
    index.units.write.parquet(f"{new}/units")
    index.documents.write.parquet(f"{new}/documents")
    config = spark.createDataFrame([(json.dumps(asdict(index.config)),)], "config string")
    collection_statistics(open_index(spark, new, index.config)).join(F.broadcast(config)).coalesce(1).write.json(f"{new}/meta")
    fs, at = path_of(spark, path)
    _, fresh = path_of(spark, new)
    _, old = path_of(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(fresh, at):
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def open_index(spark: SparkSession, path: str, config: IndexConfig | None = None) -> Index:
    """A written index; its configuration is read back where none is given."""
    if config is None:
        kept = json.loads(spark.read.json(f"{path}/meta").first()["config"])
        config = IndexConfig(**kept | {"analyzer": Analyzer(**kept["analyzer"])})
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(config, read("units"), read("postings"), read("positions") if config.positions else None, read("lexicon"), read("documents"))


def _key(projects: DataFrame, options: object) -> str:
    """Names what is made from a table's files as they are now."""
    spark = projects.sparkSession
    marks = []
    for name in sorted(projects.inputFiles()):
        fs, at = path_of(spark, name)
        status = fs.getFileStatus(at)
        marks.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha1(repr((marks, options)).encode()).hexdigest()[:24]


def kept_analysis(projects: DataFrame, analyzer: Analyzer) -> DataFrame:
    """The analyzed fields of a table, written once in the checkpoint folder:
    indexes of any granularity are built from it."""
    spark = projects.sparkSession
    # stemming comes later, so stemmed and unstemmed indexes share it
    path = f"{ensure_checkpoint_dir(spark)}/analysis-{_key(projects, asdict(analyzer) | {'stemming': None})}"
    fs, at = path_of(spark, path)
    if not fs.exists(at):
        new = f"{path}.new-{uuid.uuid4().hex}"
        analyzed(spread(field_view(projects)), analyzer).write.parquet(new)
        fs.rename(path_of(spark, new)[1], at)
        fs.deleteOnExit(at)
    return spark.read.parquet(path)


def kept_index(projects: DataFrame, config: IndexConfig) -> Index:
    """The index of a table as written in the checkpoint folder; it is built
    where it is not there or the table's files are others."""
    spark = projects.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/index-{_key(projects, asdict(config))}"
    fs, at = path_of(spark, path)
    if not fs.exists(at):
        built = build(projects, config.validate(), kept_analysis(projects, config.analyzer))
        write(built, path)
        built.release()
        fs.deleteOnExit(at)
    return open_index(spark, path, config)


def lookup(index_table: DataFrame, term: str, partitions: int) -> DataFrame:
    """Rows of a term in a written table: one bucket is read."""
    return index_table.where((F.col("bucket") == bucket_number(term, partitions)) & (F.col("term") == term))
