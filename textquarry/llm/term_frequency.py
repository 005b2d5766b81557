"""Frequency of every distinct value or term, by an external sort.

(term, record) pairs are counted inside their record first, range-partitioned
and sorted by field, term and record (Spark's sort spills to disk), and scanned
once: runs of one term give its occurrences, runs of one (term, record) its
distinct records. The record is part of the range key, so the pairs of a term
found in a third of all records spread over several partitions; each partition
emits one partial row a term, and the partial rows are added up.

Defined results: null and empty values give no term, a record without any term
does not count as a row of its field, repeated record ids count once, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.text import wide_enough
from textquarry.session import cut

_PAIRS = "campo string, termo string, id long, n long"
_RUNS = "campo string, termo string, ocorrencias long, registros long"


def _count_in_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("terms")
        at = pc.list_parent_indices(terms)
        flat = pa.table({"campo": batch.column("campo").take(at), "termo": pc.list_flatten(terms), "id": batch.column("id").take(at)})
        if flat.num_rows == 0:
            continue
        out = flat.group_by(["campo", "termo", "id"]).aggregate([([], "count_all")])
        out = out.select(["campo", "termo", "id", "count_all"]).rename_columns(["campo", "termo", "id", "n"])
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over rows sorted by (campo, termo, id); the last run of a
    batch is carried into the next one."""
    carry: list | None = None  # campo, termo, occurrences, records, last id
    schema = pa.schema([("campo", pa.string()), ("termo", pa.string()), ("ocorrencias", pa.int64()), ("registros", pa.int64())])
    for batch in batches:
        if batch.num_rows == 0:
            continue
        campo, termo = batch.column("campo"), batch.column("termo")
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        size = batch.num_rows
        same = np.zeros(size, bool)
        if size > 1:
            same[1:] = pc.and_(pc.equal(campo.slice(1), campo.slice(0, size - 1)), pc.equal(termo.slice(1), termo.slice(0, size - 1))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        fresh = np.ones(size, np.int64)
        fresh[1:] = ~(same[1:] & (ids[1:] == ids[:-1]))
        occ, rec = np.add.reduceat(n, starts), np.add.reduceat(fresh, starts)
        if carry and campo[0].as_py() == carry[0] and termo[0].as_py() == carry[1]:
            occ[0] += carry[2]
            rec[0] += carry[3] - int(ids[0] == carry[4])
        elif carry:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in carry[:4]], schema=schema)
        carry = [campo[int(starts[-1])].as_py(), termo[int(starts[-1])].as_py(), int(occ[-1]), int(rec[-1]), ids[-1]]
        if len(starts) > 1:
            head = pa.array(starts[:-1])
            yield pa.RecordBatch.from_arrays([campo.take(head), termo.take(head), pa.array(occ[:-1], pa.int64()), pa.array(rec[:-1], pa.int64())], schema=schema)
    if carry:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in carry[:4]], schema=schema)


def field_terms(table: DataFrame, fields: dict[str, Column], key: str = "id") -> DataFrame:
    """(campo, id, terms) of several fields of one table, in one scan; ``fields``
    maps a field's name to its array of terms. Rows without terms are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("campo"), v.alias("terms")) for k, v in fields.items()]))
    return wide_enough(table).select(F.col(key).cast("long").alias("id"), each.alias("x")).select("x.campo", "id", "x.terms").where(F.size("terms") > 0)


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(campo, id, terms) to (campo, termo, ocorrencias, registros)."""
    # the range sort reads its input twice, to sample it and to sort it
    pairs = cut(terms.select("campo", "id", "terms").mapInArrow(_count_in_record, _PAIRS))
    return _summed(pairs)


def _summed(pairs: DataFrame) -> DataFrame:
    ordered = pairs.repartitionByRange("campo", "termo", "id").sortWithinPartitions("campo", "termo", "id")
    runs = ordered.mapInArrow(_scan_runs, _RUNS)
    return runs.groupBy("campo", "termo").agg(F.sum("ocorrencias").alias("ocorrencias"), F.sum("registros").alias("registros"))


def marked_frequencies(terms: DataFrame, common: dict[str, float], rare_at: int = 1) -> DataFrame:
    """Frequencies with ``marca``: ``rara`` for terms in at most ``rare_at``
    records, ``comum`` for terms in at least the share ``common[campo]`` of the
    records that have any term there, else null; ``rara`` wins. The number of
    records of each field is one row a field, so its join is broadcast."""
    pairs = cut(terms.select("campo", "id", "terms").mapInArrow(_count_in_record, _PAIRS))
    totals = pairs.select("campo", "id").distinct().groupBy("campo").agg(F.count("*").alias("linhas"))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in common.items() for x in kv]), F.col("campo"))
    return (
        _summed(pairs)
        .join(F.broadcast(totals), "campo")
        .withColumn("marca", F.when(F.col("registros") <= rare_at, "rara").when(F.col("registros") >= share * F.col("linhas") - 1e-9, "comum"))
        .select("campo", "termo", "ocorrencias", "registros", "linhas", "marca")
    )
