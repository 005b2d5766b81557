"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """The columns ``keep`` and the new ones ``made``, each computed once a row.

    The optimizer pushes later conditions below a projection by substituting
    its expressions, so a costly one would be evaluated again for each
    condition. It does not push them below a generator; here that yields one row
    a row and stays in the same stage."""
    row = F.struct(*[c.alias(n) for n, c in made.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("_once")).select(*keep, *[F.col("_once")[n].alias(n) for n in made])


def sums_before(counts: DataFrame, key: str, by: tuple[str, ...] = (), width: int = 4096, **sums: str) -> DataFrame:
    """(by, key, sums) with one row a whole-number key to the sums over all
    smaller keys of the same ``by``. Keys are summed up by ranges of ``width``
    first, so that the window over all ranges sees few rows."""
    wide = counts.withColumn("_wide", F.floor(F.col(key) / width))
    totals = wide.groupBy(*by, "_wide").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*by).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_wide", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_wide").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return wide.join(totals, [*by, "_wide"]).select(*by, key, *[(F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])
