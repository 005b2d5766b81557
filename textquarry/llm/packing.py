"""Filling containers of fixed capacity with whole texts: harmonic packing.

For a capacity C an item of n tokens is of class k = floor(C / n): k of them
fit one container whatever their exact sizes, so a class is filled by count
alone, k items a container. Items are numbered inside their class in two
steps, per slot (a hash of the item) and then by the slots' running counts, so
that a class holding a third of all items spreads over all workers and still
leaves one partly filled container at most. Items longer than C are cut into
full containers and a rest, the only case of splitting.

Class 1, a text longer than half a container, wastes most, so it is refined:
its texts are hosts, divided by the least class j whose items fit in what they
leave free (j = ceil(C / free)), and each host takes one guest of class j or
above, largest guests and tightest hosts first. This too goes by counts only:
the numbers of hosts and guests of each class, at most the capacity of them,
give intervals of ranks that the workers apply.

The partly filled containers of all classes, fewer items than the capacity
times its logarithm, are packed again by best fit decreasing in one task a
capacity.

Defined results: texts without tokens (null, empty) are not placed; a doc_id
repeated with the same text is one item; no capacities or no texts give an
empty result. Capacities must be positive.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textquarry.llm.text import wide_enough
from textquarry.llm.tokens import token_count

MAX_CAPACITIES = 1000
_PLACED = "recipiente string, capacidade long, doc_id long, parte int, tokens long, container string"


def sized(documents: DataFrame, **tokenizer) -> DataFrame:
    """(doc_id, text) to (doc_id, tokens), one row an item with tokens."""
    counted = wide_enough(documents.select("doc_id", "text").where(F.length("text") > 0)).select("doc_id", token_count(F.col("text"), **tokenizer).alias("tokens"))
    return counted.where("tokens > 0").distinct()


def _pieces(items: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("recipiente"), F.lit(c).cast("long").alias("capacidade")) for n, c in capacities]))
    each = items.select("doc_id", "tokens", kinds.alias("r")).select("doc_id", "tokens", "r.recipiente", "r.capacidade")
    parts = each.withColumn("parte", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacidade")) - 1).cast("int"))))
    return parts.withColumn("tokens", F.least(F.col("capacidade"), F.col("tokens") - F.col("parte") * F.col("capacidade")))


def _repack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit decreasing over the rests of one capacity."""
    pdf = pdf.sort_values(["tokens", "doc_id", "parte"], ascending=[False, True, True])
    free: list[tuple[int, int]] = []
    names, opened = [], 0
    capacity = int(pdf["capacidade"].iloc[0])
    for n in pdf["tokens"]:
        at = bisect.bisect_left(free, (int(n), -1))
        if at < len(free):
            room, box = free.pop(at)
        else:
            room, box = capacity, opened
            opened += 1
        bisect.insort(free, (room - int(n), box))
        names.append(f"resto-{box}")
    return pdf.assign(container=names)[["recipiente", "capacidade", "doc_id", "parte", "tokens", "container"]]


def harmonic_packing(items: DataFrame, capacities: list[tuple[str, int]], *, slots: int | None = None) -> DataFrame:
    """(doc_id, tokens) to (recipiente, capacidade, doc_id, parte, tokens,
    container): the container of every text, or of its parts where it exceeds
    the capacity."""
    spark = items.sparkSession
    if not capacities:
        return spark.createDataFrame([], _PLACED)
    slots = slots or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    free = F.col("capacidade") - F.col("tokens")
    host = F.when(free > 0, F.ceil(F.col("capacidade") / free)).otherwise(F.col("capacidade") + 1)
    pieces = _pieces(items, capacities).withColumn("k", F.floor(F.col("capacidade") / F.col("tokens")))
    # hosts have negative classes
    pieces = pieces.withColumn("classe", F.when(F.col("k") == 1, -host).otherwise(F.col("k"))).withColumn("slot", F.pmod(F.xxhash64("doc_id", "parte"), F.lit(slots)))
    group = ["recipiente", "classe"]
    local = pieces.withColumn("r", F.row_number().over(Window.partitionBy(*group, "slot").orderBy("doc_id", "parte")))
    counts = pieces.groupBy(*group, "slot").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "slot", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(*group)).alias("total"))
    sizes = {(r["recipiente"], r["classe"]): r["m"] for r in counts.groupBy(*group).agg(F.sum("m").alias("m")).collect()}  # at most two rows a token of capacity
    rows = _hosted(sizes)
    plan = spark.createDataFrame(rows, "recipiente string, classe long, s long, e long, j long, h long").groupBy(*group).agg(F.collect_list(F.struct("s", "e", "j", "h")).alias("plano"), F.max("e").alias("dados"))
    numbered = local.join(offsets, [*group, "slot"]).withColumn("g", F.col("before") + F.col("r") - 1).join(F.broadcast(plan), group, "left").withColumn("dados", F.coalesce("dados", F.lit(0)))
    at = F.try_element_at(F.filter("plano", lambda x: (F.col("g") >= x["s"]) & (F.col("g") < x["e"])), F.lit(1))
    own, left = F.col("g") - F.col("dados"), F.col("total") - F.col("dados")
    numbered = numbered.withColumn(
        "container",
        F.when(F.col("classe") < 0, F.concat_ws("-", F.lit("h"), -F.col("classe"), "g"))
        .when(F.col("g") < F.col("dados"), F.concat_ws("-", F.lit("h"), at["j"], at["h"] + F.col("g") - at["s"]))
        .when(own < left - left % F.col("k"), F.concat_ws("-", F.lit("k"), "k", F.floor(own / F.col("k")))),
    )
    placed = ["recipiente", "capacidade", "doc_id", F.col("parte").cast("int").alias("parte"), "tokens"]
    rests = numbered.where("container is null").select(*placed).groupBy("recipiente").applyInPandas(_repack, _PLACED)
    return numbered.where("container is not null").select(*placed, "container").unionByName(rests)


def _hosted(sizes: dict[tuple[str, int], int]) -> list[tuple]:
    """Intervals (recipiente, classe, s, e, j, h): the guests of ranks s to e of
    a class go to the hosts of class j from number h on."""
    out = []
    for name in sorted({n for n, _ in sizes}):
        hosts = {-c: n for (r, c), n in sizes.items() if r == name and c < 0}
        open_: list[list[int]] = []  # [j, next host, hosts], the tightest last
        waiting = sorted(hosts)
        for q in sorted(c for r, c in sizes if r == name and c > 1):
            while waiting and waiting[0] <= q:
                j = waiting.pop(0)
                open_.append([j, 0, hosts[j]])
            start, guests = 0, sizes[name, q]
            while start < guests and open_:
                j, at, n = open_[-1]
                take = min(guests - start, n - at)
                out.append((name, q, start, start + take, j, at))
                start += take
                open_[-1][1] += take
                if open_[-1][1] == n:
                    open_.pop()
    return out


def capacities_of(table: DataFrame) -> list[tuple[str, int]]:
    """The container kinds, a table of a few rows; its size is checked."""
    rows = table.where("capacidade_tokens > 0").select("recipiente", "capacidade_tokens").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} kinds of containers")
    return sorted((r[0], int(r[1])) for r in rows)


def unused_space(placed: DataFrame) -> DataFrame:
    """Containers, tokens and the unused share of every kind."""
    boxes = placed.groupBy("recipiente", "capacidade", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return boxes.groupBy("recipiente", "capacidade").agg(
        F.count("*").alias("containers"), F.sum("n").alias("partes"), F.sum("used").alias("tokens"), F.sum(F.col("capacidade") - F.col("used")).alias("livres"), F.round(1 - F.sum("used") / F.sum("capacidade"), 6).alias("taxa_livre")
    )
