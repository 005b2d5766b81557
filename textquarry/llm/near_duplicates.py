"""Near-duplicate texts with small edits (pigeonhole blocks).

Every distinct text gets a fingerprint: a string of ``SLOTS`` minimum hashes
over its word shingles. The Hamming distance of two fingerprints, the number
of slots that differ, estimates one minus the Jaccard similarity of the shingle
sets. The fingerprint is split into ``BLOCKS`` blocks. By the pigeonhole
principle two fingerprints at a distance below ``BLOCKS`` share a whole block;
farther ones share one with the probability ``1-(1-J**r)**BLOCKS`` with
``r = SLOTS/BLOCKS`` (0.9999 for J = 0.65, r = 4, 48 blocks). Texts are joined
on equal blocks, pairs beyond the Hamming limit are dropped and the rest is
verified by the exact Jaccard similarity of the shingle sets.

Disk: of the fingerprint the low byte of every slot is kept, besides the blocks
made from the whole slots. Slots that differ agree in that byte once in 256
times, so that no pair more is dropped. Blocks are shuffled a few at a time.
The members of a block are compared where they meet, with their fingerprints:
the pairs of a block, most of them texts with a phrase in common, are no table.
Shingle sets, larger than the texts that they come from, are not kept but made
again from the two texts of a pair that is left. Tables and shuffle files go as
soon as the next table stands.

Exact copies (equal shingle sets) are one class, named by the hash ``h`` of the
set, so that a class holding a third of all rows costs about one fingerprint a
partition. Blocks shared by many classes are cut into chunks, and every pair of
chunks is a group of its own.

Defined results: a null text, or one with fewer than ``min_tokens`` tokens,
takes part in no pair; of these the latter have a class by equality. Empty tables give empty results. Repeated ids of one
field collapse to one. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textquarry.functions.plan import once
from textquarry.llm.text import wide_enough, words
from textquarry.session import cut, drop_cut

SLOTS = 192
BLOCKS = 48
CHUNK = 2000
SEED = 20240607
#: Blocks shuffled at a time, and classes that a partition remembers.
BLOCKS_AT_A_TIME = 12
SEEN = 100_000
#: Fingerprints a text that are shuffled at a time for the Hamming limit.
FINGERPRINTS = 2

_SKETCH = "campo string, id long, h long, fp binary, blocks array<long>"
_JACCARD = "campo string, a long, b long, jaccard double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` consecutive tokens."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.int64).view(np.uint64)
    m = len(h) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(acc)


def set_hash(sh: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int((_mix(sh).sum(dtype=np.uint64) ^ np.uint64(len(sh))).view(np.int64))


def _sketcher(width: int, slots: int, blocks: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, slots, dtype=np.uint32)
    per = slots // blocks

    def minima(sh: np.ndarray) -> np.ndarray:
        low = np.full(slots, np.iinfo(np.uint32).max, np.uint32)
        x = (_mix(sh) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):  # bounded memory for very long texts, and in the cache
            part = np.multiply.outer(a, x[at : at + 1024])
            part += b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        with np.errstate(over="ignore"):
            for pdf in batches:
                rows = []
                for campo, id_, toks in zip(pdf["campo"], pdf["id"], pdf["toks"]):
                    sh = shingle_set(np.asarray(toks, dtype=np.int64), width)
                    if not len(sh):
                        continue
                    h = set_hash(sh)
                    if (campo, h) in seen:  # a copy: its class has its fingerprint
                        rows.append((campo, id_, h, None, None))
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((campo, h))
                    fp = minima(sh)
                    acc = np.arange(blocks, dtype=np.uint64)
                    for k in range(per):
                        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + fp[k::per][:blocks].astype(np.uint64))
                    rows.append((campo, id_, h, fp.astype(np.uint8).tobytes(), acc.view(np.int64)))
                yield pd.DataFrame(rows, columns=["campo", "id", "h", "fp", "blocks"])

    return run


def sketches(texts: DataFrame, *, width: int = 3, min_tokens: int = 25, slots: int = SLOTS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(campo, id, text) to a row each (campo, id, h, fp, blocks), cut from its
    lineage; copies met before in a partition have no fp and blocks."""
    toks = (
        once(wide_enough(texts.select("campo", "id", "text").where(F.col("text").isNotNull())), "campo", "id", w=words(F.col("text")))
        .where(F.size("w") >= min_tokens)
        .select("campo", "id", F.transform("w", lambda t: F.xxhash64(t)).alias("toks"))
    )
    return cut(toks.mapInPandas(_sketcher(width, slots, blocks, seed), _SKETCH), free=True)


def _shared_blocks(sketch: DataFrame, blocks: int = BLOCKS) -> list[DataFrame]:
    """Cut tables (key, campo, h, m) of the classes with a block in common with
    another one; every table has some of the blocks."""
    of = lambda f: F.expr(f"{f} over (partition by key, campo)")
    live = []
    for at in range(0, blocks, BLOCKS_AT_A_TIME):
        rows = sketch.where("blocks is not null").select("campo", "h", F.explode(F.slice("blocks", at + 1, BLOCKS_AT_A_TIME)).alias("key"))
        counted = rows.select("key", "campo", "h", of("count(*)").alias("m"), of("min(h)").alias("low"), of("max(h)").alias("high"))
        live.append(cut(counted.where("low < high").select("key", "campo", "h", "m").distinct(), free=True))
    return live


def _neighbours(limit: float):
    """Rows (campo, key, lo, hi, right, h, fp), sorted, to the pairs of a group
    (campo, key, lo, hi) that differ in at most ``limit`` slots: all of it where
    ``lo = hi``, else those of its two sides. One group is held at a time."""
    ones = np.uint64(0x0101010101010101)

    def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        other = np.not_equal(x, y).view(np.uint8)
        if (pad := -other.shape[1] % 8) or other.shape[1] >= 256:
            return other.sum(axis=1, dtype=np.int64) if other.shape[1] >= 256 else differing(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, pad)]), np.pad(y, ((0, 0), (0, pad))))
        return ((other.view(np.uint64).sum(axis=1, dtype=np.uint64) * ones) >> np.uint64(56)).astype(np.int64)

    def pairs(rows: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, lo, hi, right, _, fp = rows
        ends, left = starts[1:], [np.empty(0, np.int64)]
        other, starts = [np.empty(0, np.int64)], starts[:-1]
        two = starts[ends - starts == 2]
        two = two[(lo[two] == hi[two]) | (right[two] != right[two + 1])]
        two = two[differing(fp[two], fp[two + 1]) <= limit]
        left.append(two)
        other.append(two + 1)
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            cut_at = 0 if lo[s] == hi[s] else s + int((~right[s:e]).sum())
            for i in range(s, cut_at or e - 1):
                at = cut_at or i + 1
                if len(hit := at + np.flatnonzero(differing(fp[i], fp[at:e]) <= limit)):
                    left.append(np.full(len(hit), i))
                    other.append(hit)
        return np.concatenate(left), np.concatenate(other)

    def out(rows: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        a, b = pairs(rows, starts)
        ha, hb = rows[5][a], rows[5][b]
        return pa.RecordBatch.from_arrays([pa.array(rows[0][a], pa.string()), pa.array(np.minimum(ha, hb)), pa.array(np.maximum(ha, hb))], names=["campo", "ha", "hb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            *plain, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [*plain, np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:4]])
            starts = np.concatenate([[0], 1 + np.flatnonzero(new)]).astype(np.int64)
            if len(starts) > 1:
                yield out(rows, starts)
            rest = [c[starts[-1] :].copy() for c in rows]
        if rest is not None:
            yield out(rest, np.array([0, len(rest[0])], np.int64))

    return run


def _near(live: DataFrame, fps: DataFrame, chunk: int, limit: float, most: int) -> list[DataFrame]:
    """Cut tables of the pairs (campo, ha, hb) of classes that share a block and
    differ in at most ``limit`` slots. Pairs that only share a block, which grow
    with the square of the texts that hold a common phrase, are never rows.
    The blocks are taken in as many passes as keep the fingerprints in one
    at ``most``."""
    live = live.withColumn("c", F.ceil(F.col("m") / chunk).cast("int"))
    passes = max(1, -(-(live.agg(F.sum("c")).first()[0] or 0) // max(most, 1)))
    part = live.withColumn("i", F.pmod(F.xxhash64("h"), "c").cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi"), (j < F.col("i")).alias("right")))
    group, found = ("campo", "key", "lo", "hi"), []
    for k in range(passes):
        keys = part.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
        rows = keys.hint("merge").join(fps, ["campo", "h"]).select("campo", "key", "h", "fp", F.inline(ends))
        rows = rows.repartition(*group).sortWithinPartitions(*group, "right").select(*group, "right", "h", "fp")
        found.append(cut(rows.mapInArrow(_neighbours(limit), "campo string, ha long, hb long"), free=True))
    return found


def _verifier(width: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for campo, a, b, ha, hb, ta, tb in zip(*[pdf[c] for c in ("campo", "a", "b", "ha", "hb", "ta", "tb")]):
                sa, sb = (shingle_set(np.asarray(t, dtype=np.int64), width) for t in (ta, tb))
                if set_hash(sa) != ha or set_hash(sb) != hb:  # another text of a repeated id
                    continue
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if (jaccard := both / (len(sa) + len(sb) - both)) >= threshold:
                    rows.append((campo, min(a, b), max(a, b), jaccard))
            yield pd.DataFrame(rows, columns=["campo", "a", "b", "jaccard"])

    return run


def similar_classes(texts: DataFrame, *, threshold: float, width: int, min_tokens: int, hamming_share: float = 0.55, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets and the similar pairs of classes.

    Returns members (campo, id, rep) and pairs (campo, a, b, jaccard) with
    ``a < b`` representatives, both cut. ``hamming_share`` is the largest share
    of slots that may differ; at 0.55 a pair of Jaccard 0.6 is lost with a
    probability under 1e-4.
    """
    sketch = sketches(texts, width=width, min_tokens=min_tokens)
    one = sketch.groupBy("campo", "h").agg(F.min("id").alias("rep"))
    members = cut(sketch.select("campo", "h", "id").distinct().join(one, ["campo", "h"]).select("campo", "id", "rep"), free=True)
    live = _shared_blocks(sketch)
    fps = sketch.where("fp is not null").select("campo", "h", "fp").dropDuplicates(["campo", "h"])
    most = FINGERPRINTS * sketch.count()
    found = []
    for table in live:
        found += _near(table, fps, chunk, SLOTS * hamming_share, most)
        drop_cut(table)
    # fingerprints first, the far larger texts only for what is left
    rep = lambda at, name: one.select("campo", F.col("h").alias(at), F.col("rep").alias(name))
    near = cut(
        reduce(DataFrame.unionByName, found).distinct()
        .hint("merge").join(rep("ha", "a"), ["campo", "ha"])
        .hint("merge").join(rep("hb", "b"), ["campo", "hb"])
        .where("a != b"),
        free=True,
    )
    for table in (sketch, *found):
        drop_cut(table)
    whole = texts.select("campo", F.col("id").cast("long").alias("id"), "text").where(F.col("text").isNotNull())
    ends = near.select("campo", F.explode(F.array("a", "b")).alias("id"))
    whole = whole.hint("merge").join(ends, ["campo", "id"], "left_semi").distinct()
    text = lambda end: whole.select("campo", F.col("id").alias(end), F.col("text").alias(f"t{end}"))
    both = near.hint("merge").join(text("a"), ["campo", "a"]).hint("merge").join(text("b"), ["campo", "b"])
    keys = ("campo", "a", "b", "ha", "hb")
    found = once(both, *keys, ta=words(F.col("ta")), tb=words(F.col("tb"))).select(*keys, *[F.transform(t, lambda w: F.xxhash64(w)).alias(t) for t in ("ta", "tb")])
    close = cut(found.mapInPandas(_verifier(width, threshold), _JACCARD).groupBy("campo", "a", "b").agg(F.max("jaccard").alias("jaccard")), free=True)
    drop_cut(near)
    return members, close


def near_duplicate_pairs(texts: DataFrame, *, threshold: float, width: int = 3, min_tokens: int = 25, chunk: int = CHUNK) -> DataFrame:
    """All pairs of rows (campo, id_a, id_b), id_a < id_b, at the threshold.
    Classes of many rows are cut into chunks, every pair of chunks a key."""
    members, close = similar_classes(texts, threshold=threshold, width=width, min_tokens=min_tokens, chunk=chunk)
    sizes = members.groupBy("campo", "rep").agg(F.ceil(F.count("*") / chunk).cast("int").alias("c"), F.count("*").alias("m"))
    linked = close.select("campo", "a", "b").unionByName(sizes.where("m > 1").select("campo", F.col("rep").alias("a"), F.col("rep").alias("b")))
    parted = members.join(sizes.hint("merge"), ["campo", "rep"]).select("campo", "rep", "id", F.pmod(F.xxhash64("id"), "c").cast("int").alias("g"))
    parts = lambda end, at: sizes.select("campo", F.col("rep").alias(end), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias(at))
    rows = lambda end, at, name: parted.select("campo", F.col("rep").alias(end), F.col("g").alias(at), F.col("id").alias(name))
    ids = (
        linked.hint("merge").join(parts("a", "i"), ["campo", "a"])
        .hint("merge").join(parts("b", "j"), ["campo", "b"])
        .hint("merge").join(rows("a", "i", "x"), ["campo", "a", "i"])
        .hint("merge").join(rows("b", "j", "y"), ["campo", "b", "j"])
        .where("a != b or x < y")
    )
    return ids.select("campo", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of (campo, a, b): (campo, id, class_id), the least
    id of the component. Every round takes the least label of the neighbours
    and then the label's own label, so that a chain of length n ends after
    about log n rounds; each round is checkpointed."""
    both = cut(edges.select("campo", "a", "b").unionByName(edges.select("campo", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("campo", F.col("a").alias("id")).agg(F.min("b").alias("m")).select("campo", "id", F.least("id", "m").alias("c")))
    for _ in range(max_rounds):
        near = both.join(labels.select("campo", F.col("id").alias("b"), F.col("c").alias("cb")), ["campo", "b"]).groupBy("campo", F.col("a").alias("id")).agg(F.min("cb").alias("m"))
        step = labels.join(near, ["campo", "id"]).select("campo", "id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = step.join(labels.select("campo", F.col("id").alias("c"), F.col("c").alias("cc")), ["campo", "c"], "left").select("campo", "id", "old", F.least("c", F.coalesce("cc", "c")).alias("c"))
        jump = cut(jump)
        changed = jump.where("old != c").limit(1).count()
        labels = jump.select("campo", "id", "c")
        if not changed:
            return labels.withColumnRenamed("c", "class_id")
    raise RuntimeError("components did not settle")


def near_duplicate_classes(texts: DataFrame, *, threshold: float = 0.8, width: int = 5, min_tokens: int = 5) -> DataFrame:
    """One row a text (campo, id, class_id, n_links): its class and the number
    of other classes of equal texts that its own is linked to. Texts without a
    near copy form a class of their own, shorter ones a class with those of the
    same tokens; nulls are left out."""
    least = max(min_tokens, width)
    members, close = similar_classes(texts, threshold=threshold, width=width, min_tokens=least)
    degree = close.select("campo", F.explode(F.array("a", "b")).alias("rep")).groupBy("campo", "rep").agg(F.count("*").alias("n_links"))
    found = components(close)
    short = once(texts.select("campo", "id", "text").where(F.col("text").isNotNull()), "campo", "id", w=words(F.col("text"))).where(F.size("w") < least)
    short = short.select("campo", F.col("id").cast("long").alias("id"), F.array_join("w", " ").alias("tokens")).distinct()
    alone = short.join(short.groupBy("campo", "tokens").agg(F.min("id").alias("class_id")), ["campo", "tokens"]).select("campo", "id", "class_id", F.lit(0).cast("long").alias("n_links"))
    return (
        members.join(found.withColumnRenamed("id", "rep"), ["campo", "rep"], "left")
        .join(degree, ["campo", "rep"], "left")
        .select("campo", "id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        .unionByName(alone)
    )
