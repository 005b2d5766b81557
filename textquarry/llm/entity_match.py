"""Matching entities across two sources without a common key.

The record-attribute-token graph: a record leads through its name to character
trigrams of the joined, lower-cased name, so that separators and capitals do
not count, through its description to words and neighbouring pairs, and through
both to links: its whole name or initials, and names of other records met in
the description. Only tokens of both sites count. They weigh by inverse
document frequency, those of a description also by how early they stand.

1. Random walks, record to token to another record of the token, give the
   sentences on which skip-gram vectors of the tokens are trained. Tokens are
   hashed into ``VOCABULARY`` buckets, so the model's size is bounded however
   large the collection is.
2. Blocking by multi-table hyperplane hashing. A description of one site is a
   line and of the other a page, so that vectors of whole records of a true
   pair stand 60 degrees apart and more, and hyperplanes alone would meet in
   too few tables. In each table a record therefore takes a short walk
   (``WALKS``): two name tokens and one of the description, or one link or rare
   word and one of the description, drawn by weight and, being seeded by table
   and token only, alike for records that share tokens. A walk whose tokens
   together are not rare enough (the sum of their weights is below the logarithm
   of the number of records) goes on to further words, so that a name or text of
   a third of all records fills no block. The signs of the walk's
   summed vectors against the table's hyperplanes, ``hyperplanes(n)`` of them,
   are the key; records of the two sites with an equal key are candidates.
3. Candidates with a like name or a link are ranked again exactly: letter pairs
   and weighted cosine of the names, weighted containment of the descriptions
   in each other, the heaviest shared link, cosine of the records' vectors, and
   how many records go the same ways (boilerplate is a crowd).
4. The scores are calibrated to a confidence by a logistic curve over them and
   their products, fitted on a bounded sample of candidates
   (``CALIBRATION_ROWS``). The labels are noisy, agreement of language and
   licence; how often matches fail it and others meet it is fitted along. They
   are no part of the score, and the rule is one for every size of input.

Records of equal name and description are one until the end, so that a page
collected again costs nothing; each of its rows is matched.

Defined results: records without a name or description take part in no pair; a
null language or licence says nothing; tables with one site only give no pair;
extra columns are ignored; a repeated id is one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.functions.plan import once
from textquarry.llm.text import wide_enough
from textquarry.session import cut

VOCABULARY = 1 << 15
DIMENSIONS = 32
WALKS_A_TASK = 20_000
CHUNK = 2000
HEAVY = 2000
SEED = 11
RARE = 5
NAME_RUN = 3
CALIBRATION_ROWS = 24_000
LEAST_NAME = 0.4


def name_key(nome: Column) -> Column:
    """The letters and digits of a name, lower-cased and joined."""
    return F.lower(F.regexp_replace(nome, r"[^\p{L}\p{N}]+", ""))


def initials(nome: Column) -> Column:
    """The first letters of a name's parts, where it has two or more."""
    parts = F.regexp_extract_all(F.regexp_replace(nome, r"(\p{Ll})(\p{Lu})", "$1 $2"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.size(parts) > 1, F.lower(F.array_join(F.transform(parts, lambda v: F.substring(v, 1, 1)), "")))


def licence_family(licenca: Column) -> Column:
    text = F.lower(licenca)
    return (
        F.when(text.rlike(r"lgpl|lesser"), "lgpl")
        .when(text.rlike(r"agpl|affero"), "agpl")
        .when(text.rlike(r"gpl-?3|general public.*3"), "gpl3")
        .when(text.rlike(r"gpl-?2|general public.*2"), "gpl2")
        .when(text.rlike(r"apache"), "apache")
        .when(text.rlike(r"\bmit\b"), "mit")
        .when(text.rlike(r"mozilla|\bmpl"), "mpl")
        .when(text.rlike(r"\bbsd"), "bsd")
    )


def records(table: DataFrame) -> DataFrame:
    """(id, site, nome, descricao, linguagem, licenca) to a record with its
    name key and its tokens: trigrams of the name, words and pairs of the
    description, and links, words that can stand in both attributes."""
    key = name_key(F.col("nome"))
    words = F.regexp_extract_all(F.lower("descricao"), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0))
    plain = F.regexp_extract_all(F.lower("descricao"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # the record's own name says nothing new where its description repeats it
    words = F.filter(words, lambda w: (F.length(w) < 3) | ~F.contains(key, w))
    base = table.select(F.col("id").cast("long").alias("id"), "site", "nome", "descricao", "linguagem", "licenca")
    base = once(wide_enough(base.dropDuplicates(["id"])), "id", "site", nk=key, ini=initials(F.col("nome")), dw=words, pw=plain, lg=F.lower(F.trim("linguagem")), lc=licence_family(F.col("licenca")))
    base = base.where((F.length("nk") > 0) & (F.size("dw") > 0) & F.col("site").isNotNull())
    padded = F.concat(F.lit("^"), F.col("nk"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    pairs = F.zip_with(F.slice("dw", 1, F.greatest(F.size("dw") - 1, F.lit(0))), F.slice("dw", 2, F.greatest(F.size("dw") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.size("pw") - 1), lambda i, n=n: F.array_join(F.slice("pw", i + 1, F.lit(n)), "")) for n in range(1, NAME_RUN + 1)]))
    met = F.filter(F.when(F.size("pw") > 0, runs), lambda v: (F.length(v) >= 6) & (v != F.col("nk")))
    short = F.when(F.length("nk").between(2, 5), F.col("nk"))
    # a name and the same name met in a description are one token, a name of
    # initials and the initials of a name another
    abbreviated = F.when(F.coalesce("ini", short).isNotNull(), F.xxhash64(F.lit("i"), F.coalesce("ini", short)))
    named = F.filter(F.array(F.xxhash64(F.lit("m"), "nk"), abbreviated), lambda v: v.isNotNull())
    links = F.concat(named, F.transform(F.coalesce(met, F.array()), lambda v: F.xxhash64(F.lit("m"), v)))
    return base.select(
        "id", "site", "nk", "ini", "lg", "lc", F.array_distinct(links).alias("lt"),
        F.transform(F.array_distinct(grams), lambda t: F.xxhash64(F.lit("n"), t)).alias("nt"),
        F.transform(F.concat("dw", pairs), lambda t: F.xxhash64(F.lit("d"), t)).alias("dt"),
        F.size("dw").alias("dn"), F.size(named).alias("ln"),
    )


def distinct_records(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of equal name and description as one, with the least id, and
    (rep, id) of all; a page collected a thousand times is matched once."""
    kind = ["site", "nk", "h1", "h2"]
    tagged = recs.withColumns({"h1": F.xxhash64("dt", "ini", "lt"), "h2": F.xxhash64(F.lit(1), "dn", "dt", "nt")})
    one = tagged.groupBy(*kind).agg(F.min("id").alias("rep"), F.max("lg").alias("lg"), F.max("lc").alias("lc"))
    members = tagged.select("id", *kind).join(one.select("rep", *kind), kind).select("rep", "id")
    reps = recs.drop("lg", "lc").join(one.select(F.col("rep").alias("id"), "lg", "lc"), "id")
    return cut(reps), members


def weigh(recs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct tokens of every record with their weights; ``a`` is 0 for the
    name, 1 for the description, 2 for links. Tokens of one site only cannot
    link the sites and get no weight. The heavy tokens, those of a share of
    1/HEAVY of all (record, token) pairs at least, are at most HEAVY and are
    broadcast; the rest is joined by a shuffle."""
    part = lambda a, c, p, u: F.transform(c, lambda t, i: F.struct(F.lit(a).alias("a"), t.alias("t"), p(i).cast("int").alias("p"), u(i).alias("u")))
    place = part(1, F.col("dt"), lambda i: F.when(i < F.col("dn"), i).otherwise(i - F.col("dn")), lambda i: i < F.col("dn"))
    rows = F.concat(part(0, F.col("nt"), lambda i: F.lit(0), lambda i: F.lit(False)), place, part(2, F.col("lt"), lambda i: F.lit(0), lambda i: i < F.col("ln")))
    links = recs.where(F.col("site").isin(left, right)).select("id", "site", F.explode(rows).alias("x")).select("id", "site", "x.a", "x.t", "x.p", "x.u")
    links = cut(links.groupBy("id", "site", "a", "t").agg(F.min("p").alias("p"), F.max("u").alias("u")))
    df = links.groupBy("t").agg(F.count("*").alias("df"), F.count_if(F.col("site") == left).alias("dl"), F.max((F.col("a") < 2) | F.col("u")).alias("own"))
    df = df.where("dl > 0 and df > dl and own").select("t", "df")  # a link is somebody's name
    n, floor = max(recs.count(), 1), max(links.count() / HEAVY, 1)
    hot = F.broadcast(df.where(F.col("df") >= floor).withColumnRenamed("df", "hot"))
    tagged = links.join(hot, "t", "left")
    cold = tagged.where("hot is null").drop("hot").join(df.where(F.col("df") < floor).hint("merge"), "t").select("id", "a", "t", "p", "u", "df")
    both = tagged.where("hot is not null").select("id", "a", "t", "p", "u", F.col("hot").alias("df")).unionByName(cold)
    idf = F.ln((F.lit(n) + 1.0) / F.col("df"))
    near = F.when(F.col("a") == 1, 1.0 / (1.0 + F.col("p") / 12.0)).otherwise(1.0)
    power = F.when(F.col("a") == 0, 2.0).otherwise(2.5)
    rare = F.col("u") & (F.col("a") == 1) & (F.col("df") <= RARE)
    return both.select("id", "a", "t", idf.alias("w"), (F.greatest(idf, F.lit(0.0)) ** power * near).alias("s"), rare.alias("rare")).where("w > 0")


def walks(profile: DataFrame, hops: int = 2, ring: int = 64) -> DataFrame:
    """Sentences of random walks: tokens of a record, a token it shares, and
    tokens of the next record of that token. The records that a token leads to
    stand in rings of about ``ring``, so that every record is reached once a
    step however frequent the token is."""
    steps = profile.select("id", "sample", F.explode(F.array_distinct(F.slice("sample", 1, hops))).alias("t"))
    sizes = steps.groupBy("t").agg(F.count("*").alias("m")).where("m > 1")
    # a token's rings are keys of their own, salted by the record
    placed = steps.join(sizes.hint("merge"), "t").withColumn("g", F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("m") / ring).cast("long")))
    order = Window.partitionBy("t", "g").orderBy(F.xxhash64("id", F.lit(6)), "id")
    ends = placed.withColumn("other", F.lead("sample").over(order)).where("other is not null")
    hashed = F.transform(F.concat("sample", F.array("t"), "other"), lambda t: F.pmod(t, F.lit(VOCABULARY)).cast("string"))
    return ends.select(hashed.alias("walk"))


def token_vectors(walks: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Unit skip-gram vectors of the token buckets, VOCABULARY x dimensions."""
    from pyspark.ml.feature import Word2Vec

    rng = np.random.default_rng(seed)
    table = rng.standard_normal((VOCABULARY, dimensions))
    n = walks.count()
    if n:
        parts = -(-n // WALKS_A_TASK)
        model = Word2Vec(vectorSize=dimensions, minCount=1, maxIter=1, numPartitions=parts, windowSize=4, seed=seed, inputCol="walk", outputCol="v", maxSentenceLength=100).fit(walks)
        for word, vector in model.getVectors().toLocalIterator():  # at most VOCABULARY rows
            table[int(word)] = np.asarray(vector.toArray() if hasattr(vector, "toArray") else vector)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm == 0, 1, norm)).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(tokens: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Weighted consistent choice: for each seed the index of one token."""
    with np.errstate(over="ignore"):
        h = _mix(tokens.view(np.uint64)[None, :] ^ _mix(seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.argmin(-np.log(u) / weights[None, :], axis=1)


def _sampler(per_record: int):
    @F.pandas_udf("array<long>")
    def sample(tokens: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(tokens, weights):
            t, w = np.asarray(t, np.int64), np.asarray(w, float)
            out.append(t[_draw(t, w, np.arange(per_record) + 900_001)])
        return pd.Series(out, dtype=object)

    return sample


def hyperplanes(n: int) -> int:
    """Signs of a key: enough that of ``n`` records few other walks meet."""
    return min(60, 2 * math.ceil(math.log2(max(n, 2))) + 8)


#: The walks of a table: which tokens each step goes to (n name, d
#: description, l link), and the number of tables. The last kind tells only how
#: many records go the same way.
WALKS = {"nnd": 56, "ld": 32}
CROWD = {"ddd": 8}
SLICE = 512
MORE = 4


def _hasher(vectors: np.ndarray, bits: int, seed: int, least: float):
    kinds = [k for kinds in (WALKS, CROWD) for k, n in kinds.items() for _ in range(n)]
    planes = np.random.default_rng(seed + 1).standard_normal((len(kinds), vectors.shape[1], bits)).astype(np.float32)
    walks_ = np.arange(len(kinds)) < sum(WALKS.values())
    # for every sort of token: the seeds of its draws by table, the tables, where each one's draws begin
    draws = {}
    for c in "ndl":
        wanted = [(t, i) for t, k in enumerate(kinds) for i, x in enumerate(k) if x == c]
        tables, first = np.unique([t for t, _ in wanted], return_index=True)
        draws[c] = np.array([t * 8 + i for t, i in wanted], np.int64), tables, first

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                pdf = batch.iloc[at : at + SLICE]
                total = np.zeros((len(kinds), len(pdf), vectors.shape[1]), np.float32)
                known = np.ones((len(kinds), len(pdf)), bool)
                for r, row in enumerate(zip(*[pdf[c + x] for c in "ndl" for x in ("t", "w", "v")])):
                    told, seen = np.zeros(len(kinds)), []
                    for (c, (seeds, tables, first)), tokens, weights, idf in zip(draws.items(), row[::3], row[1::3], row[2::3]):
                        if not len(tokens):  # no token of this sort is known on the other site
                            known[tables, r] = False
                            continue
                        tokens, idf = np.asarray(tokens, np.int64), np.asarray(idf, float)
                        at_ = _draw(tokens, np.asarray(weights, float), seeds)
                        total[tables, r] += np.add.reduceat(vectors[tokens[at_] % VOCABULARY], first)
                        told[tables] += np.add.reduceat(idf[at_], first)
                        if c == "d":
                            last = np.full(len(kinds), -1)
                            last[tables] = at_[first]
                            seen.append(last)
                    # a walk that many records take goes on in the description
                    tokens, weights, idf = (np.asarray(v) for v in row[3:6])
                    for step in range(MORE):
                        short = np.flatnonzero((told < least) & known[:, r] & walks_)
                        if not len(short):
                            break
                        at_ = _draw(tokens.astype(np.int64), weights.astype(float), short * 8 + 4 + step)
                        fresh = np.all([s_[short] != at_ for s_ in seen], axis=0)
                        total[short, r] += vectors[tokens[at_] % VOCABULARY]
                        told[short] += np.where(fresh, idf[at_], 0.0)
                        now = np.full(len(kinds), -1)
                        now[short] = at_
                        seen.append(now)
                signs = np.zeros((len(kinds), len(pdf), 64), bool)
                signs[:, :, :bits] = np.matmul(total, planes) > 0
                keys = np.packbits(signs, axis=2, bitorder="little").view(np.int64)[:, :, 0]
                tables, rows = np.nonzero(known)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "is_a": pdf["is_a"].to_numpy()[rows], "tb": tables.astype(np.int32), "key": keys[tables, rows]})

    return run


def _candidates(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of the two sites with an equal key in some table. Keys of
    many records are cut into chunks, every pair of chunks a join key."""
    counts = rows.groupBy("tb", "key").agg(F.count_if("is_a").alias("ma"), F.count_if(~F.col("is_a")).alias("mb")).where("ma > 0 and mb > 0")
    counts = counts.select("tb", "key", F.ceil(F.col("ma") / chunk).cast("long").alias("ca"), F.ceil(F.col("mb") / chunk).cast("long").alias("cb"))
    live = rows.join(counts.hint("merge"), ["tb", "key"])
    a = live.where("is_a").select("tb", "key", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), "ca").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb") - 1)).alias("j"))
    b = live.where("not is_a").select("tb", "key", F.col("id").alias("b"), F.pmod(F.xxhash64("id"), "cb").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ca") - 1)).alias("i"))
    return a.hint("merge").join(b, ["tb", "key", "i", "j"]).select("a", "b").distinct()


def _name_dice(x: pd.Series, y: pd.Series) -> pd.Series:
    """Dice coefficient of the letter pairs of two name keys; at least 0.75
    where one is an abbreviation, its letters in order and the first three
    equal."""

    def shortened(s: str, t: str) -> bool:
        short, long = sorted((s, t), key=len)
        rest = iter(long)
        return len(short) >= 4 and short[:3] == long[:3] and all(c in rest for c in short)

    def grams(s: str) -> set:
        s = f"^{s}$"
        return {s[i : i + 2] for i in range(len(s) - 1)}

    out = []
    for s, t in zip(x, y):
        p, q = grams(s), grams(t)
        dice = 2 * len(p & q) / (len(p) + len(q))
        out.append(max(dice, 0.75) if dice < 0.75 and shortened(s, t) else dice)
    return pd.Series(out, dtype=float)


def _shared(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> tuple[np.ndarray, ...]:
    """Per pair of rows of sorted tokens with weights: the product sum of the
    shared ones, the sums of both sides' weights of them, the largest, and the
    sums and square sums of all weights of both sides."""
    n = len(ta)

    def flat(t, w):
        size = np.array([len(v) for v in t])
        row = np.repeat(np.arange(n), size)
        tokens = np.concatenate(t.to_list() or [[]]).astype(np.int64).view(np.uint64) if size.sum() else np.empty(0, np.uint64)
        weights = np.concatenate(w.to_list() or [[]]).astype(float) if size.sum() else np.empty(0)
        with np.errstate(over="ignore"):
            return row, tokens ^ _mix(row.astype(np.uint64) + np.uint64(1)), weights

    ra, ka, va = flat(ta, wa)
    rb, kb, vb = flat(tb, wb)
    order = np.argsort(kb)
    at = np.searchsorted(kb, ka, sorter=order)
    at = order[np.minimum(at, max(len(order) - 1, 0))] if len(order) else np.zeros(len(ka), int)
    hit = (kb[at] == ka) if len(order) else np.zeros(len(ka), bool)
    row, x = ra[hit], va[hit]
    y = vb[at[hit]] if len(order) else x
    add = lambda r, v: np.bincount(r, weights=v, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, x)
    return add(row, x * y), add(row, x), add(row, y), top, add(ra, va), add(rb, vb), add(ra, va**2), add(rb, vb**2)


_FEATURES = "name double, back double, fore double, shared double, link double, vec double"


def _exact(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series, na: pd.Series, va: pd.Series, nb: pd.Series, vb: pd.Series, la: pd.Series, ua: pd.Series, lb: pd.Series, ub: pd.Series, ea: pd.Series, eb: pd.Series) -> pd.DataFrame:
    """Weighted cosine of the names, weighted containment of each description
    in the other one, the weight shared, the heaviest shared link, cosine of
    the records' vectors."""
    dot, *_, p, q = _shared(na, va, nb, vb)
    _, x, y, _, sx, sy, _, _ = _shared(ta, wa, tb, wb)
    link = _shared(la, ua, lb, ub)[3]
    vec = [float(np.dot(e, f)) for e, f in zip(ea, eb)]
    return pd.DataFrame({"name": dot / np.maximum(np.sqrt(p * q), 1e-9), "back": x / np.maximum(sx, 1e-9), "fore": y / np.maximum(sy, 1e-9), "shared": x, "link": link, "vec": vec})


def _embedder(vectors: np.ndarray):
    @F.pandas_udf("array<float>")
    def embed(nt: pd.Series, nw: pd.Series, dt: pd.Series, dw: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(nt, nw, dt, dw):
            x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
            v = (vectors[np.asarray(a, np.int64) % VOCABULARY] * (x / max(x.sum(), 1e-9))[:, None]).sum(0) + (vectors[np.asarray(b, np.int64) % VOCABULARY] * (y / max(y.sum(), 1e-9))[:, None]).sum(0)
            out.append(v / max(float(np.linalg.norm(v)), 1e-9))
        return pd.Series(out, dtype=object)

    return embed


def candidates(reps: DataFrame, left: str, right: str, *, seed: int = SEED, vectors: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, pairs (a, b) that meet in some table, and (id, crowd): how
    many records, by the mean logarithm over tables, go a record's ways."""
    weighted = weigh(reps, left, right)
    by = lambda a, c: F.transform(F.array_sort(F.filter("x", lambda s: s["a"] == a)), lambda s: s[c])
    linking = F.filter("x", lambda s: (s["a"] == 2) | s["rare"])
    profile = (
        weighted.groupBy("id")
        .agg(F.collect_list(F.struct("a", "t", "w", "s", "rare")).alias("x"))
        .select("id", by(0, "t").alias("nt"), by(0, "w").alias("nv"), by(0, "s").alias("nw"), by(1, "t").alias("dt"), by(1, "w").alias("dv"), by(1, "s").alias("dw"),
                F.transform(linking, lambda s: s["t"]).alias("lt"), F.transform(linking, lambda s: s["w"]).alias("lv"), F.transform(linking, lambda s: s["w"] ** 2.5).alias("lw"))
        .where("size(dt) > 0")
        .join(reps.select("id", (F.col("site") == left).alias("is_a"), "nk", "lg", "lc"), "id")
    )
    profile = cut(profile.withColumn("sample", _sampler(6)(F.concat("nt", "dt", "lt"), F.concat("nw", "dw", "lw"))))
    vectors = token_vectors(walks(profile), seed=seed) if vectors is None else vectors
    n = profile.count()
    keys = profile.select("id", "is_a", *[c + x for c in "ndl" for x in ("t", "w", "v")]).mapInPandas(_hasher(vectors, hyperplanes(n), seed, math.log(max(n, 2))), "id long, is_a boolean, tb int, key long")
    keys = cut(keys)
    walked = sum(WALKS.values())
    ways = keys.where(F.col("tb") >= walked)
    crowd = ways.join(ways.groupBy("tb", "key").agg(F.count("*").alias("m")).hint("merge"), ["tb", "key"]).groupBy("id").agg(F.avg(F.ln("m")).alias("crowd"))
    full = profile.select("id", "nk", "nt", "nv", "dt", "dv", "lt", "lv", "lg", "lc", _embedder(vectors)("nt", "nw", "dt", "dw").alias("e")).join(crowd.hint("merge"), "id", "left")
    return cut(full), _candidates(keys.where(F.col("tb") < walked)), keys


def scored_candidates(table: DataFrame, left: str = "github", right: str = "sourceforge", *, seed: int = SEED, vectors: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) of distinct records with their exact attribute scores,
    and the rows (rep, id) of every record."""
    reps, members = distinct_records(cut(records(table)))
    full, pairs, _ = candidates(reps, left, right, seed=seed, vectors=vectors)
    return score_pairs(full, pairs), members


def score_pairs(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact scores of pairs (a, b) of profiles that have a like name or a link."""
    few = full.select("id", "nk", "lt")
    named = (
        pairs.hint("merge").join(few.select(F.col("id").alias("a"), F.col("nk").alias("ka"), F.col("lt").alias("la")), "a")
        .hint("merge").join(few.select(F.col("id").alias("b"), F.col("nk").alias("kb"), F.col("lt").alias("lb")), "b")
        .select("a", "b", F.arrays_overlap("la", "lb").alias("linked"), F.pandas_udf(_name_dice, "double")("ka", "kb").alias("dice"))
        # a match needs a like name or a link
        .where((F.col("dice") >= LEAST_NAME) | F.col("linked"))
        .select("a", "b", "dice")
    )
    one = full.drop("nk").select(*[F.col(c).alias({"id": "a"}.get(c, c + "1")) for c in full.columns if c != "nk"])
    two = full.drop("nk").select(*[F.col(c).alias({"id": "b"}.get(c, c + "2")) for c in full.columns if c != "nk"])
    agree = lambda x, y: F.when(F.col(x).isNull() | F.col(y).isNull(), 0.0).when(F.col(x) == F.col(y), 1.0).otherwise(-1.0)
    scored = (
        cut(named).hint("merge").join(one, "a").hint("merge").join(two, "b")
        .withColumn("f", F.pandas_udf(_exact, _FEATURES)("dt1", "dv1", "dt2", "dv2", "nt1", "nv1", "nt2", "nv2", "lt1", "lv1", "lt2", "lv2", "e1", "e2"))
        .select("a", "b", "dice", "f.*", "crowd1", "crowd2", agree("lg1", "lg2").alias("lang"), agree("lc1", "lc2").alias("lic"))
    )
    return cut(scored)


#: The scores as they enter the model: of the names, the descriptions, and others.
OF_NAMES = {"dice": F.col, "name": F.col, "link": lambda c: F.col(c) / 10, "linked": lambda c: (F.col("link") > 0).cast("double")}
OF_TEXTS = {"back": F.col, "fore": F.col, "vec": F.col, "shared": lambda c: F.least(F.col(c) / 40, F.lit(2.0))}
OTHERS = {c: lambda c: F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(3.0)) for c in ("crowd1", "crowd2")}
SCORES = OF_NAMES | OF_TEXTS | OTHERS
#: A match needs both views: names times texts, and every such score squared.
PRODUCTS = [(i, j) for i in range(4) for j in range(4, 8)] + [(i, i) for i in range(8)]
STRATA = 16


@dataclass
class Calibration:
    """A logistic curve over the scores and products of them."""

    products: list
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    chance: float
    missed: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.concatenate([z, *[z[:, [i]] * z[:, [j]] for i, j in self.products], np.ones((len(z), 1))], axis=1)

    def confidence(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))

    def column(self, scores: list[Column]) -> Column:
        z = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(scores, self.centre, self.scale)]
        terms = z + [z[i] * z[j] for i, j in self.products]
        total = F.lit(float(self.weights[-1]))
        for w, term in zip(self.weights, terms):
            total = total + F.lit(float(w)) * term
        return 1 / (1 + F.exp(-total))


def _logistic(x: np.ndarray, t: np.ndarray, ridge: np.ndarray, rounds: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (t - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_calibration(x: np.ndarray, y: np.ndarray, start: np.ndarray, *, products: list | None = None, ridge: float = 1.0, rounds: int = 60) -> Calibration:
    """The curve from noisy labels (EM). ``y`` is 1 where language and licence
    agree, which a match fails with a rate ``missed`` and others meet with a
    rate ``chance``; both rates are fitted. ``start`` is a first guess."""
    out = Calibration(PRODUCTS if products is None else products, x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-3, np.empty(0), 0.05, 0.08)
    z = out.design(x)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    p = np.clip(start, 0.01, 0.99)
    for _ in range(rounds):
        t = np.where(y > 0, p * (1 - out.missed) / (p * (1 - out.missed) + (1 - p) * out.chance), p * out.missed / (p * out.missed + (1 - p) * (1 - out.chance)))
        out.chance = float(np.clip(((1 - t) * y).sum() / max((1 - t).sum(), 1e-9), 1e-3, 0.5))
        out.missed = float(np.clip((t * (1 - y)).sum() / max(t.sum(), 1e-9), 0.01, 0.3))
        out.weights = _logistic(z, t, penalty)
        before, p = p, out.confidence(x)
        if not len(p) or np.abs(p - before).max() < 1e-3:
            break
    return out


def calibrate(scored: DataFrame) -> Calibration:
    """Fit on at most CALIBRATION_ROWS pairs of known language and licence, the
    same number from every stratum of a first guess: how alike the names are,
    times how much of one description is in the other."""
    guess = F.greatest("dice", F.when(F.col("link") > 0, 0.8).otherwise(0.0)) * F.col("back")
    known = scored.where("lang != 0 and lic != 0").select("a", "b", guess.alias("start"), ((F.col("lang") > 0) & (F.col("lic") > 0)).cast("double").alias("y"), *[make(c).alias(f"x_{c}") for c, make in SCORES.items()])
    known = known.withColumn("bin", F.least(F.lit(STRATA - 1), F.floor(F.col("start") * STRATA)))
    share = F.broadcast(known.groupBy("bin").agg((F.lit(CALIBRATION_ROWS / STRATA) / F.count("*")).alias("share")))  # at most STRATA rows
    drawn = known.join(share, "bin").where(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    sample = drawn.limit(2 * CALIBRATION_ROWS).toPandas().sort_values(["a", "b"])
    return fit_calibration(sample[[f"x_{c}" for c in SCORES]].to_numpy(float), sample["y"].to_numpy(float), sample["start"].to_numpy(float))


def confidences(scored: DataFrame, model: Calibration) -> DataFrame:
    return scored.select("a", "b", model.column([make(c) for c, make in SCORES.items()]).alias("confianca"))


def match_entities(table: DataFrame, left: str = "github", right: str = "sourceforge", *, threshold: float = 0.5, vectors: np.ndarray | None = None) -> DataFrame:
    """Pairs (a, b, confianca) of records of the two sites at the threshold."""
    scored, members = scored_candidates(table, left, right, vectors=vectors)
    sure = confidences(scored, calibrate(scored)).where(F.col("confianca") >= threshold)
    rows = lambda side: members.select(F.col("rep").alias(side), F.col("id").alias(f"{side}_id"))
    return sure.join(rows("a").hint("merge"), "a").join(rows("b").hint("merge"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "confianca")
