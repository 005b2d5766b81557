"""Mixing sources to target weights: hierarchical budgeting.

A mixture is a tree: its domains, their languages, and under each language the
sources, the leaves. A source's weight is split over its leaves by the tokens
they have, then the total is propagated down. A leaf takes at most its tokens
times the source's cap; what a node cannot take is given first to its siblings
that still have room, by their weights, and only what they cannot take goes up
to the siblings of the parent. Each leaf then selects a prefix of its seeded
order: whole epochs first, then the documents of the last epoch, each epoch
ordered by a hash of seed, epoch and document, up to the budget.

The tree is aggregated to one row a (mixture, leaf); its size is the number of
sources times languages, and it is checked against ``MAX_LEAVES`` before the
driver budgets it. Prefixes need no sort of a whole leaf: tokens are summed by
the leading bits of the hash, the running sums find the one bucket in which the
budget ends, and only the rows of that bucket are ordered.

Defined results: texts without tokens are never chosen; documents without
source belong to no target; a source without documents or with a cap of zero
takes nothing and its share goes to its siblings; a source without a target is
not used; a repeated doc_id is one document; a null language is the language
``und``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

MAX_LEAVES = 200_000
NO_LANGUAGE = ""
BUCKETS = 4096
_BUDGET = "mistura string, source string, idioma string, disponivel long, max_repeticoes int, orcamento long"
_SHARES = "mistura string, source string, peso_alvo double, total long"


@dataclass
class Node:
    """A node of the tree: its weight and the most it can take."""

    weight: float = 0.0
    room: float = 0.0
    children: dict = field(default_factory=dict)
    given: float = 0.0


def distribute(amount: float, nodes: list[Node]) -> float:
    """Give ``amount`` to sibling nodes by weight, each up to its room; what a
    full node cannot take goes to those with room. Returns the rest."""
    open_ = [n for n in nodes if n.room - n.given > 1e-9 and n.weight > 0]
    while amount > 1e-6 and open_:
        total = sum(n.weight for n in open_)
        rest = 0.0
        for n in open_:
            share = amount * n.weight / total
            took = min(share, n.room - n.given)
            n.given += took
            rest += share - took
        amount = rest
        open_ = [n for n in open_ if n.room - n.given > 1e-9]
    return amount


def budget_tree(total: float, root: Node) -> None:
    """Propagate ``total``: siblings first share it and each other's shortage,
    then every node hands its part down; what the parts below cannot take was
    never given, as a node's room is the sum of the rooms below it."""
    root.given = min(total, root.room)

    def down(node: Node) -> None:
        kids = list(node.children.values())
        if kids:
            distribute(node.given, kids)
            for kid in kids:
                down(kid)

    down(root)


def _tree(own: list, have: dict, domains: dict[str, str], endless: bool = False) -> Node:
    """The tree of one mixture, weights and rooms summed up to the root."""
    root = Node()
    for source, weight, repeat in own:
        held = have.get(source) or {NO_LANGUAGE: 0}  # a source without documents has its weight and no room
        mass = sum(held.values()) or 1
        for language, tokens in sorted(held.items()):
            room = float(tokens * max(repeat or 0, 0))
            path = root
            for name in (domains.get(source, source), language):
                path = path.children.setdefault(name, Node())
            path.children[source] = Node(weight * (tokens / mass if tokens else 1.0), float("inf") if endless and room else room)

    def up(node: Node) -> None:
        for kid in node.children.values():
            up(kid)
        if node.children:
            node.weight = sum(k.weight for k in node.children.values())
            node.room = sum(k.room for k in node.children.values())

    up(root)
    return root


def _leaves(node: Node) -> list[Node]:
    return [x for k in node.children.values() for x in (_leaves(k) if k.children else [k])]


def _on_target(endless: Node, bounded: Node) -> float:
    """The largest total at which no source with documents exceeds its cap."""
    budget_tree(1.0, endless)
    return min((b.room / e.given for e, b in zip(_leaves(endless), _leaves(bounded)) if e.given > 1e-12), default=0.0)


def _budgets(leaves: list, targets: list, total_of, domains: dict[str, str], stretch: float = 1.0) -> tuple[list, list]:
    """Rows of _BUDGET and _SHARES from the aggregated leaves."""
    have: dict[str, dict[str, int]] = {}
    for source, language, tokens in leaves:
        have.setdefault(source, {})[language] = int(tokens)
    budgets, shares = [], []
    for mixture in sorted({t[0] for t in targets}):
        own = [(s, w, r) for m, s, w, r in targets if m == mixture and w and w > 0]
        total = total_of(mixture)
        if total is None:
            total = stretch * _on_target(_tree(own, have, domains, endless=True), _tree(own, have, domains))
        root = _tree(own, have, domains)
        budget_tree(float(total), root)
        for domain in root.children.values():
            for language, node in domain.children.items():
                for source, leaf in node.children.items():
                    if source not in have:
                        continue
                    repeat = next(r for s, _, r in own if s == source)
                    budgets.append((mixture, source, language, have[source][language], int(repeat or 0), int(round(leaf.given))))
        shares += [(mixture, s, float(w), int(total)) for s, w, _ in own]
    return budgets, shares


def plan_mixtures(sized: DataFrame, targets: DataFrame, *, total_tokens: dict[str, int] | None = None, stretch: float = 1.0, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, lang, tokens) and the targets to the leaf budgets and
    the target shares. ``total_tokens`` is the size of each mixture; by default
    the largest at which every source that has documents meets its share
    within its cap, times ``stretch``. At a larger size, sources at their cap
    fall short and the others take their shares. ``domains`` names the domain
    of a source; others are a domain of their own name."""
    spark = sized.sparkSession
    leaf = sized.where("tokens > 0 and source is not null").groupBy("source", "idioma").agg(F.sum("tokens").alias("tokens"))
    rows = leaf.limit(MAX_LEAVES + 1).collect()
    kinds = targets.where("mistura is not null and source is not null").select("mistura", "source", "peso_alvo", "max_repeticoes").distinct().limit(MAX_LEAVES + 1).collect()
    if max(len(rows), len(kinds)) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    given = total_tokens or {}
    budgets, shares = _budgets([tuple(r) for r in rows], [tuple(k) for k in kinds], given.get, domains or {}, stretch)
    return spark.createDataFrame(budgets, _BUDGET), spark.createDataFrame(shares, _SHARES)


def language_of(lang):
    """Main subtag of a language, ``und`` where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(lang, r"^\s*(\p{L}{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")), F.lit("und"))


def mix_sources(sized: DataFrame, budgets: DataFrame, *, seed: int = 17) -> DataFrame:
    """Chosen documents (mistura, doc_id, source, idioma, tokens, repeticoes).

    ``sized`` is (doc_id, source, idioma, tokens). A leaf with the budget B and
    A tokens takes all documents B div A times and a prefix of about B mod A
    tokens of the next epoch, ending where the running sum is nearest to it."""
    plan = F.broadcast(
        budgets.where("orcamento > 0 and disponivel > 0 and max_repeticoes > 0")
        .withColumn("epocas", F.least((F.col("orcamento") / F.col("disponivel")).cast("long"), F.col("max_repeticoes").cast("long")))
        .withColumn("resto", F.when(F.col("epocas") < F.col("max_repeticoes"), F.col("orcamento") - F.col("epocas") * F.col("disponivel")).otherwise(F.lit(0)))
    )  # one row a leaf, at most MAX_LEAVES
    docs = sized.where("tokens > 0 and source is not null").join(plan, ["source", "idioma"])
    order = F.xxhash64(F.lit(seed), "mistura", "epocas", "doc_id")
    docs = docs.withColumn("ordem", order).withColumn("balde", F.shiftrightunsigned(order, 52).cast("int"))
    leaf = ["mistura", "source", "idioma"]
    sums = docs.where("resto > 0").groupBy(*leaf, "balde").agg(F.sum("tokens").alias("soma"), F.first("resto").alias("r"))
    running = Window.partitionBy(*leaf).orderBy("balde").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.withColumn("antes", F.coalesce(F.sum("soma").over(running), F.lit(0))).select(
        *leaf, "balde", "antes", F.when(F.col("antes") + F.col("soma") <= F.col("r"), 1).when(F.col("antes") < F.col("r"), 0).otherwise(-1).alias("lado")
    )
    # at most BUCKETS rows a leaf; the bucket where a budget ends is one a leaf
    tagged = docs.join(found, [*leaf, "balde"], "left").withColumn("lado", F.coalesce("lado", F.lit(-1)))
    edge = tagged.where("lado = 0").withColumn("ate", F.col("antes") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("ordem", "doc_id")))
    extra = edge.withColumn("mais", (F.col("ate") - F.col("tokens") / 2 <= F.col("resto")).cast("long")).drop("ate")
    rest = tagged.where("lado != 0").withColumn("mais", F.when(F.col("lado") == 1, 1).otherwise(0).cast("long"))
    return rest.unionByName(extra).select("mistura", "doc_id", "source", "idioma", "tokens", (F.col("epocas") + F.col("mais")).alias("repeticoes")).where("repeticoes > 0")


def actual_shares(chosen: DataFrame, shares: DataFrame) -> DataFrame:
    """Target and actual share of every source of every mixture."""
    got = chosen.groupBy("mistura", "source").agg(F.sum(F.col("tokens") * F.col("repeticoes")).alias("tokens"), F.count("*").alias("documentos"), F.max("repeticoes").alias("repeticoes"))
    whole = Window.partitionBy("mistura")
    return (
        shares.join(got, ["mistura", "source"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documentos", "repeticoes")})
        .withColumn("parte", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(whole), F.lit(1)), 6))
        .select("mistura", "source", "peso_alvo", "parte", "tokens", "documentos", "repeticoes", "total")
    )
