"""Mixing sources to target weights [native]: hierarchical budgeting over a domain-language-source tree.

Weights are propagated from the root: a node's budget is shared among its children in proportion to their
weights, but no child gets more than its capacity (the tokens below it times ``max_epochs``). What a child
cannot take goes to its siblings by water-filling; only what all of them cannot take is missing one
level up, where the node's own capacity already says so. Each leaf then takes whole epochs while they
fit, and of the next epoch the longest token-prefix that fits, in that epoch's seeded order
(md5 of seed, epoch and doc_id).

A leaf may hold a third of all rows, so no leaf is ever sorted as a whole: prefix sums run over ``SLICES``
ranges of the seeded hash, and only the documents of the one range in which the budget ends are sorted.
What comes out of that is one cutoff per leaf; the documents are then decided row by row.

Defined results: null text has no tokens and is taken wherever its leaf's cutoff takes its place; null
lang or source is a child named "" of its own; rows that repeat a doc_id share a place, and are taken or
left together; an empty table gives no rows; weights must be positive; extra columns are kept in
:func:`mix`, whatever their names, but ``copies``, in any case of letters, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.runtime import broadcast_if_small, materialize

#: A token here is a run of anything but ASCII blanks.
TOKEN = r"[^ \t\n\r\f\x0B]+"
HEX = 3
SLICES = 16**HEX
TREE = ("domain", "language", "origin")
#: What the names of added columns start with, beside those of the input.
OWN = "__mix_"


@dataclass(frozen=True)
class MixPlan:
    """Target weights by level; a child without an entry has ``other``. ``share``: budget in parts of all tokens."""

    #: Sources belong to domains by name; others to "other".
    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "web": tuple(f"src{i}" for i in range(10)),
        "reference": tuple(f"src{i}" for i in range(10, 15)),
        "forum": tuple(f"src{i}" for i in range(15, 20)),
    })
    weights: tuple[dict[str, float], ...] = (
        {"web": 5.0, "reference": 3.0, "forum": 2.0}, {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}, {"src0": 4.0},
    )
    other: tuple[float, ...] = (1.0, 0.5, 1.0)
    share: float = 0.8
    max_epochs: int = 2
    seed: int = 17

    def keys(self) -> list[Column]:
        source = F.coalesce(F.col("source").cast("string"), F.lit(""))
        domain = F.lit("other")
        for d, names in self.domains.items():
            domain = F.when(source.isin(list(names)), d).otherwise(domain)
        return [domain.alias(TREE[0]), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(TREE[1]), source.alias(TREE[2])]

    def weight(self, level: int) -> Column:
        out = F.lit(self.other[level])
        for name, w in self.weights[level].items():
            out = F.when(F.col(TREE[level]) == name, w).otherwise(out)
        return out

    def order(self, epoch: Column) -> Column:
        """A document's place in an epoch's seeded order, as hex digits that sort as text."""
        return F.md5(F.concat_ws(":", F.lit(str(self.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _fill(children: DataFrame, parent: list[str], child: str, weight: Column) -> DataFrame:
    """Share column ``budget`` of the parent among children with ``capacity`` by water-filling, into ``budget``."""
    rows = children.withColumn("w", weight).withColumn("ratio", F.col("capacity") / F.col("w"))
    before = Window.partitionBy(*parent).orderBy("ratio", child).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rows = rows.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
    rows = rows.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left_w"))
    # children whose capacity lies below the level are full; they come first in this order
    rows = rows.withColumn("water", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole))
    got = F.when(F.col("ratio") <= F.col("level"), F.col("capacity")).otherwise(F.greatest(F.col("water") * F.col("w"), F.lit(0.0)))
    return rows.withColumn("budget", got).select(*parent, child, "budget")


def leaf_budgets(light: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, language, origin, tokens, budget (whole tokens) of every leaf. ``light`` has the keys and tokens."""
    leaves = light.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    leaves = materialize(leaves.withColumn("capacity", F.col("tokens") * F.lit(float(plan.max_epochs))), "leaves", 100)
    budget = leaves
    for level, child in enumerate(TREE):
        above = list(TREE[:level])
        nodes = leaves.groupBy(*above, child).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(budget, above) if above else nodes.withColumn("budget", F.sum("capacity").over(Window.partitionBy()) * F.lit(plan.share / plan.max_epochs))
        budget = _fill(nodes, above, child, plan.weight(level))
    out = leaves.join(budget, list(TREE)).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))
    return out.select(*TREE, "tokens", "budget")


def leaf_cutoffs(documents: DataFrame, plan: MixPlan) -> DataFrame:
    """Every leaf with its whole epochs, the next one's number and the last place taken of it ("" if none)."""
    light = documents.select("doc_id", *plan.keys(), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKEN)).cast("long").alias("tokens"))
    light = materialize(light, "tokens")
    leaves = leaf_budgets(light, plan)
    epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(plan.max_epochs))).otherwise(0)
    leaves = leaves.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    leaves = materialize(leaves.select(*TREE, "tokens", "budget", "epochs", "rest"), "budgets", 100)
    n = leaves.count()

    open_ = leaves.where(F.col("epochs") < plan.max_epochs).drop("tokens", "budget")
    placed = light.join(broadcast_if_small(open_, n, 120), list(TREE)).withColumn("place", plan.order(F.col("epochs") + 1))
    placed = placed.withColumn("slice", F.substring("place", 1, HEX))
    slices = placed.groupBy(*TREE, "slice").agg(F.sum("tokens").alias("t"), F.max("place").alias("last"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*TREE).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("cum", F.sum("t").over(running))
    # the range in which the budget ends, and the last place of the ranges before it
    ends = slices.groupBy(*TREE).agg(
        F.min(F.when(F.col("cum") > F.col("rest"), F.struct("slice", (F.col("cum") - F.col("t")).alias("before")))).alias("end"),
        F.max(F.when(F.col("cum") <= F.col("rest"), F.col("last"))).alias("whole"),
    )
    ends = materialize(ends, "ends", 200)
    edge = placed.join(broadcast_if_small(ends.where("end is not null").select(*TREE, "end"), n, 120), list(TREE)).where(F.col("slice") == F.col("end.slice"))
    edge = edge.withColumn("cum", F.col("end.before") + F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    edge = edge.where(F.col("cum") <= F.col("rest")).groupBy(*TREE).agg(F.max("place").alias("part"))
    out = leaves.join(ends.select(*TREE, "whole"), list(TREE), "left").join(edge, list(TREE), "left")
    cutoff = F.when(F.col("epochs") < plan.max_epochs, F.coalesce("part", "whole")).otherwise(F.lit(None))
    return materialize(out.select(*TREE, "tokens", "budget", "epochs", F.coalesce(cutoff, F.lit("")).alias("cutoff")), "cutoffs", 200)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix(documents: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """The documents taken at least once, with all their columns and ``copies``, the number of epochs that take them."""
    plan = plan or MixPlan()
    leaves = leaf_cutoffs(documents, plan).select(*[F.col(c).alias(OWN + c) for c in TREE], F.col("epochs").alias(OWN + "epochs"), F.col("cutoff").alias(OWN + "cutoff"))
    names = [quoted(c) for c in documents.columns if c.lower() != "copies"]
    keyed = documents.select(*names, *[k.alias(OWN + c) for k, c in zip(plan.keys(), TREE, strict=True)])
    joined = keyed.join(broadcast_if_small(leaves, leaves.count(), 120), [OWN + c for c in TREE])
    copies = F.col(OWN + "epochs") + (plan.order(F.col(OWN + "epochs") + 1) <= F.col(OWN + "cutoff")).cast("int")
    return joined.withColumn("copies", copies.cast("long")).where("copies > 0").select(*names, "copies")
