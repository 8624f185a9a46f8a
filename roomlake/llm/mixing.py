"""Mixing sources to target weights, with DataFrame functions only.

Every document belongs to a leaf of a tree, by default domain - language -
source. Weights are given for nodes; a token budget enters at the root and goes
down level by level. A child never gets more than it can give (its tokens times
the epochs allowed); what it falls short of goes to its siblings by their
weights, and only what all siblings together can't give is left to the parent's
siblings. As a parent's capacity is the sum of its children's, filling each level
up to the capacities does just that.

A leaf's documents stand in the order of a seeded hash, another one for each
epoch. The leaf takes whole epochs and then the shortest prefix of the next that
fills its budget. To find where the prefix ends, tokens are summed by leaf and
the hash's first digits, and only the rows of the one bucket in which the prefix
ends are put in order. So no task sees the rows of a whole leaf.

Defined cases
-------------
null labels         are the label "unknown"
null or empty text  has no tokens; it is taken where it lies in the prefix
null ids            are hashed as an empty id
rows of equal id    stand at one place of the order and are taken together
unlisted nodes      have the default weight; weight 0 takes nothing
empty table         no rows
other columns       are passed through by :func:`mix`
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.storage import Workspace

#: Hex digits of the order's hash by which tokens are summed: 16 ** 3 buckets a leaf.
BUCKET_DIGITS = 3
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class MixPlan:
    """Weights by path from the root ("web", "web/en", "web/en/src3"), or by "*/en" for a label under any parents."""

    levels: Sequence[str]
    weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 1
    #: The budget as a part (percent) of all tokens there are, once.
    budget_percent: int = 50
    max_epochs: int = 1
    seed: int = 7


def count_words(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(plan: MixPlan, depth: int) -> Column:
    """Of the node at ``depth`` (1: below the root): that of its path, else of its label, else the default."""
    path = F.concat_ws("/", *[F.col(c) for c in plan.levels[:depth]])
    label = F.concat(F.lit("*/" if depth > 1 else ""), F.col(plan.levels[depth - 1]))
    listed = {k: v for k, v in plan.weights.items() if k.count("/") == depth - 1 or k.startswith("*/") and depth > 1}
    if not listed:
        return F.lit(plan.default_weight).cast("long")
    table = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, label), F.lit(plan.default_weight)).cast("long")


def allocate(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """``leaves`` (the levels, tokens) with ``budget``: whole tokens for each leaf.

    One window a level, over the nodes of the tree and never over documents. Of
    siblings in order of capacity for each unit of weight, a child is full if all
    could be given its capacity for each unit; the rest share what is left.
    """
    current = leaves.select(*plan.levels, F.col("tokens").cast(WHOLE).alias("tokens"), (F.col("tokens") * plan.max_epochs).cast(WHOLE).alias("capacity"))
    total = current.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast(WHOLE).alias("all_tokens"), F.coalesce(F.sum("capacity"), F.lit(0)).cast(WHOLE).alias("all_capacity"))
    budget = F.least(F.expr(f"cast(all_tokens * {int(plan.budget_percent)} as decimal(38,0)) div 100").cast(WHOLE), F.col("all_capacity"))
    parents = total.select(F.lit(0).alias("root"), budget.alias("budget"))
    for depth in range(1, len(plan.levels) + 1):
        above, own = list(plan.levels[: depth - 1]), list(plan.levels[:depth])
        nodes = current.groupBy(*own).agg(F.sum("capacity").cast(WHOLE).alias("capacity")).withColumn("weight", _weight(plan, depth).cast(WHOLE))
        nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast(WHOLE)))
        joined = nodes.withColumn("root", F.lit(0)).join(parents, ["root", *above])
        # the ratio is compared as a double and ties by name: any order of equal ratios gives the same shares
        siblings = Window.partitionBy("root", *above)
        ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(0.0))
        ranked = joined.withColumn("ratio", ratio)
        upto = siblings.orderBy("ratio", own[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        onward = siblings.orderBy("ratio", own[-1]).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        ranked = ranked.withColumn("used", F.sum("capacity").over(upto) - F.col("capacity")).withColumn("weights_on", F.sum("weight").over(onward))
        full = (F.col("weight") == 0) | (F.col("capacity") * F.col("weights_on") + F.col("used") * F.col("weight") <= F.col("budget") * F.col("weight"))
        ranked = ranked.withColumn("full", full)
        ranked = ranked.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(F.lit(0))).over(siblings))
        ranked = ranked.withColumn("open", F.when(F.col("full"), F.lit(0).cast(WHOLE)).otherwise(F.col("weight")))
        ranked = ranked.withColumn("all_open", F.sum("open").over(siblings)).withColumn("open_upto", F.sum("open").over(siblings.orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        part = lambda weights: F.expr(f"cast(rest * ({weights}) as decimal(38,0)) div nullif(all_open, 0)")
        share = F.when(F.col("full"), F.col("capacity")).otherwise(part("open_upto") - part("open_upto - open"))
        parents = ranked.select("root", *own, share.cast(WHOLE).alias("budget"))
    return leaves.join(parents.drop("root"), list(plan.levels)).withColumn("budget", F.col("budget").cast("long"))


def _placed(docs: DataFrame, cuts: DataFrame, plan: MixPlan) -> DataFrame:
    """Rows of ``docs`` with their leaf's cut and the hash of the epoch that is taken in part."""
    return docs.join(cuts, list(plan.levels)).withColumn("order_hash", order_hash(plan.seed, F.col("whole_epochs"), F.col("doc_id")))


def find_cuts(docs: DataFrame, plan: MixPlan, space: Workspace) -> DataFrame:
    """For each leaf: tokens, budget, whole_epochs, and where the prefix ends (cut_hash, cut_id; null: before all rows).

    ``docs``: the levels, doc_id, tokens. The order of rows is by (order_hash, doc_id).
    """
    leaves = docs.groupBy(*plan.levels).agg(F.sum("tokens").cast("long").alias("tokens"))
    budgets = allocate(space.save(leaves, "leaves"), plan)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.withColumn("whole_epochs", whole).withColumn("rest", F.col("budget") - F.col("whole_epochs") * F.col("tokens"))
    budgets = space.save(budgets.withColumnRenamed("tokens", "leaf_tokens"), "budgets")

    placed = _placed(docs.select(*plan.levels, "doc_id", "tokens"), budgets.where("rest > 0").select(*plan.levels, "whole_epochs", "rest"), plan)
    placed = placed.withColumn("bucket", F.substring("order_hash", 1, BUCKET_DIGITS))
    leaf = Window.partitionBy(*plan.levels)
    sums = placed.groupBy(*plan.levels, "rest", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bucket")
    # the prefix ends in the last bucket that begins before the budget is filled
    last = sums.withColumn("before", before).where("before < rest").groupBy(*plan.levels).agg(F.max(F.struct("bucket", "before")).alias("m"))
    last = space.save(last.select(*plan.levels, F.col("m.bucket").alias("bucket"), F.col("m.before").alias("before")), "last-buckets")

    rows = placed.join(last, [*plan.levels, "bucket"]).groupBy(*plan.levels, "rest", "before", "order_hash", "doc_id").agg(F.sum("tokens").alias("here"))
    running = F.sum("here").over(leaf.orderBy("order_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here") + F.col("before")
    ends = rows.withColumn("running", running).where("running < rest").groupBy(*plan.levels).agg(F.max(F.struct("order_hash", "doc_id")).alias("end"))
    return space.save(budgets.join(ends, list(plan.levels), "left").select(*plan.levels, "leaf_tokens", "budget", "whole_epochs", F.col("end.order_hash").alias("cut_hash"), F.col("end.doc_id").alias("cut_id")), "cuts")


def select_prefixes(docs: DataFrame, cuts: DataFrame, plan: MixPlan) -> DataFrame:
    """A row of ``docs`` for each epoch in which it is taken, with the column ``epoch``.

    The written table of cuts has a row a leaf; Spark broadcasts it while its size
    is below its threshold and else joins by leaf, splitting large leaves.
    """
    here = F.col("order_hash")
    in_prefix = F.col("cut_hash").isNotNull() & ((here < F.col("cut_hash")) | ((here == F.col("cut_hash")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id")))))
    times = F.col("whole_epochs") + F.when(in_prefix, 1).otherwise(0)
    placed = _placed(docs, cuts.select(*plan.levels, "whole_epochs", "cut_hash", "cut_id"), plan).withColumn("times", times).where("times > 0")
    if plan.max_epochs == 1:
        return placed.withColumn("epoch", F.lit(0).cast("long")).drop("order_hash", "times", "whole_epochs", "cut_hash", "cut_id")
    return placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).drop("order_hash", "times", "whole_epochs", "cut_hash", "cut_id")


def mix(docs: DataFrame, plan: MixPlan, space: Workspace, *, labels: Mapping[str, Column], tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with ``epoch``; ``labels`` gives each level's column.

    Working columns are kept apart from those of ``docs``, which come back as they were.
    """
    own = [f"_level_{k}" for k in range(len(plan.levels))]
    inner = MixPlan(own, plan.weights, plan.default_weight, plan.budget_percent, plan.max_epochs, plan.seed)
    marked = [F.coalesce(labels[c].cast("string"), F.lit("unknown")).alias(n) for c, n in zip(plan.levels, own)]
    counted = space.save(docs.select(*marked, "doc_id", (tokens if tokens is not None else count_words(F.col("text"))).alias("tokens")), "counted")
    cuts = find_cuts(counted, inner, space)
    taken = select_prefixes(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *marked, "doc_id"), cuts, inner)
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *[F.col(n).alias(c) for c, n in zip(plan.levels, own) if c not in docs.columns], "epoch")
