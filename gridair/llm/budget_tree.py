"""Mixing sources to target weights by hierarchical budgeting (operator 4).

A budget of tokens goes down a tree of domain, language and source.  Each node shares its budget among its children by
weight; a child that has too few tokens (its own, times the epochs allowed) gets what it has, and the shortage goes to
its siblings by weight.  A node never gets more than its subtree holds, so what its children can't use goes to its own
siblings first.  Each leaf then takes whole epochs and, of the next one, the documents that come first in a seeded
order until the budget is met; the last is cut to a prefix of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import running_sum, spread_hash, written

NONE = "(none)"
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column | str) -> Column:
    """Tokens of a text as counted here: its words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column | str, n: Column | str) -> Column:
    """A text up to the end of its n-th word."""
    pieces = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int") if isinstance(n, str) else n.cast("int")), "")


def weight_of(level: str, weights: dict[str, int]) -> Column:
    """A whole-number weight for each value of a level; 1 where none is given."""
    out = F.lit(1)
    for value, w in sorted(weights.items()):
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("long")


def _share_out(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``got``: the part of ``budget`` (the parent's) for each child of capacity ``cap`` and weight ``w``.

    Children are ordered by cap / w.  Those before some point are used up; the rest share what is left by weight, and
    the tokens lost in rounding go to the first of them.
    """
    # cap / w in whole parts and millionths, neither of which can overflow.
    ratio = [F.expr("cap div w"), F.expr("(cap % w) * 1000000 div w")]
    order = Window.partitionBy(*parents).orderBy(*ratio, child)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parents)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    x = (children.withColumn("cap_before", F.coalesce(F.sum("cap").over(past), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(past), F.lit(0)))
         .withColumn("used_up", d("cap") * d("w_left") <= d("w") * (d("budget") - d("cap_before")))
         .withColumn("left", F.col("budget") - F.sum(F.when(F.col("used_up"), F.col("cap")).otherwise(0)).over(all_))
         .withColumn("w_open", F.sum(F.when(F.col("used_up"), 0).otherwise(F.col("w"))).over(all_))
         .withColumn("even", F.when(F.col("used_up"), F.col("cap")).otherwise(F.expr("bigint(cast(left as decimal(38,0)) * cast(w as decimal(38,0)) div w_open)"))))
    lost = F.col("left") - F.sum(F.when(F.col("used_up"), 0).otherwise(F.col("even"))).over(all_)
    place = F.row_number().over(Window.partitionBy(*parents).orderBy("used_up", *ratio, child))
    return (x.withColumn("lost", lost).withColumn("place", place)
            .withColumn("got", F.least("cap", F.when(F.col("used_up"), F.col("cap")).otherwise(F.col("even") + F.when(F.col("place") <= F.col("lost"), 1).otherwise(0))))
            .drop("cap_before", "w_left", "used_up", "left", "w_open", "even", "lost", "place"))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """(levels..., tokens, got) for every leaf of ``leaves`` (levels..., tokens); the root's budget is ``share`` of all tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
    budget = min(total * share[0] // share[1], total * epochs)
    got = None
    for depth, level in enumerate(levels):
        keys = levels[:depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights.get(level, {})))
        if got is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(got.withColumnRenamed("got", "budget"), levels[:depth])
        got = _share_out(nodes, levels[:depth], level).select(*keys, "got")
    return leaves.select(*levels, "tokens").join(got, levels)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, levels..., epoch, tokens, taken) of every document taken, once for each epoch; ``docs`` has an id, ``tokens`` and the levels' columns.

    ``taken`` is less than ``tokens`` for the last document of a leaf.  A null level is the node "(none)".  Rows with
    the same id are one document (the one of most tokens, ties by the levels); rows without an id and documents
    without tokens are never taken.  An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels], F.col("tokens").cast("long"))
    one = rows.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max(F.struct("tokens", *levels)).alias("r")).select("doc_id", *[f"r.{c}" for c in levels], "r.tokens")
    one = written(one, "mix-documents")
    leaves = written(one.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    got = budgets(leaves, levels, weights, share, epochs)
    plan = written(got.select(*levels, F.expr("got div tokens").alias("full"), F.expr("got % tokens").alias("rest")), "mix-budgets")
    parts = one.join(plan, levels).withColumn("h", spread_hash(F.lit(seed), F.col("full").cast("string"), F.col("doc_id").cast("string")))
    seen = running_sum(parts, levels, "h", "tokens", "before", ["doc_id"])
    last = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("before")))
    each = seen.withColumn("last", last).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))))
    return (each.withColumn("taken", F.when(F.col("epoch") < F.col("full"), F.col("tokens")).otherwise(F.col("last")).cast("long"))
            .where("taken > 0").select("doc_id", *levels, "epoch", "tokens", "taken"))
