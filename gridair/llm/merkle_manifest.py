"""Merkle manifest of a dataset by nested-interval labels (operator 12).

Rows are leaves; the leaves of a tree (one for each value of a column) are ranked, every ``fanout`` consecutive nodes
become their parent, and the trees' tops are the leaves of one tree above them.  A node's label is the interval of leaf
ranks that it covers.  A leaf's ancestors are the nodes whose intervals contain it: a join on tree, level and the
interval's bucket at that level.  What a node's interval lacks of its parent's is covered by its siblings.

Levels are built and joined in strata of ``STEPS`` levels, so that a node meets at most ``fanout ** STEPS`` rows, also
one that covers a third of all leaves, and the number of jobs grows with the logarithm of the largest tree.  Texts are
read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridair.llm.common import ranked, written

#: Levels of a stratum.
STEPS = 6
#: Equal leaves written out at once.
COPIES = 1 << 16


def digest(*parts: Column) -> Column:
    """SHA-256 of the joined parts as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(x: Column) -> Column:
    """Bytes as lower-case hex digits."""
    return F.lower(F.hex(x))


def field(x: Column) -> Column:
    """A value as the manifest writes it: ``-`` for null, else its bytes' count, a colon and itself."""
    text = x.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, shown), "")


def _above(below: Column, fanout: int) -> Column:
    """The parents of a block's nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.unhex(F.sha2(_joined(F.slice(below, i * fanout + 1, fanout)), 256)))


def _labels(j: int, fanout: int):
    """For the i-th node of level ``j`` of a block: its interval, and the digests of the nodes that the parent's interval has beside it."""
    wide = fanout ** j

    def node(_, i):
        first = F.col("block") * fanout ** (STEPS - j)
        low = (first + i) * wide
        high = F.least(low + wide, F.col("n"))
        parent_low = F.floor(low / (wide * fanout)) * (wide * fanout)
        parent_high = F.least(parent_low + wide * fanout, F.col("n"))
        # The difference of the intervals: [parent_low, low) and [high, parent_high).
        left = F.slice(F.col(f"l{j}"), ((parent_low / wide) - first + 1).cast("int"), ((low - parent_low) / wide).cast("int"))
        right = F.slice(F.col(f"l{j}"), (i + 2).cast("int"), F.ceil((parent_high - high) / wide).cast("int"))
        return F.struct(F.lit(j).alias("level"), (first + i).alias("bucket"), low.alias("low"), high.alias("high"),
                        F.unhex(_joined(left)).alias("left"), F.unhex(_joined(right)).alias("right"))
    return node


def _stratum(children: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the next ``STEPS`` levels over ``children`` (tree, n, at, digest), and the nodes above them as children.

    ``at`` is a child's place in its tree, ``n`` the number of children there.  Nodes have a level (0: the children
    themselves), a bucket and the interval [low, high) of children covered, and the digests of their siblings to the
    left and to the right.  A level is built while its tree has more than one node.
    """
    span = fanout ** STEPS
    block = children.groupBy("tree", F.expr(f"at div {span}").alias("block")).agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("l0"))
    for j in range(STEPS):
        block = block.withColumn(f"l{j + 1}", F.when(F.col("n") > fanout ** j, _above(F.col(f"l{j}"), fanout)).otherwise(F.col(f"l{j}")))
    block = written(block, "merkle-blocks")
    none = F.array().cast("array<struct<level:int,bucket:bigint,low:bigint,high:bigint,left:binary,right:binary>>")
    levels = [F.when(F.col("n") > fanout ** j, F.transform(f"l{j}", _labels(j, fanout))).otherwise(none) for j in range(STEPS)]
    nodes = written(block.select("tree", F.explode(F.concat(*levels)).alias("x")).select("tree", "x.*"), "merkle-nodes")
    tops = block.select("tree", F.ceil(F.col("n") / span).alias("n"), F.col("block").alias("at"), F.col(f"l{STEPS}")[0].alias("digest"))
    return nodes, tops


def _ascend(children: DataFrame, largest: int, fanout: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(children, nodes) of every stratum from the leaves up, and the top (tree, digest) of every tree."""
    strata = []
    while True:
        nodes, tops = _stratum(children, fanout)
        strata.append((children, nodes))
        children, largest = tops, -(-largest // fanout ** STEPS)
        if largest <= 1:
            return strata, children.select("tree", "digest")


def _descend(strata: list[tuple[DataFrame, DataFrame]], above: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """The leaves with ``path``, an array of (left, right) from the leaf to the root; ``above`` has (tree, path, carried...) of the trees' tops."""
    span = fanout ** STEPS
    above = above.withColumn("bucket", F.lit(0).cast("long"))
    for children, nodes in reversed(strata):
        own = [c for c in children.columns if c not in ("tree", "n", "at")]
        step = F.array(F.struct("left", "right"))
        nodes = nodes.select("tree", "level", "bucket", "low", "high", step.alias("path"), *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in carried])
        nodes = nodes.unionByName(above.select("tree", F.lit(STEPS).alias("level"), "bucket", (F.col("bucket") * span).alias("low"), ((F.col("bucket") + 1) * span).alias("high"), "path", *carried))
        asked = children.select("tree", "at", *own, F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("level"))
        asked = asked.select("tree", "at", "level", F.floor(F.col("at") / F.pow(F.lit(float(fanout)), "level")).cast("long").alias("bucket"),
                             *[F.when(F.col("level") == STEPS, F.col(c)).alias(c) for c in own])
        met = asked.join(nodes, ["tree", "level", "bucket"]).where("low <= at and at < high")
        each = met.groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.struct("level", "path"))).alias("parts"), *[F.max(c).alias(c) for c in [*own, *carried]])
        found = each.select("tree", F.col("at").alias("bucket"), *own, F.flatten(F.transform("parts", lambda x: x["path"])).alias("path"), *carried)
        above = written(found, "merkle-paths")
    return above


def _forest(leaves: DataFrame, keys: list[str], fanout: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Strata and tops over ``leaves`` (tree, keys..., digest, other columns): leaves of a tree ascend by ``keys``."""
    one = [c for c in leaves.columns if c != "tree"]
    same = leaves.groupBy(*leaves.columns).agg(F.count(F.lit(1)).alias("copies"))
    placed = written(ranked(same, ["tree"], [*keys, *[c for c in one if c not in keys]], "copies", "first"), "merkle-ranks")
    sizes = placed.groupBy("tree").agg(F.sum("copies").alias("n"))
    runs = placed.join(sizes, "tree").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    start = F.col("first") + F.col("run") * COPIES
    end = F.least(start + COPIES, F.col("first") + F.col("copies")) - 1
    children = written(runs.select("tree", "n", F.explode(F.sequence(start, end)).alias("at"), *one), "merkle-leaves")
    return _ascend(children, sizes.agg(F.max("n")).first()[0] or 0, fanout)


def manifest(rows: DataFrame, fields: list[str], tree: str, order: str, changed: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the digest of ``fields``; ``changed`` gives fields another value in the copy that is checked against the
    manifest: ``folded_root`` is the root that the copy's leaf and the manifest's siblings give.

    A null field is written ``-``; a null ``tree`` is a tree of its own and comes first, as a null ``order`` does.
    Rows of the same order ascend by their digests; rows equal in all fields are leaves of their own.  Texts of any
    length and empty ones are fields like any other.  An empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    now = [(changed or {}).get(c, F.col(c)) for c in fields]
    leaves = rows.select(F.when(F.col(tree).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(tree).cast("string"))).alias("tree"), F.col(order).alias("key"),
                         digest(*[field(F.col(c)) for c in fields]).alias("digest"), digest(*[field(c) for c in now]).alias("now"))
    if changed is None:
        leaves = leaves.withColumn("now", F.col("digest"))
    strata, tops = _forest(leaves, ["key"], fanout)
    tops = written(tops, "merkle-tops")
    upper, root = _forest(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"], fanout)
    start = written(root.select("tree", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("digest").alias("root")), "merkle-root")
    over = _descend(upper, start, ["root"], fanout).select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = _descend(strata, over, ["subroot", "root"], fanout)
    fold = F.aggregate("path", F.col("now"), lambda a, x: F.unhex(F.sha2(F.concat(shown(x["left"]), shown(a), shown(x["right"])), 256)))
    return found.select(F.col("key").alias(order), shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
                        F.sha2(F.array_join(F.transform("path", lambda x: F.concat(shown(x["left"]), shown(x["right"]))), ""), 256).alias("proof_sha256"),
                        shown(fold).alias("folded_root"), fold.eqNullSafe(F.col("root")).alias("verified"))
