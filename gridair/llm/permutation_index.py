"""Approximate nearest neighbours by a permutation index (operator 10).

Every vector is represented by its nearest pivots in order.  Pivots' inverted files, one set for each shard of the
vectors, list who has the pivot at which place.  A query adds up, over its own pivots' lists, the footrule distance
between the two orders; the best share of each shard is ranked again by the exact distance.  Queries come in blocks: a
task holds one shard and one block, whatever the size of the table.

Equal vectors are one entry of the index with its smallest id; the ids of the others are listed beside it, as many as
a result can hold, so a vector shared by a third of all rows is no hot group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import spread_hash, written

#: Pivots (a sample bounded by this number), pivots in an order, share and least number of each shard ranked again, entries of a shard, queries of a block.
PIVOTS, PREFIX, SHARE, LEAST, SHARD, BLOCK = 256, 64, 0.15, 256, 8192, 8192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, not zero, no null or non-finite component, an id, and the commonest length (the shorter on a tie)."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0].n if lengths else -1))


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The places of the nearest pivots, nearest first, for each row."""
    far = (x ** 2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots ** 2).sum(axis=1)
    return np.argsort(far, axis=1, kind="stable")[:, :min(PREFIX, len(pivots))]


def build(entries: DataFrame, pivots: np.ndarray, shards: int) -> DataFrame:
    """The index as a written table: for each shard a row of its vectors (pivot -1) and one for each pivot's list."""
    def shard(key, rows):
        rows = rows.sort_values("rep")
        x = np.stack(rows["v"].to_numpy()).astype(np.float32)
        near = orders(x.astype(np.float64), pivots)
        who, place = np.nonzero(near >= 0)
        flat = near.ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        out = [(key[0], -1, rows["rep"].to_numpy(np.int64).tobytes(), x.tobytes())]
        out += [(key[0], p, who[by[a:b]].astype(np.int32).tobytes(), place[by[a:b]].astype(np.int32).tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pd.DataFrame(out, columns=["shard", "pivot", "who", "place"])
    dealt = entries.select("rep", "v", (F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1)) % shards).cast("int").alias("shard"))
    return written(dealt.groupBy("shard").applyInPandas(shard, "shard int, pivot int, who binary, place binary"), "permutation-index")


def probe(index: pd.DataFrame, queries: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of the nearest ``k`` of a shard."""
    own = index[index["pivot"] < 0].iloc[0]
    reps = np.frombuffer(own["who"], np.int64)
    x = np.frombuffer(own["place"], np.float32).reshape(len(reps), -1).astype(np.float64)
    lists = {p: (np.frombuffer(w, np.int32), np.frombuffer(q, np.int32)) for p, w, q in zip(index["pivot"], index["who"], index["place"], strict=True) if p >= 0}
    near, out = orders(queries, pivots), []
    length = near.shape[1]
    some = min(len(reps), max(LEAST, int(np.ceil(SHARE * len(reps)))))
    for q, order in zip(queries, near, strict=True):
        # Footrule less what no common pivot changes: |a - b| - (length - a) - (length - b) for each common one.
        score = np.zeros(len(reps), np.int32)
        for a, p in enumerate(order.tolist()):
            if p in lists:
                who, b = lists[p]
                score[who] += np.abs(a - b) - (2 * length - a - b)
        best = np.argpartition(score, some - 1)[:some]
        d = np.sqrt(((x[best] - q) ** 2).sum(axis=1))
        first = np.lexsort((reps[best], d))[:k]
        out.append((reps[best][first], d[first]))
    return out


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row among all other rows.

    Ties go to the smaller id.  Rows that take no part (see ``usable``) are neither queries nor candidates.  Rows with
    the same id are one candidate, with the smallest of their vectors.  No usable row gives an
    empty result; other columns are not read.
    """
    rows = written(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    entries = written(rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.col("first").alias("rep"), "v", "n"), "entries")
    n = entries.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    sample = entries.select("v").orderBy(F.md5(F.col("v").cast("string"))).limit(PIVOTS).collect()
    pivots = np.array([r.v for r in sample], np.float64).reshape(len(sample), -1)
    shards = max(1, -(-n // SHARD))
    index = build(entries, pivots, shards)
    # Ids of equal vectors, the smallest k + 1 of each: first within buckets, then of what is left.
    members = rows.join(entries.where("n > 1").select("v", "rep"), "v").select("rep", "vec_id", spread_hash(F.col("vec_id").cast("string")).alias("h"))
    members = _smallest(members, k + 1).union(entries.where("n = 1").select("rep", F.col("rep").alias("vec_id")))
    members = written(members, "members")
    asked = written(rows.where(is_query).join(entries, "v").select("vec_id", "rep"), "queries")
    wanted = asked.select("rep").distinct()
    blocks = max(1, -(-wanted.count() // BLOCK))
    dealt = (entries.join(wanted, "rep", "left_semi").select("rep", "v", (F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1)) % blocks).cast("int").alias("block"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(right, left):
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        found = probe(left, np.stack(right["v"].to_numpy()).astype(np.float64), pivots, k + 1)
        return pd.DataFrame({"query": np.repeat(right["rep"].to_numpy(), [len(r) for r, _ in found]), "rep": np.concatenate([r for r, _ in found]), "score": np.concatenate([d for _, d in found])})
    near = dealt.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(find, "query long, rep long, score double")
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(near, "query").join(members, "rep").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(members: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest vec_id of every rep."""
    cut = members.withColumn("bucket", F.shiftright("h", 52))
    some = cut.withColumn("_n", F.row_number().over(Window.partitionBy("rep", "bucket").orderBy("vec_id"))).where(F.col("_n") <= k)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("_n") <= k).select("rep", "vec_id")
