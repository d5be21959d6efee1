"""Hard-negative mining by a vertical scan (operator 13).

Vectors of whole numbers lie in blocks by dimension.  For each anchor a block reads its dimensions in the order of the
anchor's largest components; after every few of them a vector's score lies between what it has so far plus the least
and the most that the block's smallest and largest values of the remaining dimensions can add.  Vectors whose bounds
rule them out leave the bitmap of candidates; the rest end with their exact score.  A first scan finds each anchor's
positives, a second the different-label vectors inside the score windows that the positives set.

Blocks of vectors meet blocks of anchors, so a task holds a fixed number of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import written

#: Vectors and anchors that a task holds; dimensions read between two prunings.
VECTORS, ANCHORS, READ = 16_384, 1_024, 8


def whole(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part, with whole components floor(scale * x).

    Without an id, a label or a vector, with a null or non-finite component, or of another length than the commonest
    (the shorter on a tie) a row takes no part; nor if scores of vectors of its size do not fit a long (components
    beyond the root of 2**62 / dimensions).  Rows of one id are one (the smallest by label, then vector).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = lengths[0].n if lengths else -1
    limit = int((2 ** 62 / max(1, n)) ** 0.5)
    v = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    fits = rows.where(F.size("v") == n).where(~F.exists("v", lambda x: F.abs(F.floor(x * float(scale)).cast("double")) > limit))
    return fits.select("id", "label", v.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


class Block:
    """Vectors by dimension, with each dimension's least and greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        # Sums of whole numbers are exact in doubles up to 2**53, and doubles are faster.
        exact = columns.size == 0 or len(columns) * float(np.abs(columns).max()) ** 2 < 2 ** 53
        self.ids, self.labels, self.columns = ids, labels, columns.astype(np.float64 if exact else np.int64)
        self.low, self.high = (columns.min(axis=1), columns.max(axis=1)) if columns.size else (None, None)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bitmap ``alive`` that ``prune(rows, least, most)`` keeps at every look, and their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        a = anchor[order]
        ends = np.stack([a * self.low[order], a * self.high[order]])
        least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        rows = np.flatnonzero(alive)
        score = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), READ):
            read = order[at:at + READ]
            part = self.columns[read] if len(rows) == len(alive) else self.columns[np.ix_(read, rows)]
            score += (anchor[read].astype(part.dtype) @ part).astype(np.int64)
            to = min(at + READ, len(order))
            keep = prune(rows, score + least[to], score + most[to])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, or None of fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def positives_of(block: Block, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int):
    """(anchor, id, score) of each anchor's best ``k`` other rows of its label in the block."""
    for i, label, a in zip(ids, labels, anchors, strict=True):
        def prune(rows, least, most):
            bound = _kth(least, k)
            return np.ones(len(rows), bool) if bound is None else most >= bound
        rows, score = block.scan(a, (block.labels == label) & (block.ids != i), prune)
        for r in _first(block.ids[rows], score, k):
            yield i, block.ids[rows[r]], score[r]


def negatives_of(block: Block, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, wanted: list, window: tuple[int, int], k: int):
    """(anchor, positive score, id, score) of the best ``k`` rows of another label in the window of each of an anchor's positive scores."""
    for i, label, a, positives in zip(ids, labels, anchors, wanted, strict=True):
        # Whole scores s with window[0] * p <= 100 * s <= window[1] * p.
        spans = [(int(p), -(-window[0] * int(p) // 100), window[1] * int(p) // 100) for p in sorted(set(positives))]

        def prune(rows, least, most, spans=spans):
            keep = np.zeros(len(rows), bool)
            for _, low, high in spans:
                may = (most >= low) & (least <= high)
                sure = (least >= low) & (most <= high)
                bound = _kth(least[sure], k)
                keep |= may if bound is None else may & (most >= bound)
            return keep
        rows, score = block.scan(a, block.labels != label, prune)
        for p, low, high in spans:
            inside = np.flatnonzero((score >= low) & (score <= high))
            for r in inside[_first(block.ids[rows[inside]], score[inside], k)]:
                yield i, p, block.ids[rows[r]], score[r]


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """The vectors as a written table of blocks, a row for each dimension (-1: the ids, -2: the labels)."""
    def block(key, part):
        part = part.sort_values("id")
        v = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), -1)
        out = [(key[0], -1, part["id"].to_numpy(np.int64).tobytes()), (key[0], -2, part["label"].to_numpy(np.int64).tobytes())]
        return pd.DataFrame(out + [(key[0], d, v[:, d].tobytes()) for d in range(v.shape[1])], columns=["block", "dim", "column"])
    dealt = rows.withColumn("block", (F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) % max(1, -(-n // VECTORS))).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(block, "block int, dim int, column binary"), "vertical-blocks")


def _load(part: pd.DataFrame) -> Block:
    by = {d: np.frombuffer(c, np.int64) for d, c in zip(part["dim"], part["column"], strict=True)}
    dims = len(by) - 2
    return Block(by[-1], by[-2], np.stack([by[d] for d in range(dims)]) if dims else np.zeros((0, len(by[-1])), np.int64))


def _over(blocks: DataFrame, asked: DataFrame, n_blocks: int, n_asked: int, find, schema: str) -> DataFrame:
    """``find(block, anchors)`` for every block of vectors and every block of anchors."""
    groups = max(1, -(-n_asked // ANCHORS))
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (asked.withColumn("group", (F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) % groups).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    names = [c.split()[0] for c in schema.split(", ")]

    def both(part, anchors):
        if part.empty or anchors.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        v = np.stack(anchors["v"].to_numpy()).astype(np.int64).reshape(len(anchors), -1)
        found = list(find(_load(part), anchors, v))
        return pd.DataFrame(found, columns=names, dtype=np.int64)
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(both, schema)


def mine(rows: DataFrame, is_anchor: Column | str = "id % 100 = 0", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (id, label, v) as ``whole`` gives them.

    An anchor's positives are its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows
    of another label whose score is within ``window`` percent of the positive's.  Higher scores come first, ties by the
    smaller id.  Anchors without a positive, and positives without such a row (as those of a score below zero), have no
    rows.  An empty table gives an empty result.  Equal vectors under different ids are rows of their own: blocks are
    dealt by id, so copies of one vector fill no block.
    """
    rows = written(rows.select("id", "label", "v"), "whole-vectors")
    n, anchors = rows.count(), rows.where(is_anchor)
    blocks, n_blocks, n_asked = _blocks(rows, n), max(1, -(-n // VECTORS)), anchors.count()
    best = lambda by, id_, score: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_))

    def same(block, asked, v):
        return positives_of(block, asked["id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64), v, positives)
    near = _over(blocks, anchors, n_blocks, n_asked, same, "anchor_id long, positive_id long, positive_score long")
    near = written(near.withColumn("_n", best(["anchor_id"], "positive_id", "positive_score")).where(F.col("_n") <= positives).drop("_n"), "positives")

    wanted = anchors.join(near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("wanted")), "id")

    def other(block, asked, v):
        return negatives_of(block, asked["id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64), v, asked["wanted"].tolist(), window, negatives)
    far = _over(blocks, wanted, n_blocks, n_asked, other, "anchor_id long, positive_score long, negative_id long, negative_score long")
    far = far.withColumn("rank", best(["anchor_id", "positive_score"], "negative_id", "negative_score")).where(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
