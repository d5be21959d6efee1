"""SimHash near-duplicates with pigeonring filtering (operator 7).

Fingerprints: majority bits over the XXH64 (seed 42) of every word shingle of the whole text.  Candidates: the 64
bits are five segments on a ring.  If two fingerprints differ in at most four bits, some segment starts a chain whose
first l segments differ in at most l - 1 bits, for every l (the proportional budget 4/5 per segment, for whole
numbers).  So the first segment is equal and the second differs in at most one bit: that is the join key.  The other
lengths of the chain prune before the full Hamming check.

Keys shared by many fingerprints (a large group of near copies) would give all pairs.  Their fingerprints are linked
another exact way: two fingerprints differ in at most four bits exactly if their balls of radius two meet, and all
that meet in one point are linked to each other, so each is linked to the smallest one there.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import components, map_rows, written

WIDTHS = (13, 13, 13, 13, 12)
BITS = 4
#: Index fingerprints of one key from which pairs are left to the balls.
HOT = 256


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 majority bits of a text in UTF-8 as a signed long; no word: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(whole[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    lambda ids, texts: (ids, [fingerprint(t, shingle) for t in texts]), "doc_id long, fp long")


def _segments(fp: str):
    """The ring's segments as columns, each moved to the low bits."""
    out, at = [], 64
    for w in WIDTHS:
        at -= w
        out.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << w) - 1)))
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` of at most four differing bits; enough of them to connect all that are reachable."""
    m = len(WIDTHS)
    seg = _segments("fp")
    code = lambda i, first, second: F.lit(i << 26) + first * F.lit(1 << 13) + second
    index = fps.select("fp", F.explode(F.array(*[code(i, seg[i], seg[(i + 1) % m]) for i in range(m)])).alias("key"))
    probe = fps.select(F.col("fp").alias("x"), F.explode(F.array(*[
        code(i, seg[i], seg[(i + 1) % m].bitwiseXOR(F.lit(flip)))
        for i in range(m) for flip in [0, *(1 << j for j in range(WIDTHS[(i + 1) % m]))]])).alias("key"))
    hot_keys = written(index.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-keys")
    pairs = probe.join(hot_keys, "key", "left_anti").join(index.join(hot_keys, "key", "left_anti").withColumnRenamed("fp", "y"), "key").where("x < y")
    diff = F.col("x").bitwiseXOR(F.col("y"))
    parts, at = [], 64
    for w in WIDTHS:
        at -= w
        parts.append(F.bit_count(diff.bitwiseAND(F.lit(((1 << w) - 1) << at if at + w < 64 else (((1 << w) - 1) << at) - (1 << 64)))))
    start = F.shiftright(F.col("key"), 26)
    chain = F.lit(False)
    for i in range(m):
        ring = [parts[(i + k) % m] for k in range(m)]
        kept = start == i
        for length in range(1, m):
            kept = kept & (sum(ring[1:length], ring[0]) <= length - 1)
        chain = chain | kept
    near = pairs.where(chain).where(F.bit_count(diff) <= BITS).select(F.col("x").alias("a"), F.col("y").alias("b"))
    hot = probe.join(hot_keys, "key", "left_semi").select("x").distinct()
    flips = sorted({a | b for a in [0, *(1 << i for i in range(64))] for b in [0, *(1 << i for i in range(64))]})
    signed = np.array(flips, dtype=np.uint64).astype(np.int64).tolist()
    met = _balls(hot, signed).withColumn("b", F.min("x").over(Window.partitionBy("z"))).where("x <> b").select(F.col("x").alias("a"), "b").distinct()
    return near.union(met)


def _balls(hot: DataFrame, flips: list[int]) -> DataFrame:
    """(x, z) for all z within two bits of x."""
    import pyarrow as pa
    masks = np.array(flips, dtype=np.int64)

    def run(batches):
        for batch in batches:
            xs = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(xs), 500):
                x = xs[at:at + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(masks))), pa.array((x[:, None] ^ masks[None, :]).ravel())], ["x", "z"])
    return hot.mapInArrow(run, "x long, z long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable by links.

    A null or blank text has fingerprint 0 and is linked like any other.  Repeated rows come out once each.  Rows with
    a null id take part; their component_id is the smallest id of the component, null if it has none.  An empty table
    gives an empty result; other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    comp = components(links(distinct.select("fp")))
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
