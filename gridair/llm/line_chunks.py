"""Line dedup by content-defined chunks (operator 1).

A text's lines are hashed; a rolling hash over the last lines' hashes closes a chunk where it is divisible by the mean
chunk length.  Borders depend on the lines around them only, so lines put in or taken out elsewhere don't move them.
Chunks of two or more lines with text that occur again anywhere are removed, all but the first (by doc_id, place).

Equal means equal bytes: chunks are grouped by hash and whole text (with partial sums, so a chunk that is everywhere is
no hot key).  Where a hash has one text only, its occurrences need no further comparison; where it has several, they
are joined by text as well.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridair.llm.common import written

#: Lines in the rolling hash, mean lines in a chunk.
WINDOW, MEAN = 2, 4
# Base and modulus of the rolling hash.
BASE, MODULUS = 1_000_003, 2_147_483_647


def chunk_bounds(lines: list[bytes]) -> list[int]:
    """Index after the last line of each chunk."""
    out, past = [], [0] * WINDOW
    for i, line in enumerate(lines):
        past = [*past[1:], int.from_bytes(hashlib.md5(line).digest()[:4], "big") % MODULUS]
        value = 0
        for h in past:
            value = (value * BASE + h) % MODULUS
        if value % MEAN == 0:
            out.append(i + 1)
    if not out or out[-1] < len(lines):
        out.append(len(lines))
    return out


def _chunks(text: bytes | None):
    """(number, first line, lines, hash, text, removable) of each chunk; a null text has none."""
    if text is None:
        return
    lines = text.split(b"\n")
    at = 0
    for k, to in enumerate(chunk_bounds(lines)):
        own = lines[at:to]
        whole = b"\n".join(own)
        yield k, at, to - at, hashlib.md5(whole).hexdigest(), whole, sum(bool(x.strip(b" \t\n\x0b\x0c\r")) for x in own) > 1
        at = to


def chunks(docs: DataFrame, with_text: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, chunk, first, n_lines, hash, many, whole) of every chunk; version is a hash of the text, many tells whether it may be removed."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("chunk", pa.int32()), ("first", pa.int32()), ("n_lines", pa.int32()), ("hash", pa.string()), ("many", pa.bool_()), ("whole", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, versions, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()
            out, held = [], 0
            for d, v, t in zip(ids, versions, texts, strict=True):
                out += [(d, v, k, at, n, h, many, whole if with_text and many else None) for k, at, n, h, whole, many in _chunks(t)]
                held += len(t or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).mapInArrow(
        run, "doc_id long, version long, chunk int, first int, n_lines int, hash string, many boolean, whole binary")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_lines, n_chunks, gone) of every document that has a text; gone lists the removed chunks as (first, n_lines)."""
    def key():
        return F.struct(F.col("doc_id").isNull(), "doc_id", "version", "chunk")

    each = chunks(docs, True, id_col, text_col).where("many")
    texts = each.groupBy("hash", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(key()).alias("kept"))
    again = written(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("kept").alias("kept")).where("n > texts"), "repeated-chunks")
    narrow = chunks(docs, False, id_col, text_col)
    # Occurrences other than the one kept, by hash where it has one text only.
    gone = narrow.where("many").join(again.where("texts = 1"), "hash").where(key() != F.col("kept")).select("doc_id", "version", "chunk")
    mixed = again.where("texts > 1").select("hash")
    if not mixed.isEmpty():
        own = each.join(mixed, "hash", "left_semi")
        kept = own.groupBy("hash", "whole").agg(F.min(key()).alias("kept"))
        gone = gone.union(own.join(kept, ["hash", "whole"]).where(key() != F.col("kept")).select("doc_id", "version", "chunk"))
    marked = narrow.select("doc_id", "version", "chunk", "first", "n_lines", F.lit(0).alias("out")).union(
        gone.select("doc_id", "version", "chunk", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)))
    by_chunk = marked.groupBy("doc_id", "version", "chunk").agg(F.max("first").alias("first"), F.max("n_lines").alias("n_lines"), F.max("out").alias("out"))
    return by_chunk.groupBy("doc_id", "version").agg(
        F.sum("n_lines").cast("long").alias("n_lines"), F.count(F.lit(1)).alias("n_chunks"),
        F.sort_array(F.collect_list(F.when(F.col("out") == 1, F.struct("first", "n_lines")))).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cut, and the columns line_count, chunk_count, removed_chunks and removed_lines.

    Lines are split at line feeds.  A text of which all goes becomes empty; a null text stays null with counts of 0.
    Repeated rows (same id and text) count as one document and are cut alike; the same id with another text is another
    document.  Of equal chunks one in a row with an id is kept before one in a row without.  Columns of the input that
    clash with the four are replaced.  An empty table gives an empty result.
    """
    marked = removals(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("n_lines").alias("_lines"), F.col("n_chunks").alias("_chunks"), F.col("gone").alias("_gone"))
    text = F.col(text_col).cast("string")
    joined = docs.withColumn("_row_version", F.xxhash64(text)).join(
        marked, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_row_version") == F.col("_version")), "left")
    cut_lines = F.flatten(F.transform("_gone", lambda g: F.sequence(g["first"], g["first"] + g["n_lines"] - 1)))
    has = F.size("_gone") > 0
    # The lines that stay, joined again: whole stretches between removed chunks.
    stay = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(cut_lines, i))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (joined.withColumn("line_count", zero(F.when(text.isNotNull(), F.col("_lines")))).withColumn("chunk_count", zero(F.when(text.isNotNull(), F.col("_chunks"))))
            .withColumn("removed_chunks", zero(F.when(has, F.size("_gone"))))
            .withColumn("removed_lines", zero(F.when(has, F.aggregate("_gone", F.lit(0), lambda a, g: a + g["n_lines"]))))
            .withColumn(text_col, F.when(has, F.array_join(stay, "\n")).otherwise(text))
            .drop("_id", "_version", "_row_version", "_lines", "_chunks", "_gone"))
