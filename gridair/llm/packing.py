"""Packing by shortest-pack-first over the length histogram (operator 9).

Documents longer than a sequence are cut into full pieces and a rest.  Only the histogram of piece lengths (at most
2048 entries, whatever the input) comes to the driver: lengths are placed longest first, each into the pack pattern
with the most room left, or where none has room, as many to a new pack as it holds, and only counts of patterns are kept.  A piece finds its place by its rank among the pieces
of its length: the pattern, the sequence and the offset follow from it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridair.llm.common import running_sum, spread_hash, written
from gridair.llm.tokens import encoder, slices


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(piece_id, doc_id, start, length, doc_tokens, ids) as a written table; ids are little-endian, 2 bytes each where the vocabulary allows, else 4."""
    def run(batches):
        enc, n = encoder(vocabulary), TaskContext.get().partitionId() << 40
        w, end = enc.width, np.array([end_id], f"<u{enc.width}").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            for i, j in slices(texts):
                rows = []
                for d, b in zip(doc_ids[i:j], enc.encode(texts[i:j]), strict=True):
                    b += end
                    total = len(b) // w
                    for at in range(0, total, size):
                        rows.append((n, d, at, min(size, total - at), total, b[at * w:(at + size) * w]))
                        n += 1
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())],
                                                 ["piece_id", "doc_id", "start", "length", "doc_tokens", "ids"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "piece_id long, doc_id long, start long, length long, doc_tokens long, ids binary"), "pieces")


def patterns(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the pack patterns by shortest-pack-first."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by the room left
    widest = size
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max((r for r in room if room[r]), default=-1)
            if widest < length:
                # Nothing open has room: as many of the length as fit share a new pack, what is over opens the last.
                fit = size // length
                for count, n in ((left // fit, fit), (1, left % fit)):
                    if count and n:
                        room[size - n * length].append((count, [length] * n))
                break
            count, lengths = room[widest].pop()
            used = min(count, left)
            if count > used:
                room[widest].append((count - used, lengths))
            room[widest - length].append((used, [*lengths, length]))
            left -= used
    return [p for r in sorted(room) for p in room[r]]


def places(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For every length: first rank, first sequence and offset of each of its intervals of ranks."""
    first, seen, out = 0, defaultdict(int), defaultdict(list)
    for count, lengths in found:
        at = 0
        for n in lengths:
            out[n].append((seen[n], first, at))
            seen[n] += count
            at += n
        first += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(parts: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``.

    Lengths shared by very many pieces are ranked in buckets (``running_sum``).  An empty table gives an empty result.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    place = places(patterns(histogram, size))

    def run(batches):
        for batch in batches:
            ids, lengths, ranks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            seq, off = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                firsts, seqs, offs = place[int(n)]
                k = np.searchsorted(firsts, ranks[own], "right") - 1
                seq[own], off[own] = seqs[k] + ranks[own] - firsts[k], offs[k]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seq), pa.array(off)], ["piece_id", "sequence_id", "offset"])

    narrow = parts.select("piece_id", "length", F.lit(1).alias("one"), spread_hash(F.col("piece_id").cast("string")).alias("h"))
    ranked = running_sum(narrow, ["length"], "h", "one", "rank", ["piece_id"])
    found = ranked.select("piece_id", "length", F.col("rank").cast("long")).mapInArrow(run, "piece_id long, sequence_id long, offset long")
    return parts.join(found, "piece_id")


def digest(packed: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of packed pieces."""
    import zlib

    def run(batches):
        for batch in batches:
            lengths, data = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sums = [zlib.crc32(np.frombuffer(b, f"<u{len(b) // n}").astype("<u4")) for n, b in zip(lengths, data, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64()), *batch.columns[4:]],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
