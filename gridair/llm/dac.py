"""Directly addressable codes for token ids (operator 5).

An id is cut into chunks of eight bits.  Level 0 holds the lowest chunk of every id and a bitmap that tells which ids
go on; level 1 holds the next chunk of those, and so on.  A rank directory (ones before every block of 512 bits) leads
from a position in one level to its position in the next, so any token is read without decoding what lies before it.

File: magic, length of the JSON head, head (counts, and the place of every section), then the sections: document ids,
document starts, and for each level its chunks, bitmap and directory.  All numbers are little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import filesystem, fresh, written
from gridair.llm.tokens import encoder, slices

MAGIC = b"GDAC0001"
BLOCK = 512
#: Tokens of one file, and tokens decoded at a time on reading.
FILE_TOKENS, READ_TOKENS = 16 << 20, 2 << 20
NO_ID = -(1 << 63)


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file's bytes; starts has one entry more than doc_ids, from 0 to the number of ids."""
    sections = [("doc_ids", doc_ids.astype("<i8").tobytes()), ("starts", starts.astype("<u8").tobytes())]
    level, rest = 0, ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        words[:len(bits)] = bits
        ones = np.bitwise_count(words).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        sections += [(f"chunks{level}", (rest & 0xFF).astype(np.uint8).tobytes()), (f"bits{level}", bits.tobytes()),
                     (f"ranks{level}", np.concatenate(([0], np.cumsum(ones)))[:max(1, len(ones))].astype("<u8").tobytes())]
        level += 1
        if not more.any():
            break
        rest = rest[more] >> 8
    at, places = 0, {}
    for name, data in sections:
        places[name] = [at, len(data)]
        at += len(data)
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": level, "places": places}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(d for _, d in sections)


class DacFile:
    """Random access to a file of ``encode`` by reads of byte ranges only."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no file of token codes")
        n = int.from_bytes(self.file.read_at(8, 8), "little")
        self.head, self.base = json.loads(self.file.read_at(n, 16)), 16 + n
        self.docs, self.tokens = self.head["docs"], self.head["tokens"]

    def _read(self, name: str, at: int, n: int, kind) -> np.ndarray:
        width = np.dtype(kind).itemsize
        start, _ = self.head["places"][name]
        return np.frombuffer(self.file.read_at(n * width, self.base + start + at * width), kind)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return self._read("doc_ids", 0, self.docs, "<i8"), self._read("starts", 0, self.docs + 1, "<u8").astype(np.int64)

    def rank(self, level: int, at: int) -> int:
        """Ones in the bitmap of ``level`` before position ``at``."""
        block = at // BLOCK
        if block * BLOCK == at and block > 0:
            block -= 1
        before = int(self._read(f"ranks{level}", block, 1, "<u8")[0])
        bits = np.unpackbits(self._read(f"bits{level}", block * BLOCK // 8, -(-at // 8) - block * BLOCK // 8, np.uint8), bitorder="little")
        return before + int(bits[:at - block * BLOCK].sum())

    def read(self, i: int, j: int, level: int = 0) -> np.ndarray:
        """Ids of the tokens i .. j - 1."""
        out = self._read(f"chunks{level}", i, j - i, np.uint8).astype(np.uint32)
        first = i // 8
        more = np.unpackbits(self._read(f"bits{level}", first, -(-j // 8) - first, np.uint8), bitorder="little")[i - first * 8:j - first * 8].astype(bool)
        n = int(more.sum())
        if n:
            r = self.rank(level, i)
            out[more] |= self.read(r, r + n, level + 1) << 8
        return out

    def token(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes code files in ascending id order and returns their list (part, file, path, docs, tokens), itself a written table.

    Documents are dealt out by ranges of their id, so any two files hold disjoint ranges (equal ids stay together,
    ordered by text); a null id comes first, a null text is empty.  A task that is run again writes files of new
    names; only those that the list names count.
    """
    spark = docs.sparkSession
    folder = folder or fresh(spark, "codes")

    def run(batches):
        enc, part, file = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        held, ids, size = [], [], 0

        def flush():
            nonlocal held, ids, size, file
            fs, path = filesystem(f"{folder}/{part:06d}-{file:04d}-{uuid.uuid4().hex}.dac")
            fs.create_dir(path.rsplit("/", 1)[0])
            starts = np.concatenate(([0], np.cumsum([len(x) for x in held]))) // enc.width
            with fs.open_output_stream(path) as f:
                f.write(encode(np.frombuffer(b"".join(held), f"<u{enc.width}"), np.array(ids, np.int64), starts))
            row = pa.RecordBatch.from_pylist([{"part": part, "file": file, "path": f"{folder}/{path.rsplit('/', 1)[1]}", "docs": len(ids), "tokens": int(starts[-1])}],
                                             schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            held, ids, size, file = [], [], 0, file + 1
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            for i, j in slices(texts):
                for d, b in zip(doc_ids[i:j], enc.encode(texts[i:j]), strict=True):
                    held.append(b + end)
                    ids.append(NO_ID if d is None else d)
                    size += len(b) // enc.width + 1
                    if size >= FILE_TOKENS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "part long, file long, path string, docs long, tokens long"), "code-files")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, tokens) of every document in the listed files; ``tokens`` are its ids as little-endian unsigned 32-bit integers, ``start`` counts the ids of all documents before it."""
    w = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = files.select("path", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    n = max(1, files.count())

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = DacFile(path)
                ids, starts = f.documents()
                at = 0
                while at < len(ids):
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_TOKENS, "right")) - 1)
                    to = min(to, len(ids))
                    values = f.read(int(starts[at]), int(starts[to])).astype("<u4")
                    cuts = (starts[at:to + 1] - starts[at]).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d in ids[at:to].tolist()], pa.int64()), pa.array(starts[at:to] + base, pa.int64()),
                                                      pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "start", "tokens"])
                    at = to
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, tokens binary")


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_documents``; Spark's crc32 is the unsigned one."""
    return documents.select("doc_id", "start", F.expr("bigint(octet_length(tokens) div 4)").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
