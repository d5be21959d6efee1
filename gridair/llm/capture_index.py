"""WARC archives with a two-level capture index (operator 8).

Records are gzip members of WARC files.  Index files hold the captures in the order of their reversed-host URL key
(and page), cut into blocks that are compressed one by one; a sparse directory has the first capture of every block.
A lookup searches the list of index files, then a file's directory, then the block it reads and unpacks, and reads the
record's range of its archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridair.llm.common import filesystem, fresh, written

#: Payloads of fewer bytes are never revisits.  Captures of an index block.  Bytes after which a task begins a new archive.
LEAST, BLOCK, ARCHIVE = 100, 3000, 1 << 30
NO_ID = -(1 << 63)
CAPTURE = "url_key string, page_id long, archive string, at long, size long"


def url_key(url: str | None) -> str:
    """Host labels in reverse, port unless it is the scheme's, path and query; no scheme, user or fragment.  Null: empty."""
    if not url:
        return ""
    scheme, _, rest = url.partition("://") if "://" in url else ("", "", url)
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    host, _, port = host.partition(":")
    port = "" if (scheme.lower(), port) in (("http", "80"), ("https", "443"), (scheme.lower(), "")) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (path or "/")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """A WARC record as one gzip member; a revisit holds no payload, only the digest and the record it refers to."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": date,
            "WARC-Target-URI": "".join((url or "").splitlines()), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of a record."""
    raw = gzip.decompress(member)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for every row and returns the captures (``CAPTURE``), a written table.

    A null payload is empty, a null URL has the empty key.  Of equal payloads of at least 100 bytes the smallest page
    id is the response (several rows with that id: each of them); all others refer to it.  A payload that only rows
    without an id have is written by each of them.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
    same = written(same.where("n > 1").select("digest", "first_id"), "equal-payloads")
    typed = rows.join(same, "digest", "left").select("page_id", "url", "html", "digest", F.expr("case when page_id is null or page_id <> first_id then first_id end").alias("refers_to"))
    folder = fresh(pages.sparkSession, "archives")

    def run(batches):
        part, out, at, name = TaskContext.get().partitionId(), None, 0, ""
        for batch in batches:
            rows = []
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    fs, path = filesystem(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz")
                    fs.create_dir(path.rsplit("/", 1)[0])
                    name, out, at = f"{folder}/{path.rsplit('/', 1)[1]}", fs.open_output_stream(path, compression=None), 0
                data = record(page, url, html.encode(), refers, digest, date)
                out.write(data)
                rows.append((url_key(url), page, name, at, len(data)))
                at += len(data)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["url_key", "page_id", "archive", "at", "size"])
        if out is not None:
            out.close()
    return written(typed.mapInArrow(run, CAPTURE), "captures")


def _sort_id(page: int | None) -> int:
    return NO_ID if page is None else page


def write_index(captures: DataFrame) -> DataFrame:
    """Writes index files over ranges of (key, page) and returns their list (path, first_key, first_page, directory_at, directory_size), a written table.

    A key with very many captures is dealt out by page.
    """
    folder = fresh(captures.sparkSession, "capture-index")

    def run(batches):
        part, block, directory, out, at, path = TaskContext.get().partitionId(), [], [], None, 0, ""

        def close():
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode())
            directory.append([block[0][0], block[0][1], at, len(data)])
            out.write(data)
            at, block = at + len(data), []
        for batch in batches:
            for key, page, archive, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, path = filesystem(f"{folder}/{part:06d}-{uuid.uuid4().hex}.idx")
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out = fs.open_output_stream(path, compression=None)
                block.append([key, _sort_id(page), archive, start, size])
                if len(block) == BLOCK:
                    close()
        if out is not None:
            if block:
                close()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())],
                                             ["path", "first_key", "first_page", "directory_at", "directory_size"])
    dealt = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "archive", "at")
    return written(dealt.mapInArrow(run, "path string, first_key string, first_page long, directory_at long, directory_size long"), "index-files")


class CaptureIndex:
    """Lookups of captures; ``files`` is the list of index files in order.  Each worker keeps a few blocks and archives open."""

    def __init__(self, files: list[tuple]):
        self.files = sorted(files, key=lambda f: f[1:3])
        self.starts = [f[1:3] for f in self.files]
        self.open = lru_cache(64)(lambda uri: (lambda x: x[0].open_input_file(x[1]))(filesystem(uri)))
        self.directory = lru_cache(16)(self._directory)
        self.block = lru_cache(8)(self._block)

    def _directory(self, k: int) -> list[tuple]:
        path, _, _, at, size = self.files[k]
        return [((key, page), start, n) for key, page, start, n in json.loads(zlib.decompress(self.open(path).read_at(size, at)))]

    def _block(self, k: int, at: int, size: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.open(self.files[k][0]).read_at(size, at)).split(b"\n")]

    def find(self, key: str, page: int | None = None) -> list[list]:
        """Captures [key, page, archive, at, size] of a key, all of them or those of one page (``NO_ID``: rows without one)."""
        low = (key, NO_ID if page is None else page)
        out = []
        k = max(0, bisect.bisect_left(self.starts, low) - 1)
        while k < len(self.files) and self.starts[k][0] <= key:
            places = self.directory(k)
            b = max(0, bisect.bisect_left(places, low, key=lambda p: p[0]) - 1)
            while b < len(places) and places[b][0][0] <= key and (page is None or places[b][0] <= low):
                rows = self.block(k, *places[b][1:])
                i = bisect.bisect_left(rows, low, key=lambda r: (r[0], r[1]))
                while i < len(rows) and rows[i][0] == key and (page is None or rows[i][1] == page):
                    out.append(rows[i])
                    i += 1
                b += 1
            k += 1
        return out

    def read(self, archive: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        return parse(self.open(archive).read_at(size, at))


def lookup(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Reads the records of the captures ``wanted`` (url, page_id) through the index: (page_id, url, record_type, refers_to, payload, digest).

    Every different (url, page_id) of ``wanted`` gives all its records.
    """
    listed = [tuple(r) for r in files.collect()]  # one row an index file

    def run(batches):
        index = CaptureIndex(listed) if listed else None
        for batch in batches:
            rows, held = [], 0
            pages, urls = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for key, page, url in zip(batch.column(0).to_pylist(), pages, urls, strict=True):
                for _, _, archive, at, size in index.find(key, _sort_id(page)):
                    head, payload = index.read(archive, at, size)
                    if head["WARC-Target-URI"] != "".join((url or "").splitlines()):
                        continue  # another address of the same key
                    refers = head.get("WARC-Refers-To")
                    rows.append((_page(head["WARC-Record-ID"]), url, head["WARC-Type"], refers and _page(refers), payload if refers is None else None, head["WARC-Payload-Digest"].removeprefix("sha256:")))
                    held += len(payload)
                if held > 32 << 20:
                    yield pack(rows)
                    rows, held = [], 0
            yield pack(rows)

    def pack(rows):
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)],
                                          ["page_id", "url", "record_type", "refers_to", "payload", "digest"])

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), *batch.columns], ["url_key", "page_id", "url"])
    keyed = wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).distinct().mapInArrow(keys, "url_key string, page_id long, url string")
    near = keyed.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return near.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, digest string")


def verify(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records read back; a revisit's payload is that of its response."""
    def check(batches):
        for batch in batches:
            sizes, sums = [], []
            for payload, said in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                sizes.append(None if payload is None else len(payload))
                sums.append(said if payload is None else hashlib.sha256(payload).hexdigest())
                if sums[-1] != said:
                    raise ValueError("a payload read back differs from its digest")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])
    read = written(records.select("page_id", "record_type", "refers_to", "payload", "digest").mapInArrow(check, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"), "records")
    full = read.where("record_type = 'response'")
    sizes = full.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = read.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(*columns).union(again.select(*columns))
