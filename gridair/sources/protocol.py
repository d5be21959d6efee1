"""Source protocols: satellite, weather and ground truth as one Spark data source over partitioned Parquet folders.

A provider writes a folder for each partition value (``area_id=3/day=2024-01-05/part-0.parquet``); the source knows the
columns that each kind of table must have, lists the folders, keeps those that the filters on partition columns leave, and
deals their files to tasks of about equal size.  A provider with many areas of few cells leaves a level out
(``day=2024-01-05/part-0.parquet``): that column is then read, and its filters are applied, in the files.

    spark.dataSource.register(ProtocolSource)
    spark.read.format("gridair").option("kind", "satellite").load(folder).where("area_id = 3")
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual)
from pyspark.sql.types import StructType

#: Columns of each kind of table: those of the files, then those of the folders (or of the files, where a level is left out).
CONTRACTS = {
    "satellite": ("row int, col int, no2 double", "area_id int, day date"),
    "weather": ("row int, col int, u10 double, v10 double, blh double", "area_id int, day date"),
    "ground": ("station_id string, lat double, lon double, day date, no2 double", "year int"),
}
#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20
_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "date": pa.date32()}
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Files(InputPartition):
    """Files of a task, with the values of their folders by column."""

    files: list[tuple[str, dict]]

    def __init__(self, files: list[tuple[str, dict]]):
        super().__init__(len(files))
        self.files = files


def _filesystem(path: str):
    from pyarrow import fs
    path = path.removeprefix("file:") if not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _parsed(text: str, kind: str):
    if text == _NULL:
        return None
    return {"int": int, "date": dt.date.fromisoformat, "string": str}[kind](unquote(text))


def _passes(value, test: Filter) -> bool:
    if isinstance(test, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(test, In):
        return value in test.value
    return {EqualTo: value == test.value, GreaterThan: value > test.value, GreaterThanOrEqual: value >= test.value,
            LessThan: value < test.value, LessThanOrEqual: value <= test.value}[type(test)]


def _mask(column: pa.Array, test: Filter) -> pa.Array:
    """Which values of a column in a file pass; a missing value passes nothing."""
    if isinstance(test, IsNotNull):
        return column.is_valid()
    if isinstance(test, In):
        found = pc.is_in(column, value_set=pa.array([v for v in test.value if v is not None], column.type))
    else:
        compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}[type(test)]
        found = compare(column, pa.scalar(test.value, column.type))
    return pc.and_(column.is_valid(), pc.fill_null(found, False))


class ProtocolReader(DataSourceReader):
    """Reads the folders that pushed filters leave; a file without a column of the contract stops the read by name."""

    def __init__(self, path: str, kind: str):
        columns, folders = CONTRACTS[kind]
        self.path, self.kind = path, kind
        self.columns = [c.split() for c in columns.split(", ")]
        self.folders = [c.split() for c in folders.split(", ")]
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters on folder columns; Spark applies the rest."""
        known = {name for name, _ in self.folders}
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.tests.append((f.attribute[0], f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs
        store, root = _filesystem(self.path)
        found = []
        level = [(root, {})]
        for name, kind in self.folders:
            below = []
            for folder, values in level:
                parts = [(e.path, e.base_name.partition("=")) for e in store.get_file_info(fs.FileSelector(folder)) if e.type == fs.FileType.Directory]
                named = [(path, _parsed(text, kind)) for path, (key, _, text) in parts if key == name]
                below += [(path, {**values, name: value}) for path, value in named if all(_passes(value, test) for column, test in self.tests if column == name)]
                if not named:
                    below.append((folder, values))
            level = below
        for folder, values in level:
            found += [(e.path, values, e.size) for e in store.get_file_info(fs.FileSelector(folder)) if e.type == fs.FileType.File and e.base_name.endswith(".parquet")]
        tasks, held, size = [], [], 0
        for path, values, n in sorted(found, key=lambda f: f[0]):
            if held and size + n > TASK_BYTES:
                tasks.append(Files(held))
                held, size = [], 0
            held.append((path, values))
            size += n
        return tasks + [Files(held)] * bool(held) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        whole = pa.schema([(name, _ARROW[kind]) for name, kind in self.columns + self.folders])
        store, _ = _filesystem(self.path)
        for path, values in partition.files:
            inside = [name for name, _ in self.columns + self.folders if name not in values]
            tests = [(column, test) for column, test in self.tests if column not in values]
            with store.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                missing = [name for name in inside if name not in file.schema_arrow.names]
                if missing:
                    raise ValueError(f"{self.kind} table {path} is missing columns: {missing}")
                for batch in file.iter_batches(columns=inside):
                    columns = [batch.column(f.name).cast(f.type) if f.name in inside else pa.array([values[f.name]] * batch.num_rows, f.type) for f in whole]
                    rows = pa.RecordBatch.from_arrays(columns, schema=whole)
                    for column, test in tests:
                        rows = rows.filter(_mask(rows.column(column), test))
                    yield rows


class ProtocolSource(DataSource):
    """Format ``gridair``; option ``kind`` is one of ``CONTRACTS``."""

    @classmethod
    def name(cls) -> str:
        return "gridair"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in CONTRACTS:
            raise ValueError(f"option kind must be one of {sorted(CONTRACTS)}, not {kind!r}")
        return kind

    def schema(self) -> str:
        return ", ".join(CONTRACTS[self._kind()])

    def reader(self, schema: StructType) -> ProtocolReader:
        return ProtocolReader(self.options["path"], self._kind())


def register(spark) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProtocolSource)
