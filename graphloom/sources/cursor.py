"""A table read as a stream past a typed cursor, as a Python data source.

``spark.dataSource.register(CursorSource)``, then ``spark.readStream.format("cursor_rows")`` with the
options ``path`` (Parquet files that every executor can open), ``cursor`` (a column) and ``kind`` (string, long,
timestamp or date).  A batch holds the rows whose cursor lies past the last committed one and not
past the largest there is; the offset is that cursor, compared by its type: text as text.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# How each kind of cursor is read from and written to an offset.
KINDS = {
    "string": (pa.string(), str, str), "long": (pa.int64(), int, str), "timestamp": (pa.timestamp("us"), dt.datetime.fromisoformat, lambda v: v.isoformat()), "date": (pa.date32(), dt.date.fromisoformat, lambda v: v.isoformat()),
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, base = _open(path)
    if fs.get_file_info(base).type == pafs.FileType.File:
        return [base]
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith((".", "_")))


class Part(InputPartition):
    """Row groups of one file whose cursors may lie past ``after`` and not past ``upto``."""

    def __init__(self, file: str, groups: list[int], after: str | None, upto: str):
        self.file, self.groups, self.after, self.upto = file, groups, after, upto


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.cursor, self.columns = options["path"], options["cursor"], columns
        self.type, self.parse, self.show = KINDS[options.get("kind", "string")]
        self.first, self.mark = options.get("after"), options.get("mark")

    def initialOffset(self) -> dict:
        return {"after": self.first}

    def _ranges(self) -> Iterator[tuple[str, int, object, object]]:
        """``(file, row group, least, largest)`` cursor of each row group: from its statistics, else from its cursor column."""
        fs, _ = _open(self.path)
        for file in _files(self.path):
            with fs.open_input_file(file) as f:
                table = pq.ParquetFile(f)
                for g in range(table.metadata.num_row_groups):
                    part = table.metadata.row_group(g)
                    at = next(i for i in range(part.num_columns) if part.column(i).path_in_schema == self.cursor)
                    stats = part.column(at).statistics
                    if stats is not None and stats.has_min_max and self.type != pa.string():  # text statistics may be cut short
                        limits = pa.array([stats.min, stats.max]).cast(self.type)
                    else:
                        found = pc.min_max(table.read_row_group(g, columns=[self.cursor]).column(0).cast(self.type))
                        limits = [found["min"], found["max"]]
                    yield file, g, *[x.as_py() for x in limits]

    def latestOffset(self) -> dict:
        largest = max((hi for *_, hi in self._ranges() if hi is not None), default=None)
        return {"after": self.first if largest is None else self.show(largest)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start == end or end["after"] is None:
            return []
        low = None if start["after"] is None else self.parse(start["after"])
        high, groups = self.parse(end["after"]), {}
        for file, g, least, largest in self._ranges():
            if least is None:
                if low is None:
                    groups.setdefault(file, []).append(g)
            elif least <= high and (low is None or largest > low):
                groups.setdefault(file, []).append(g)
        return [Part(file, [g], start["after"], end["after"]) for file, found in groups.items() for g in found]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        low, high = (None if v is None else pa.scalar(self.parse(v), self.type) for v in (partition.after, partition.upto))
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(10_000, row_groups=partition.groups):
                at = batch.column(batch.schema.get_field_index(self.cursor)).cast(self.type)
                past = pc.less_equal(at, high)
                # rows without a cursor come once, with the first batch
                wanted = pc.fill_null(past, True) if low is None else pc.fill_null(pc.and_(past, pc.greater(at, low)), False)
                yield batch.filter(wanted).select(self.columns)

    def commit(self, end: dict) -> None:
        """After a batch is done: the cursor, written aside and moved to the path of option ``mark``."""
        if self.mark:
            fs, path = _open(self.mark)
            with fs.open_output_stream(path + ".new") as f:
                f.write(json.dumps(end).encode())
            fs.move(path + ".new", path)


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_rows"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, _ = _open(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Parquet files in {self.options['path']}")
        with fs.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True)

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options), schema.fieldNames())
