"""Delimited files as cells, read as a stream: no file, and no file's cells, are held whole.

Executors open the files themselves, so contents are never shuffled; what is dealt out is one row
for each file. A file is read twice: the first reading only looks for faults, so that a fault on the last line
still takes all of the file's rows back before any of them is given out. Previews read the first rows only.
``register`` makes the same reader a Spark data source, ``spark.read.format("delimited_cells")``.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": ";"}
#: Stores that executors can open by themselves.
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")
CELLS = pa.schema([("file_id", pa.int64()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("lexeme", pa.string()), ("error", pa.string())])
CELLS_DDL = "file_id long, row_no int, col_no int, lexeme string, error string"
#: Cells in one batch, and characters in one field, at most.
BATCH_CELLS, FIELD_CHARACTERS = 50_000, 64 << 20


def readable_directly(paths: list[str]) -> bool:
    """Whether executors can open all paths without Spark's file systems."""
    return all((p.split(":", 1)[0] in SCHEMES) if ":/" in p else p.startswith("/") for p in paths)


def _opened(path: str) -> io.BufferedReader:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return io.BufferedReader(system.open_input_stream(inside), 1 << 20)


def _lines(stream: io.BufferedReader) -> Iterator[str]:
    for line in io.TextIOWrapper(stream, "utf-8-sig", newline=""):
        if "\0" in line:
            raise ValueError("NUL_BYTE")
        yield line


def _rows(path: str, delimiter: str) -> Iterator[list[str]]:
    csv.field_size_limit(FIELD_CHARACTERS)
    with _opened(path) as stream:
        if not stream.peek(1):
            raise ValueError("EMPTY_FILE")
        yield from csv.reader(_lines(stream), delimiter=delimiter, strict=True)


def fault_of(path: str, delimiter: str) -> str | None:
    """The code of the first fault anywhere in a file, or None."""
    try:
        for _ in _rows(path, delimiter):
            pass
    except UnicodeDecodeError:
        return "INVALID_UTF8"
    except csv.Error:
        return "DELIMITED_SYNTAX_INVALID"
    except FileNotFoundError:
        return "FILE_MISSING"
    except ValueError as fault:
        return str(fault)
    return None


def _batch(file_id: int, rows: list[list[str]], first: int) -> pa.RecordBatch:
    widths = np.array([len(r) for r in rows], np.int64)
    n = int(widths.sum())
    numbers = np.repeat(np.arange(first, first + len(rows), dtype=np.int32), widths)
    columns = (np.arange(n) - np.repeat(np.cumsum(widths) - widths, widths) + 1).astype(np.int32)
    lexemes = pa.array([v for r in rows for v in r], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, file_id)), pa.array(numbers), pa.array(columns), lexemes, pa.nulls(n, pa.string())], schema=CELLS)


def _failed(file_id: int, code: str) -> pa.RecordBatch:
    none = lambda t: pa.nulls(1, t)
    return pa.RecordBatch.from_arrays([pa.array([file_id], pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.string()), pa.array([code])], schema=CELLS)


def file_cells(file_id: int, path: str, delimiter: str, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A file's cells in batches, row 0 the header; or one row with the code of its fault.

    With ``most_rows`` only so many rows after the header that hold something are read, and only faults in
    what is read are told.
    """
    if most_rows is None and (code := fault_of(path, delimiter)):
        yield _failed(file_id, code)
        return
    held: list[list[str]] = []
    cells, first, filled, failed = 0, 0, 0, None
    try:
        for n, row in enumerate(_rows(path, delimiter)):
            held.append(row)
            cells += len(row)
            filled += n > 0 and any(row)
            if cells >= BATCH_CELLS and most_rows is None:
                yield _batch(file_id, held, first)
                held, cells, first = [], 0, n + 1
            if most_rows is not None and filled >= most_rows:
                break
    except UnicodeDecodeError:
        failed = "INVALID_UTF8"
    except csv.Error:
        failed = "DELIMITED_SYNTAX_INVALID"
    except FileNotFoundError:
        failed = "FILE_MISSING"
    except ValueError as fault:
        failed = str(fault)
    if failed:
        yield _failed(file_id, failed)
    elif held:
        yield _batch(file_id, held, first)


def _dealt(sources: DataFrame, files_per_task: int) -> DataFrame:
    n = sources.count()
    return sources.repartition(max(1, -(-n // files_per_task), min(n, sources.sparkSession.sparkContext.defaultParallelism)), "path")


def stream_digests(sources: DataFrame, files_per_task: int = 64) -> DataFrame:
    """``path, sha256`` of files, read in pieces; a file that is gone has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    with _opened(path) as stream:
                        while piece := stream.read(1 << 20):
                            digest.update(piece)
                    digests.append(digest.hexdigest())
                except FileNotFoundError:
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "sha256"])

    return _dealt(sources.select("path").distinct(), files_per_task).mapInArrow(read, "path string, sha256 string")


def stream_contents(sources: DataFrame, files_per_task: int = 64) -> DataFrame:
    """``file_id, content`` of the files in ``sources (file_id, path)``, each read where its row goes on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.int64()), pa.array([stream.read()], pa.binary())], ["file_id", "content"])

    return _dealt(sources.select(F.col("file_id").cast("long"), "path"), files_per_task).mapInArrow(read, "file_id long, content binary")


def stream_cells(sources: DataFrame, delimiter: str | None = None, most_rows: int | None = None, files_per_task: int = 64) -> DataFrame:
    """``file_id, row_no, col_no, lexeme, error`` of the files in ``sources (file_id, path, extension)``.

    Tasks get about ``files_per_task`` files each, by a hash of the path; the rows that are dealt out have paths only.
    """
    given = DELIMITERS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from file_cells(file_id, path, delimiter or given.get(ext, ","), most_rows)

    return _dealt(sources.select(F.col("file_id").cast("long"), "path", "extension"), files_per_task).mapInArrow(read, CELLS_DDL)


class _File(InputPartition):
    def __init__(self, file_id: int, path: str, delimiter: str) -> None:
        self.file_id, self.path, self.delimiter = file_id, path, delimiter


class _CellReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.delimiter = options.get("delimiter")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.most_rows = int(options["rows"]) if "rows" in options else None

    def partitions(self) -> list[InputPartition]:
        """One for each file, in the order of the paths, as the listing gives them."""
        path = "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path
        system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        about = system.get_file_info(inside)
        found = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=self.recursive))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
        ext = lambda p: "." + p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else ""
        return [_File(i, prefix + p, self.delimiter or DELIMITERS.get(ext(p), ",")) for i, p in enumerate(files, 1)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from file_cells(partition.file_id, partition.path, partition.delimiter, self.most_rows)


class DelimitedCells(DataSource):
    """``format("delimited_cells")``: options ``delimiter``, ``recursive``, and ``rows`` to read the first rows
    of each file only. Files are numbered from 1 in the order of their paths."""

    @classmethod
    def name(cls) -> str:
        return "delimited_cells"

    def schema(self) -> str:
        return CELLS_DDL

    def reader(self, schema) -> DataSourceReader:
        return _CellReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DelimitedCells)
