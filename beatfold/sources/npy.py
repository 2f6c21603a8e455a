"""A data source of .npy matrices whose files are read by ranges of rows, so that one large file is the work of many tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "prec_window int, succ_window int, global_label int, record long, samples array<float>"
RANGE_BYTES = 128 << 20


@dataclass
class Range(InputPartition):
    """Some rows of a file: where they begin, how many they are, and how a row is laid out."""

    path: str
    at: int
    rows: int
    columns: int
    kind: str


def opened(path: str):
    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, inner


def files(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the .npy files at a path."""
    where, inner = opened(path)
    found = where.get_file_info([inner])[0]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [found] if found.is_file else where.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path.split("://", 1)[0] + "://" if "://" in path else "file://" if path.startswith("file:") else ""
    return sorted((scheme + x.path, x.size) for x in every if x.is_file and x.path.endswith(".npy"))


def header(path: str) -> tuple[int, tuple[int, ...], str]:
    """(where the rows begin, shape, kind of number)"""
    where, inner = opened(path)
    with where.open_input_file(inner) as f:
        major, _ = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
        if by_column or kind.hasobject or len(shape) != 2:
            raise ValueError(f"{path} is not a matrix of numbers stored row by row")
        return f.tell(), shape, kind.str


def windows(m: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of `size` samples and the four numbers behind them."""
    samples = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * size), pa.array(m[:, :size].astype(np.float32).reshape(-1)))
    return pa.RecordBatch.from_arrays([*[pa.array(m[:, size + i].astype(np.int32)) for i in range(3)], pa.array(m[:, size + 3].astype(np.int64)), samples], ["prec_window", "succ_window", "global_label", "record", "samples"])


class NpyWindows(DataSource):
    """spark.read.format("npy_windows"): options path, size (samples of a window) and range_bytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "npy_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.most = options["path"], int(options.get("size", 6000)), int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """Only the headers are read here."""
        found = []
        for path, _ in files(self.path):
            at, (rows, columns), kind = header(path)
            wide = columns * np.dtype(kind).itemsize
            step = max(1, self.most // max(1, wide))
            found += [Range(path, at + k * wide, min(step, rows - k), columns, kind) for k in range(0, rows, step)]
        return found

    def read(self, part: Range):
        if part is None or not getattr(part, "rows", 0):
            return
        where, inner = opened(part.path)
        wide = part.columns * np.dtype(part.kind).itemsize
        with where.open_input_file(inner) as f:
            for k in range(0, part.rows, 256):
                n = min(256, part.rows - k)
                f.seek(part.at + k * wide)
                yield windows(np.frombuffer(f.read(n * wide), part.kind).reshape(n, part.columns), self.size)
