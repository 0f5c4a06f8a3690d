"""Sparse matrices in .npz files as a Spark data source: rows (row, col, value).

A file is one partition and is read as a stream: its members are unpacked side by side, CHUNK entries at a time, so memory
does not grow with the file. Writing gives a file a task, hence as many partitions when it is read again.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from litweave.sources.files import list_files, open_fs

#: Entries in memory at once.
CHUNK = 1 << 18


@dataclass
class MatrixFile(InputPartition):
    """A file."""

    path: str


class Member:
    """An array of a .npz file, read in pieces."""

    def __init__(self, z: zipfile.ZipFile, name: str) -> None:
        self.raw = z.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.raw)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, self.dtype = read(self.raw)
        self.left = shape[0] if shape else 1

    def take(self, n: int) -> np.ndarray:
        """The next n entries, fewer at the end."""
        n = min(n, self.left)
        self.left -= n
        want, parts = n * self.dtype.itemsize, []
        while want:
            part = self.raw.read(want)
            if not part:
                raise ValueError("matrix file ends early")
            parts.append(part)
            want -= len(part)
        return np.frombuffer(b"".join(parts), self.dtype)


class NpzReader(DataSourceReader):
    """Reads compressed-row (csr) and coordinate (coo) files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[MatrixFile]:
        return [MatrixFile(f) for f in list_files(self.path, ".npz")]

    def read(self, part: MatrixFile) -> Iterator[tuple[int, int, float]]:
        system, at = open_fs(part.path)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            kind = "csr"
            if "format.npy" in z.namelist():
                kind = Member(z, "format").take(1)[0]
                kind = kind.decode() if isinstance(kind, bytes) else str(kind)
            if kind == "csr":
                yield from self._csr(z)
            elif kind == "coo":
                row, col, data = Member(z, "row"), Member(z, "col"), Member(z, "data")
                while row.left:
                    yield from zip(row.take(CHUNK).tolist(), col.take(CHUNK).tolist(), data.take(CHUNK).astype(float).tolist(), strict=True)
            else:
                raise ValueError(f"matrix format {kind}")

    @staticmethod
    def _csr(z: zipfile.ZipFile) -> Iterator[tuple[int, int, float]]:
        ptr, col, data = Member(z, "indptr"), Member(z, "indices"), Member(z, "data")
        before, first = ptr.take(1), 0
        while ptr.left:
            ends = ptr.take(CHUNK)
            bounds = np.concatenate([before, ends]).astype(np.int64)
            n, done = int(bounds[-1] - bounds[0]), 0
            while done < n:  # a row may have more entries than fit at once
                m = min(CHUNK, n - done)
                row = first + np.searchsorted(bounds, bounds[0] + done + np.arange(m), side="right") - 1
                yield from zip(row.tolist(), col.take(m).tolist(), data.take(m).astype(float).tolist(), strict=True)
                done += m
            before, first = ends[-1:], first + len(ends)


@dataclass
class Written(WriterCommitMessage):
    """A part file."""

    path: str | None


class NpzWriter(DataSourceWriter):
    """Writes a coordinate file a task. Entries are held as three typed arrays until the task ends."""

    def __init__(self, path: str, shape: tuple[int, int]) -> None:
        self.path, self.shape = path, shape

    def write(self, rows: Iterator) -> Written:
        from array import array

        row, col, data = array("q"), array("q"), array("d")
        for r in rows:
            row.append(r[0])
            col.append(r[1])
            data.append(r[2])
        if not row:
            return Written(None)
        system, at = open_fs(self.path)
        system.create_dir(at, recursive=True)
        to = f"part-{uuid.uuid4().hex}.npz"
        a, b, x = np.frombuffer(row, np.int64), np.frombuffer(col, np.int64), np.frombuffer(data, np.float64)
        shape = (max(self.shape[0], int(a.max()) + 1), max(self.shape[1], int(b.max()) + 1))
        with system.open_output_stream(f"{at}/{to}") as f:
            np.savez_compressed(_Appending(f), row=a, col=b, data=x, shape=np.array(shape), format=b"coo")
        return Written(f"{self.path}/{to}")

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path:
                system, at = open_fs(m.path)
                system.delete_file(at)


class _Appending:
    """A write-only stream in the form that the archive writer asks for."""

    def __init__(self, raw) -> None:
        self.raw = raw

    def write(self, data) -> int:
        self.raw.write(bytes(data))
        return len(data)

    def read(self, *_):
        raise OSError("write only")

    def flush(self) -> None:
        self.raw.flush()


class NpzSource(DataSource):
    """spark.dataSource.register(NpzSource); spark.read.format("npz").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], (int(self.options.get("rows", 0)), int(self.options.get("cols", 0))))
