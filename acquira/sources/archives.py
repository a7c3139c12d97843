"""Archives as tables: named arrays of vectors (.npz), read by ranges of rows and written with a commit; tar files by ranges of members.

Paths are of file systems that pyarrow opens (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of an archive that one task reads, and rows of one that a task writes.
READ_ROWS, WRITE_ROWS = 100_000, 1_000_000
#: Bytes of tar members that one task reads, about.
TAR_BYTES = 64 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; Spark writes local ones as file:/..."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str, ending: str) -> list[str]:
    system, inside = place(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [inside]
    found = system.get_file_info(fs.FileSelector(inside, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and "/_" not in f.path.removeprefix(inside))


def _header(member) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(member)
    if kind.hasobject or (by_columns and len(shape) > 1):
        raise ValueError("arrays of objects or in column order are not read")
    return shape, kind


def headers(path: str, system: fs.FileSystem) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    """Shape and type of each array of an archive, without its values."""
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        out = {}
        for name in z.namelist():
            with z.open(name) as member:
                out[name.removesuffix(".npy")] = _header(member)
        return out


def scalar(path: str, system: fs.FileSystem, name: str) -> str | None:
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        if f"{name}.npy" not in z.namelist():
            return None
        return str(np.load(io.BytesIO(z.read(f"{name}.npy")), allow_pickle=False))


def _type(kind: np.dtype, vector: bool) -> T.DataType:
    one = {"f": T.DoubleType() if kind.itemsize == 8 else T.FloatType(), "i": T.LongType(), "u": T.LongType(), "b": T.BooleanType(), "U": T.StringType()}.get(kind.kind)
    if one is None:
        raise ValueError(f"arrays of {kind} are not read")
    return T.ArrayType(one) if vector else one


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.version = schema, options["path"], options.get("version")
        self.step = int(options.get("rows_per_task", READ_ROWS))

    def partitions(self) -> list[Rows]:
        system, _ = place(self.path)
        out = []
        for path in files_of(self.path, ".npz"):
            if self.version is not None and (found := scalar(path, system, "version")) != self.version:
                raise ValueError(f"{path} has version {found}, not {self.version}")
            n = max((s[0] for s, _ in headers(path, system).values() if s), default=0)
            out += [Rows(path, i, min(i + self.step, n)) for i in range(0, n, self.step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.last <= partition.first:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = place(self.path)
        target, columns = to_arrow_schema(self.schema), {}
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            for field in self.schema.fields:
                if field.name == "row":
                    columns["row"] = pa.array(np.arange(partition.first, partition.last))
                    continue
                with z.open(f"{field.name}.npy") as member:
                    shape, kind = _header(member)
                    size = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
                    member.seek(size * partition.first, io.SEEK_CUR)
                    x = np.frombuffer(member.read(size * (partition.last - partition.first)), kind)
                x = x.astype(np.float32) if kind == np.float16 else x
                if len(shape) == 1:
                    columns[field.name] = pa.array(x)
                else:
                    width = int(np.prod(shape[1:], dtype=np.int64))
                    columns[field.name] = pa.ListArray.from_arrays(pa.array(np.arange(partition.last - partition.first + 1, dtype=np.int32) * width), pa.array(x))
        yield from pa.table([columns[c].cast(target.field(c).type) for c in target.names], target.names).to_batches(max_chunksize=10_000)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of WRITE_ROWS rows at most beside the folder's content; they are moved there when all have ended."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite
        self.half, self.version = [c for c in options.get("half", "").split(",") if c], options.get("version")
        self.staged = f"{place(self.path)[1].rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def _array(self, name: str, column: pa.ChunkedArray) -> np.ndarray:
        if column.null_count:
            raise ValueError(f"{name} has rows without a value")
        flat = column.combine_chunks()
        if pa.types.is_list(flat.type):
            values = flat.flatten()
            sizes = np.diff(flat.offsets.to_numpy())
            if values.null_count or (len(sizes) and (sizes != sizes[0]).any()):
                raise ValueError(f"vectors of {name} differ in length or lack entries")
            x = values.to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        elif pa.types.is_string(flat.type):
            x = np.array(flat.to_pylist(), np.str_)
        else:
            x = flat.to_numpy(zero_copy_only=False)
        return x.astype(np.float16) if name in self.half else x

    def _flush(self, held: list[pa.RecordBatch]) -> str:
        system, _ = place(self.path)
        table = pa.Table.from_batches(held)
        system.create_dir(self.staged, recursive=True)
        name = f"{self.staged}/part-{uuid.uuid4().hex}.npz"
        with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for c in table.column_names:
                with z.open(f"{c}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array(member, np.ascontiguousarray(self._array(c, table[c])), allow_pickle=False)
            if self.version is not None:
                with z.open("version.npy", "w") as member:
                    np.lib.format.write_array(member, np.array(self.version), allow_pickle=False)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held, n, files = [], 0, []
        for b in iterator:
            while b.num_rows:
                part = b.slice(0, WRITE_ROWS - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == WRITE_ROWS:
                    files.append(self._flush(held))
                    held, n = [], 0
        if n:
            files.append(self._flush(held))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = place(self.path)
        old = files_of(self.path, ".npz") if self.overwrite else []
        system.create_dir(inside, recursive=True)
        for m in messages:
            for f in m.files if m else []:  # the archives of attempts that didn't end are not among them
                system.move(f, f"{inside.rstrip('/')}/{f.rsplit('/', 1)[-1]}")
        for f in old:
            system.delete_file(f)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _ = place(self.path)
        if system.get_file_info(self.staged).type == fs.FileType.Directory:
            system.delete_dir(self.staged)


class VectorArchive(DataSource):
    """Format ``vector_archive``: a row for each place of the arrays, vectors as arrays of numbers, ``row`` the place in its archive.

    Half floats are read as floats, and written of the columns that the option ``half`` lists. With the option ``version`` archives of
    another version are refused, and it is written. ``rows_per_task`` is how many rows of an archive a task reads. Arrays of another length than the longest take no part.
    """

    @classmethod
    def name(cls) -> str:
        return "vector_archive"

    def schema(self) -> T.StructType:
        system, _ = place(self.options["path"])
        found = files_of(self.options["path"], ".npz")
        if not found:
            raise ValueError(f"no archives at {self.options['path']}")
        arrays = headers(found[0], system)
        n = max((s[0] for s, _ in arrays.values() if s), default=0)
        return T.StructType([*(T.StructField(k, _type(kind, len(s) > 1)) for k, (s, kind) in arrays.items() if s and s[0] == n and k != "row"), T.StructField("row", T.LongType())])

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(schema, dict(self.options), overwrite)


def read_vectors(spark: SparkSession, path: str, *, version: str | None = None, rows_per_task: int = READ_ROWS) -> DataFrame:
    spark.dataSource.register(VectorArchive)
    r = spark.read.format("vector_archive").option("rows_per_task", rows_per_task)
    return (r if version is None else r.option("version", version)).load(path)


def write_vectors(df: DataFrame, path: str, *, half: tuple[str, ...] = (), version: str | None = None, mode: str = "append") -> None:
    """df as archives below path; a failed write leaves nothing there. Nulls and vectors that differ in length are refused."""
    df.sparkSession.dataSource.register(VectorArchive)
    w = df.write.format("vector_archive").mode(mode).option("half", ",".join(half))
    (w if version is None else w.option("version", version)).save(path)


def tar_index(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """path, name, offset, size of the files in tar archives: their headers alone are read, an archive by a task."""

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                system, inside = place(p)
                with system.open_input_file(inside) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    found = [(m.name, m.offset_data, m.size) for m in tar if m.isfile() and m.name.endswith(ending)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True))], ["path", "name", "offset", "size"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").mapInArrow(run, "path string, name string, offset long, size long")


def tar_members(index: DataFrame) -> DataFrame:
    """path, name, content of an index's members: tasks read ranges of about TAR_BYTES of an archive, whatever archives are large."""

    def run(batches):
        open_, handle = None, None
        for b in batches:
            content = []
            for p, offset, size in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if p != open_:
                    system, inside = place(p)
                    open_, handle = p, system.open_input_file(inside)
                content.append(handle.read_at(size, offset))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary())], ["path", "name", "content"])

    piece = F.floor(F.col("offset") / TAR_BYTES)
    n = index.agg(F.count_distinct("path", piece)).first()[0]
    return index.repartition(max(n, 1), "path", piece).sortWithinPartitions("path", "offset").mapInArrow(run, "path string, name string, content binary")
