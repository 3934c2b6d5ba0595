"""Arrow IPC files as a source and a sink: ``spark.read/write.format("beacon_arrow")``.

The sink writes one file for each value of the column ``file``, in record batches, plain, gzipped or both. Tasks write under
names of their own that end in .working; only when every task is done does the commit give the files their names, and a
write that fails leaves nothing. The source splits IPC files by record batches over tasks and reads the columns asked for.
Paths are local or URIs that pyarrow's file systems open; driver and executors must share them.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from beaconlake.sources.files import GLOBAL_LAYOUT

#: Where the name of a file that rows come from or go to is kept.
FILE = "file"
#: Bytes of an IPC file from which on it is read by several tasks.
SPLIT = 64 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def laid_out(body: pa.RecordBatch) -> pa.RecordBatch:
    """Columns of the output layout in its types; values beyond a type's range are held at its end."""
    columns, fields = [], []
    for name, column in zip(body.schema.names, body.columns, strict=True):
        kind = GLOBAL_LAYOUT.get(name, column.type)
        if pa.types.is_unsigned_integer(kind):
            column = pc.max_element_wise(pc.min_element_wise(column.cast(pa.int64()), (1 << kind.bit_width) - 1), 0)
        columns.append(column.cast(kind))
        fields.append(pa.field(name, kind))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


class _Open:
    """One file being written, in each of its forms."""

    def __init__(self, fs: pafs.FileSystem, stem: str, suffixes: list[str], schema: pa.Schema, splittable: bool):
        self.paths, self.outs, self.writers, self.rows = [f"{stem}{s}.working" for s in suffixes], [], [], 0
        for path, suffix in zip(self.paths, suffixes, strict=True):
            out = fs.open_output_stream(path)
            self.outs.append(out)
            sink = gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if suffix.endswith(".gz") else out
            if sink is not out:
                self.outs.insert(0, sink)
            self.writers.append((pa.ipc.new_file if splittable and sink is out else pa.ipc.new_stream)(sink, schema))

    def write(self, batch: pa.RecordBatch) -> None:
        for w in self.writers:
            w.write_batch(batch)
        self.rows += batch.num_rows

    def close(self) -> None:
        for x in [*self.writers, *self.outs]:
            x.close()


@dataclass
class Written(WriterCommitMessage):
    """(name, part, working paths) of the files that a task wrote."""

    files: list[tuple[str, int, list[str]]]


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.batch = options["path"], overwrite, int(options.get("batch", "10000"))
        self.suffixes = {"none": [".arrow"], "gzip": [".arrow.gz"], "both": [".arrow", ".arrow.gz"]}[options.get("compress", "none")]
        self.splittable = options.get("kind", "stream") == "file"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, done, now, name, held = task.partitionId(), [], None, None, []

        def flush(rest: bool) -> None:
            nonlocal held
            if held and (rest or sum(b.num_rows for b in held) >= self.batch):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=self.batch)
                held = [] if rest or whole[-1].num_rows == self.batch else [whole.pop()]
                for b in whole:
                    now.write(b)

        try:
            for b in iterator:
                names = b.column(FILE).to_pylist()
                body = laid_out(b.drop_columns([FILE]))
                starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
                for a, z in zip(starts, [*starts[1:], len(names)], strict=True):
                    if names[a] != name:
                        if now is not None:
                            flush(True)
                            now.close()
                        name = names[a]
                        if any(name == f for f, *_ in done):
                            raise ValueError(f"the rows of file {name} are not together: sort by it")
                        now = _Open(fs, f"{root}/{name}.{part:05d}-{task.taskAttemptId()}", self.suffixes, body.schema, self.splittable)
                        done.append((name, part, now.paths))
                    held.append(body.slice(a, z - a))
                    flush(False)
            if now is not None:
                flush(True)
                now.close()
        except BaseException:
            _remove(fs, [p for _, _, paths in done for p in paths])
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        parts: dict[str, list[tuple[int, list[str]]]] = {}
        for m in messages:
            for name, part, paths in m.files if m else ():
                parts.setdefault(name, []).append((part, paths))
        there = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if ".working" not in f.path] if self.overwrite else []
        final = set()
        for name, found in parts.items():
            for n, (_, paths) in enumerate(sorted(found)):
                for path, suffix in zip(paths, self.suffixes, strict=True):
                    to = f"{root}/{name}{f'.{n:05d}' if len(found) > 1 else ''}{suffix}"
                    fs.move(path, to)
                    final.add(to)
        _remove(fs, [p for p in there if p not in final])

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        _remove(fs, [p for m in messages if m for _, _, paths in m.files for p in paths])


def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
    for p in paths:
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_file(p)


@dataclass
class Piece(InputPartition):
    """Some record batches of an IPC file, or (last = -1) all of a file."""

    path: str
    first: int = 0
    last: int = -1


class ArrowReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema, self.split = options["path"], schema, int(options.get("split", str(SPLIT)))
        self.match = options.get("file", "")

    def partitions(self) -> Sequence[Piece]:
        out = []
        fs, _ = opened(self.path)
        for f in listed(self.path):
            name = f.path.rsplit("/", 1)[-1]
            if self.match and not name.startswith(self.match):
                continue
            if f.size <= self.split or name.endswith(".gz") or not _is_file(fs, f.path):
                out.append(Piece(f.path))
                continue
            with fs.open_input_file(f.path) as source:  # the footer only
                n = pa.ipc.open_file(source).num_record_batches
            step = max(1, n * self.split // f.size)
            out += [Piece(f.path, i, min(i + step, n)) for i in range(0, n, step)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        kinds = {x.name: to_arrow_type(x.dataType) for x in self.schema}
        name = partition.path.rsplit("/", 1)[-1]
        file = re.sub(r"(\.[0-9]{5})?\.arrow(\.gz)?$", "", name)  # a file's parts have its name
        for b in _batches(fs, partition, [n for n in kinds if n != FILE]):
            columns = [pa.array(np.repeat(file, b.num_rows), pa.string()) if n == FILE else b.column(n).cast(t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))


def listed(path: str) -> list[pafs.FileInfo]:
    """The Arrow files under a path, or the one that it names."""
    fs, root = opened(path)
    at = fs.get_file_info(root)
    found = [at] if at.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f for f in found if f.is_file and f.path.endswith((".arrow", ".arrow.gz"))), key=lambda f: f.path)


def _is_file(fs: pafs.FileSystem, path: str) -> bool:
    with fs.open_input_stream(path) as s:
        return s.read(6) == b"ARROW1"


def _batches(fs: pafs.FileSystem, piece: Piece, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns asked for: of an IPC file no other is read."""
    if piece.path.endswith(".gz"):
        with fs.open_input_stream(piece.path, compression="gzip") as s, pa.ipc.open_stream(s) as r:
            for b in r:
                yield b.select(names)
    elif _is_file(fs, piece.path):
        with fs.open_input_file(piece.path) as s:
            schema = pa.ipc.open_file(s).schema
            r = pa.ipc.open_file(s, options=pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(n) for n in names]))
            for i in range(piece.first, piece.last if piece.last >= 0 else r.num_record_batches):
                yield r.get_batch(i).select(names)
    else:
        with fs.open_input_stream(piece.path) as s, pa.ipc.open_stream(s) as r:
            for b in r:
                yield b.select(names)


class ArrowFiles(DataSource):
    """Options: path; to write compress (none, gzip, both), kind (stream, or file for splittable ones) and batch (rows); to
    read split (bytes) and file (how a name begins). Without a schema all columns of the first file are read, and ``file``."""

    @classmethod
    def name(cls) -> str:
        return "beacon_arrow"

    def schema(self) -> StructType:
        first = listed(self.options["path"])
        if not first:
            raise FileNotFoundError(f"no Arrow file under {self.options['path']}")
        fs, path = opened(self.options["path"])[0], first[0].path
        with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as s:
            if not path.endswith(".gz") and _is_file(fs, path):
                with fs.open_input_file(path) as whole:
                    found = pa.ipc.open_file(whole).schema
            else:
                found = pa.ipc.open_stream(s).schema
        wider = {pa.uint8(): pa.int32(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64()}
        return from_arrow_schema(pa.schema([pa.field(x.name, wider.get(x.type, x.type)) for x in found] + [pa.field(FILE, pa.string())]))

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options, overwrite)


def write_arrow(rows: DataFrame, path: str, *order: str, compress: str = "none", kind: str = "stream", batch: int = 10000, mode: str = "append", tasks: int | None = None) -> None:
    """Files named by the column ``file``, each sorted by ``order``. Rows are dealt by file and order in ranges of equal
    size, so a large file is written by several tasks, and then has several parts."""
    rows.sparkSession.dataSource.register(ArrowFiles)
    by = [FILE, *order]
    dealt = rows.repartitionByRange(tasks, *by) if tasks else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.format("beacon_arrow").options(path=path, compress=compress, kind=kind, batch=str(batch)).mode(mode).save()


def read_arrow(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("beacon_arrow").options(path=path, **options)
    return (reader.schema(schema) if schema else reader).load()
