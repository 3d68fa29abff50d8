"""The record file format as a Spark data source.

Records stand back to back: key (unsigned, 8 bytes), payload length (unsigned,
4 bytes), payload; numbers little-endian; no header, footer or marks. Finding
record bounds takes a walk over the headers. The writer leaves an index beside
each part file (offsets of split points), so that the walk is needed only for
files from elsewhere. Of many such files each is one task's, which walks as it
reads; a few are walked beforehand, in large reads, to be split. A folder's
manifest names its parts; a commit replaces it in one step, so that a reader
sees the folder as it was before or after a write, also if the driver is lost.

    spark.dataSource.register(RecordFile)
    spark.read.format("recordfile").option("splitBytes", 1 << 26).load(path)
    df.select("key_ord", "payload").write.format("recordfile").mode("overwrite").save(path)

Paths are of any file system that pyarrow knows; on a cluster, one that all
machines share. Options of a read: ``truncatedTail`` (``raise``, the default, or
``drop``), ``splitBytes``, and for a single file ``offset`` and ``maxBytes``: start
at this record-aligned byte, and stop before the record that would exceed so many.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "key_ord long, len long, payload binary"
HEADER = struct.Struct("<QI")
TOP_BIT = np.uint64(1 << 63)
SPLIT_BYTES = 64 << 20
READ_BYTES = 8 << 20
#: From so many files without an index on, each is read by one task, without a walk beforehand.
MANY_FILES = 16
MANIFEST = "_manifest"
_LENGTH = struct.Struct("<I").unpack_from


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def chase(raw: bytes) -> tuple[list[int], int]:
    """Starts of the whole records in ``raw``, and where the last one ends."""
    starts, at, size = [], 0, len(raw)
    while at + 12 <= size:
        end = at + 12 + _LENGTH(raw, at + 8)[0]
        if end > size:
            break
        starts.append(at)
        at = end
    return starts, at


def walk(system: fs.FileSystem, path: str, split_bytes: int, tail: str, offset: int = 0, most: int | None = None) -> list[int]:
    """Record-aligned offsets about ``split_bytes`` apart, from ``offset`` to the end (or to ``most`` bytes from there).

    Reads large pieces where records are small, and little more than headers where they are large.
    """
    size, at, cuts, window = system.get_file_info(path).size, offset, [offset], 1 << 20
    with system.open_input_file(path) as f:
        while at < size:
            raw = f.read_at(min(window, size - at), at)
            starts, whole = chase(raw)
            if not starts:  # no whole record in it: its header tells how far to go
                end = at + 12 + _LENGTH(raw, 8)[0] if len(raw) >= 12 else size + 1
                if end > size:
                    if tail == "drop":
                        break
                    raise ValueError(f"{path}: the last record, at byte {at}, is cut off")
                ends, window = [end], 4096
            else:
                ends = [at + x for x in (*starts[1:], whole)]
                window = 1 << 20 if whole < (len(starts) << 16) else 4096
            for end in ends:
                if most is not None and end - offset > most:
                    return cuts if cuts[-1] == at else [*cuts, at]
                at = end
                if at - cuts[-1] >= split_bytes:
                    cuts.append(at)
    return cuts if cuts[-1] == at else [*cuts, at]


def decode(raw: bytes, starts: list[int], whole: int) -> pa.RecordBatch:
    """Whole records as a batch: keys are gathered, and headers cut out of the bytes, which are the payloads then."""
    data, head = np.frombuffer(raw, np.uint8, whole), np.array(starts, np.int64)
    keys = data[head[:, None] + np.arange(8)].reshape(-1).view("<u8").astype(np.uint64)
    lens = np.diff(np.append(head, whole)) - HEADER.size
    payload = np.ones(whole, bool)
    payload[(head[:, None] + np.arange(HEADER.size)).reshape(-1)] = False
    offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
    values = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(data[payload])])
    return pa.RecordBatch.from_arrays([pa.array((keys ^ TOP_BIT).view(np.int64)), pa.array(lens, pa.int64()), values], names=["key_ord", "len", "payload"])


def encode(key_ord: pa.Array, payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Records as bytes, and where each ends. A null payload is an empty one."""
    payload = payload.fill_null(b"").cast(pa.large_binary())
    n = len(payload)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, bounds, raw = payload.buffers()
    bounds = np.frombuffer(bounds, np.int64)[payload.offset : payload.offset + n + 1]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    lens = np.diff(bounds)
    if lens.max() > 0xFFFFFFFF:
        raise ValueError("a payload is longer than 4 bytes can tell")
    ends = np.cumsum(lens + HEADER.size)
    head = (ends - lens - HEADER.size)[:, None]
    out, mine = np.empty(int(ends[-1]), np.uint8), np.ones(int(ends[-1]), bool)
    keys = key_ord.to_numpy(zero_copy_only=False).view(np.uint64) ^ TOP_BIT
    mine[(head + np.arange(HEADER.size)).reshape(-1)] = False
    out[(head + np.arange(8)).reshape(-1)] = keys.astype("<u8").view(np.uint8)
    out[(head + np.arange(8, HEADER.size)).reshape(-1)] = lens.astype("<u4").view(np.uint8)
    out[mine] = data
    return out, ends


def part_number(path: str) -> tuple[int, str]:
    """Parts stand in the order of their numbers, whatever the width of these."""
    name = path.rsplit("/", 1)[-1]
    number = re.match(r"part-(\d+)", name)
    return int(number[1]) if number else -1, name


def parts_of(system: fs.FileSystem, folder: str) -> list[str]:
    """The part files of a folder: those of its manifest, or all there are if it has none."""
    if system.get_file_info(f"{folder}/{MANIFEST}").is_file:
        with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return sorted((f"{folder}/{x}" for x in f.read().decode().split("\n") if x), key=part_number)
    files = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and not x.base_name.startswith(("_", "."))]
    return sorted(files, key=part_number)


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:  # Spark hands option names over in lower case
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tail = options.get("truncatedtail", "raise")
        self.offset, self.most = int(options.get("offset", 0)), int(options["maxbytes"]) if "maxbytes" in options else None

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [path] if info.is_file else parts_of(system, path)
        spans = []
        for file in files:
            index = f"{os.path.dirname(file)}/_{os.path.basename(file)}.index"
            if self.offset or self.most is not None:
                if len(files) > 1:
                    raise ValueError("offset and maxBytes are for a single file")
                cuts = walk(system, file, self.split, self.tail, self.offset, self.most)
            elif system.get_file_info(index).is_file:
                with system.open_input_file(index) as f:
                    marks = np.frombuffer(f.read(), "<u8").astype(int).tolist()
                cuts = [0]
                for mark in marks[1:]:
                    if mark - cuts[-1] >= self.split or mark == marks[-1]:
                        cuts.append(mark)
            elif len(files) >= MANY_FILES:
                cuts = [0, system.get_file_info(file).size]
            else:
                cuts = walk(system, file, self.split, self.tail)
            spans += [Span(file, a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
        return spans

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            while at < partition.end:
                raw = f.read_at(min(READ_BYTES, partition.end - at), at)
                starts, whole = chase(raw)
                if not starts:  # a record larger than the buffer, or one that is cut off
                    whole = HEADER.size + _LENGTH(raw, 8)[0] if len(raw) >= HEADER.size else len(raw) + 1
                    if at + whole > partition.end:
                        if self.tail == "drop":
                            return
                        raise ValueError(f"{partition.path}: the last record, at byte {at}, is cut off")
                    raw, starts = f.read_at(whole, at), [0]
                yield decode(raw, starts, whole)
                at += whole


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RecordWriter(DataSourceArrowWriter):
    """Tasks write part files and their indexes into a folder of this write; the commit moves them out and names them in the manifest.

    What failed or repeated tasks left goes with that folder.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.stage = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, path = located(self.path)
        system.create_dir(f"{path}/{self.stage}", recursive=True)
        name, at, cuts, step = f"part-{TaskContext.get().partitionId():010d}-{uuid.uuid4().hex}.rec", 0, [0], min(self.split, 1 << 20)
        with system.open_output_stream(f"{path}/{self.stage}/{name}") as f:
            for batch in batches:
                columns = {c.lower(): batch.column(i) for i, c in enumerate(batch.schema.names)}
                raw, ends = encode(columns["key_ord"], columns["payload"])
                f.write(raw)
                while len(ends) and at + int(ends[-1]) - cuts[-1] >= step:
                    cuts.append(at + int(ends[np.searchsorted(ends, cuts[-1] + step - at)]))
                at += len(raw)
        if cuts[-1] != at:
            cuts.append(at)
        with system.open_output_stream(f"{path}/{self.stage}/{name}.index") as f:
            f.write(np.array(cuts, "<u8").tobytes())
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        names = [n for m in messages if m for n in m.files]
        old = [x.rsplit("/", 1)[-1] for x in parts_of(system, path)]
        for n in names:
            system.move(f"{path}/{self.stage}/{n}.index", f"{path}/_{n}.index")
            system.move(f"{path}/{self.stage}/{n}", f"{path}/{n}")
        with system.open_output_stream(f"{path}/_{self.stage}.manifest") as f:
            f.write("\n".join(names if self.overwrite else [*old, *names]).encode())
        system.move(f"{path}/_{self.stage}.manifest", f"{path}/{MANIFEST}")  # from here on the new parts count
        if self.overwrite:
            for n in old:
                for x in (n, f"_{n}.index"):
                    if system.get_file_info(f"{path}/{x}").is_file:
                        system.delete_file(f"{path}/{x}")
        self._sweep(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*located(self.path))

    def _sweep(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.stage}")


class RecordFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def size_of(path: str) -> int:
    """Bytes of a record file, or of the part files in a folder; 0 if there is none."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        return sum(x.size for x in system.get_file_info(parts_of(system, at)))
    return info.size or 0


def remove(path: str) -> None:
    """Delete a record file or folder, if there is one."""
    system, at = located(path)
    kind = system.get_file_info(at).type
    if kind == fs.FileType.Directory:
        system.delete_dir(at)
    elif kind == fs.FileType.File:
        system.delete_file(at)


def register(spark) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(RecordFile)


def export_single(path: str, target: str, move: bool = False, most: int | None = None) -> int:
    """Concatenate the part files, in order, to one record file (its first ``most`` bytes, if given); returns its size.

    With ``move`` a folder's only part is renamed instead, and the folder goes.
    """
    system, folder = located(path)
    out_system, out = located(target)
    parts = parts_of(system, folder)
    if move and len(parts) == 1 and most is None and type(system) is type(out_system):
        system.move(parts[0], out)
        system.delete_dir(folder)
        return system.get_file_info(out).size
    size = 0
    with out_system.open_output_stream(out) as f:
        for p in parts:
            with system.open_input_stream(p) as g:
                while chunk := g.read(READ_BYTES if most is None else min(READ_BYTES, most - size)):
                    size += len(chunk)
                    f.write(chunk)
    return size
