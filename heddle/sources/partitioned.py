"""Binary files as data sources with planned partitions: arrays of NPY, NPZ and MAT files, lines of archives.

The planner reads headers alone; tasks open the file themselves and read their range. What is
compressed as one stream is one task's, read in pieces. Paths are those of a folder or store that
driver and executors see, local or with a scheme.
"""

from __future__ import annotations

import gzip
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heddle.workspace import ship_package

#: Bytes of a partition, and of one read.
PIECE_BYTES = 64 << 20
READ_BYTES = 4 << 20

ENTRIES = "array string, row long, col long, value double"
LINES = "member string, at long, line string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    system, name = located(path)
    return system.open_input_file(name)


def files(path: str, endings: tuple) -> list[str]:
    """The file, or those of a folder that have one of the ``endings``, by name."""
    system, name = located(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    inside = system.get_file_info(fs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in inside if i.is_file and i.base_name.endswith(endings))


@dataclass
class Piece(InputPartition):
    """Elements ``start`` to ``end`` of an array whose elements lie from ``offset`` on, column by column if
    ``turned``; or, with a ``packed`` kind, the whole array, from a stream."""

    name: str
    file: str = ""
    dtype: str = ""
    shape: tuple = ()
    turned: bool = False
    offset: int = 0
    start: int = 0
    end: int = 0
    packed: str = ""


def plane(name: str, shape: tuple) -> tuple[int, int]:
    """Rows and columns; a vector is one column, a single value one of one row."""
    if len(shape) > 2:
        raise ValueError(f"{name} has {len(shape)} dimensions, not two at most")
    return (*shape, 1, 1)[:2]


def npy_header(f) -> tuple[str, tuple, bool]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, turned, dtype = read(f)
    if dtype.kind not in "biuf":
        raise ValueError(f"elements of type {dtype} are not read")
    return dtype.str, shape, turned


def ranges(piece: Piece, size: int) -> list[Piece]:
    """The array of ``piece`` cut into ranges of at most ``size`` bytes."""
    rows, cols = plane(piece.name, piece.shape)
    step = max(1, size // np.dtype(piece.dtype).itemsize)
    return [Piece(piece.name, piece.file, piece.dtype, piece.shape, piece.turned, piece.offset, a, min(a + step, rows * cols)) for a in range(0, rows * cols, step)]


def entries(piece: Piece, read) -> Iterator[pa.RecordBatch]:
    """The entries other than 0 of a range, from the bytes that ``read`` gives in order."""
    dtype, (rows, cols) = np.dtype(piece.dtype), plane(piece.name, piece.shape)
    at = piece.start
    while at < piece.end:
        n = min(piece.end - at, READ_BYTES // dtype.itemsize)
        data = read(n * dtype.itemsize)
        if len(data) < n * dtype.itemsize:
            raise ValueError(f"{piece.name} ends early")
        x = np.frombuffer(data, dtype)
        place = np.nonzero(x)[0]
        a, b = np.divmod(place + at, rows if piece.turned else cols)
        i, j = (b, a) if piece.turned else (a, b)
        yield pa.record_batch({"array": pa.array([piece.name] * len(i), pa.string()), "row": i.astype("int64"), "col": j.astype("int64"), "value": x[place].astype("float64")})
        at += n


def exactly(read):
    """``read`` for streams that may give less than asked."""

    def more(n: int) -> bytes:
        parts = []
        while n and (part := read(n)):
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    return more


# Fixed values of the MAT format, level 5: number types by code, and the classes of full numeric arrays.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_NUMERIC = 14, 15, range(6, 16)


def mat_tag(read, order: str) -> tuple[int, int, bytes | None]:
    """Type, bytes and, where the tag holds them, data of an element."""
    head = read(8)
    kind, size = struct.unpack(order + "II", head)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, head[4 : 4 + (kind >> 16)]
    return kind, size, None


def mat_element(read, order: str) -> tuple[int, bytes]:
    kind, size, data = mat_tag(read, order)
    return kind, read(size + -size % 8)[:size] if data is None else data


def mat_header(read, order: str) -> tuple[str, tuple, int, str, bytes | None]:
    """Name, sizes, class, number type and, where short, data of an array; what follows are its numbers."""
    flags = struct.unpack(order + "I", mat_element(read, order)[1][:4])[0]
    sizes = np.frombuffer(mat_element(read, order)[1], order + "i4")
    name = mat_element(read, order)[1].decode()
    kind = flags & 0xFF
    if kind not in MAT_NUMERIC or flags & 0x0800:
        return name, tuple(map(int, sizes)), -1, "", None
    number, _, data = mat_tag(read, order)
    return name, tuple(map(int, sizes)), kind, order + MAT_TYPES[number], data


class Inflated:
    """Bytes of a compressed element, in pieces."""

    def __init__(self, f, size: int):
        self.f, self.left, self.z, self.rest = f, size, zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        parts = []
        while n and not self.z.eof:
            if not self.rest:
                self.rest = self.f.read(min(self.left, READ_BYTES))
                self.left -= len(self.rest)
            part = self.z.decompress(self.rest, n)
            if not part and not self.rest and not self.left:
                break
            self.rest = self.z.unconsumed_tail
            parts.append(part)
            n -= len(part)
        return b"".join(parts)


def mat_order(f) -> str:
    f.seek(126)
    return "<" if f.read(2) == b"IM" else ">"


def mat_pieces(f, file: str, size: int) -> Iterator[Piece]:
    """Full real arrays; others (sparse, text, cells) are passed over unless asked for by name."""
    order, at, total = mat_order(f), 128, f.size()
    while at < total:
        f.seek(at)
        kind, length, _ = mat_tag(f.read, order)
        after = at + 8 + length
        if kind == MAT_COMPRESSED:
            name, shape, c, dtype, _ = mat_header(_skip_tag(Inflated(f, length).read), order)
            yield Piece(name, file, dtype, shape, True, at, packed="mat" if c >= 0 else "other")
        elif kind == MAT_MATRIX:
            name, shape, c, dtype, data = mat_header(f.read, order)
            if c < 0:
                yield Piece(name, packed="other")
            else:
                yield from ranges(Piece(name, file, dtype, shape, True, f.tell() - (4 if data is not None else 0)), size)
        at = after


def _skip_tag(read):
    read(8)
    return read


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], options.get("array")
        self.size = int(options.get("pieceBytes", PIECE_BYTES))

    def planned(self, file: str) -> Iterator[Piece]:
        with opened(file) as f:
            if file.endswith(".mat"):
                yield from mat_pieces(f, file, self.size)
            elif file.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    headers = []
                    for m in z.infolist():
                        with z.open(m) as inside:
                            name = m.filename.removesuffix(".npy")
                            if self.wanted in (None, name):
                                headers.append((m, name, *npy_header(inside), inside.tell()))
                for m, name, dtype, shape, turned, head in headers:
                    if m.compress_type == zipfile.ZIP_STORED:
                        f.seek(m.header_offset + 26)
                        lengths = struct.unpack("<HH", f.read(4))
                        yield from ranges(Piece(name, file, dtype, shape, turned, m.header_offset + 30 + sum(lengths) + head), self.size)
                    else:
                        yield Piece(name, file, dtype, shape, turned, packed=m.filename)
            else:
                dtype, shape, turned = npy_header(f)
                yield from ranges(Piece(file.split("/")[-1].removesuffix(".npy"), file, dtype, shape, turned, f.tell()), self.size)

    def partitions(self) -> list[Piece]:
        found = [p for file in files(self.path, (".npy", ".npz", ".mat")) for p in self.planned(file) if self.wanted in (None, p.name)]
        if self.wanted is not None and any(p.packed == "other" for p in found):
            raise ValueError(f"{self.wanted} is not a full array of real numbers")
        return [p for p in found if p.packed != "other"] or [Piece("")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        with opened(piece.file) as f:
            rows, cols = plane(piece.name, piece.shape)
            if piece.packed == "mat":
                order = mat_order(f)
                f.seek(piece.offset)
                stream = Inflated(f, mat_tag(f.read, order)[1])
                data = mat_header(_skip_tag(stream.read), order)[4]
                piece.end = rows * cols
                yield from entries(piece, stream.read if data is None else lambda n: data[:n])
            elif piece.packed:
                with zipfile.ZipFile(f) as z, z.open(piece.packed) as inside:
                    npy_header(inside)
                    piece.end = rows * cols
                    yield from entries(piece, exactly(inside.read))
            else:
                f.seek(piece.offset + piece.start * np.dtype(piece.dtype).itemsize)
                yield from entries(piece, f.read)


class ArrayFile(DataSource):
    """Options: path (npy, npz, mat, or a folder), array (one by name), pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "array_file"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


@dataclass
class Member(InputPartition):
    """Lines of a member that begin from ``start`` to before ``end``; its bytes lie from ``offset`` on.
    Without a name, the whole archive as a stream."""

    name: str
    file: str = ""
    offset: int = 0
    size: int = 0
    start: int = 0
    end: int = 0


def lines(read, at: int, end: int, partial: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin before ``end``, from a stream that stands at ``at``; the first
    one is left out if ``partial``."""
    rest = b""
    while at < end:
        more = read(READ_BYTES)
        *whole, rest = (rest + more).split(b"\n")
        if not more and rest:
            whole, rest = [*whole, rest], b""
        for line in whole:
            if not partial and at < end:
                yield at, line
            partial = False
            at += len(line) + 1
        if not more:
            return


def batches(found: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        member, at, line = zip(*held, strict=True)
        text = pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in line], pa.string())
        return pa.record_batch({"member": pa.array(member, pa.string()), "at": pa.array(at, pa.int64()), "line": text})

    for row in found:
        held.append(row)
        size += len(row[2]) + 64
        if size > READ_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pieceBytes", PIECE_BYTES))

    def planned(self, file: str) -> Iterator[Member]:
        if not file.endswith(".tar"):
            yield Member("", file)
            return
        with opened(file) as f, tarfile.open(fileobj=f, mode="r:") as archive:
            for m in archive:
                if m.isreg():
                    step = m.size if m.name.endswith(".gz") else self.size
                    for a in range(0, m.size, max(1, step)):
                        yield Member(m.name, file, m.offset_data, m.size, a, min(a + step, m.size))

    def partitions(self) -> list[Member]:
        return [m for file in files(self.path, (".tar", ".tar.gz", ".tgz")) for m in self.planned(file)] or [Member("")]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        yield from batches(self.found(part))

    def found(self, part: Member) -> Iterator[tuple[str, int, bytes]]:
        if not part.file:
            return
        far = 1 << 62
        with opened(part.file) as f:
            if not part.name:
                with tarfile.open(fileobj=f, mode="r|*") as archive:
                    for m in archive:
                        if m.isreg():
                            inside = archive.extractfile(m)
                            stream = gzip.GzipFile(fileobj=inside) if m.name.endswith(".gz") else inside
                            yield from ((m.name, *x) for x in lines(stream.read, 0, far, False))
                return
            # From the byte before, so that a line that begins right at the start is known as one.
            begin = max(0, part.start - 1)
            f.seek(part.offset + begin)
            left = part.size - begin

            def read(n: int) -> bytes:
                nonlocal left
                got = f.read(min(n, left))
                left -= len(got)
                return got

            if part.name.endswith(".gz"):
                yield from ((part.name, *x) for x in lines(gzip.GzipFile(fileobj=Reading(read)).read, 0, far, False))
            else:
                yield from ((part.name, *x) for x in lines(read, begin, part.end, part.start > 0))


@dataclass
class Reading:
    """A file of one function, as gzip wants it."""

    read: object


class ArchiveLines(DataSource):
    """Options: path (tar, a compressed tar, or a folder), pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def array_entries(spark: SparkSession, path: str, array: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """array, row, col, value of the entries other than 0 of a file's arrays of up to two dimensions.

    Of a folder, the arrays of all its files; an NPY file's array has the file's name. NPY files, stored members of NPZ files and plain arrays of MAT files (level 5) are read by ranges of
    ``piece_bytes``; compressed members and arrays by one task each, in pieces. A vector is one column.
    Values that are no numbers stay; empty arrays have no entries; text, cells, complex and sparse arrays of
    MAT files are passed over, and raise if asked for. Arrays of objects raise.
    """
    ship_package(spark)
    spark.dataSource.register(ArrayFile)
    found = spark.read.format("array_file").option("path", path).option("pieceBytes", piece_bytes)
    return (found if array is None else found.option("array", array)).load()


def archive_lines(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """member, at (offset of the line in the unpacked member), line of all files of an archive.

    Of a folder, those of all its archives. Plain members of a plain archive are read by ranges of ``piece_bytes``, members with gzip by one task
    each, and an archive that is compressed as a whole by one task. A line ends with a newline, with or
    without a carriage return; empty members have no lines.
    """
    ship_package(spark)
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("path", path).option("pieceBytes", piece_bytes).load()
