"""Planned partitions of binary files, against numpy and plain reading."""

import gzip
import io
import struct
import tarfile
import zlib

import numpy as np
import pytest

from heddle.sources import partitioned, readers


def same(df, want):
    got = {(r["row"], r["col"]): r["value"] for r in df.collect()}
    want = np.asarray(want, float).reshape(len(want), int(np.prod(np.shape(want)[1:])))
    assert got == {(int(i), int(j)): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}


@pytest.fixture
def arrays():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(37, 11)) * (rng.random((37, 11)) < 0.4)
    return {"plain": x, "turned": np.asfortranarray(x * 2), "small": (rng.random((5, 60)) < 0.3).astype("u1"), "line": np.arange(9, dtype="i8"), "none": np.zeros((0, 4))}


def test_npy_by_ranges(spark, tmp_path, arrays):
    for name, x in arrays.items():
        path = str(tmp_path / f"{name}.npy")
        np.save(path, x)
        df = partitioned.array_entries(spark, path, piece_bytes=200)
        assert df.rdd.getNumPartitions() == max(1, -(-x.size // (200 // x.itemsize)))
        same(df, x)
    same(partitioned.array_entries(spark, f"file://{tmp_path}/plain.npy"), arrays["plain"])
    got = readers.numpy_matrix(spark, str(tmp_path / "plain.npy"))
    assert got.columns == ["sample_id", "gene_id", "value"] and got.count() == np.count_nonzero(arrays["plain"])
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="dimensions"):
        partitioned.array_entries(spark, str(tmp_path / "cube.npy")).collect()


def test_npz_members(spark, tmp_path, arrays):
    for save, name in ((np.savez, "stored"), (np.savez_compressed, "packed")):
        path = str(tmp_path / f"{name}.npz")
        save(path, **arrays)
        every = partitioned.array_entries(spark, path, piece_bytes=200)
        assert every.rdd.getNumPartitions() > (10 if name == "stored" else 4)
        for key, x in arrays.items():
            same(every.where(every["array"] == key), x)
        same(partitioned.array_entries(spark, path, "turned"), arrays["turned"])


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat(name, x, number, kind, small_name=False):
    label = struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if small_name else element(1, name.encode())
    body = element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", *x.shape)) + label + element(number, x.tobytes(order="F"))
    return element(14, body)


def test_mat_arrays(spark, tmp_path, arrays):
    x, small = arrays["plain"], arrays["small"]
    packed = zlib.compress(mat("packed", x * 3, 9, 6))
    parts = [mat("counts", x, 9, 6), mat("s", small, 2, 6, True), struct.pack("<II", 15, len(packed)) + packed, mat("text", small, 4, 4)]
    one = np.array([[7]], "u1")
    short = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, 1)) + struct.pack("<HH", 1, 1) + b"k\0\0\0" + struct.pack("<HH", 2, 1) + b"\x07\0\0\0"
    path = tmp_path / "all.mat"
    path.write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts) + element(14, short))
    every = partitioned.array_entries(spark, str(path), piece_bytes=300)
    assert every.rdd.getNumPartitions() > 10
    for name, want in (("counts", x), ("s", small), ("packed", x * 3), ("k", one)):
        same(every.where(every["array"] == name), want)
    assert {r["array"] for r in every.select("array").distinct().collect()} == {"counts", "s", "packed", "k"}
    with pytest.raises(Exception, match="full array"):
        partitioned.array_entries(spark, str(path), "text").collect()


def test_archive_lines(spark, tmp_path):
    rng = np.random.default_rng(5)
    text = "".join("x" * int(n) + "é\n" for n in rng.integers(0, 40, 50)) + "last"
    files = {"a.txt": text.encode(), "b/c.tsv.gz": gzip.compress(text.encode()), "empty": b"", "crlf": b"one\r\n\r\ntwo\r\n"}
    want = {"a.txt": text.split("\n"), "b/c.tsv.gz": text.split("\n"), "crlf": ["one", "", "two"]}
    for mode, name in (("w", "x.tar"), ("w:gz", "x.tar.gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, data in files.items():
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        for size in (7, 64, 1 << 20):
            rows = partitioned.archive_lines(spark, str(tmp_path / name), size).orderBy("member", "at").collect()
            got = {m: [r["line"] for r in rows if r["member"] == m] for m in {r["member"] for r in rows}}
            assert got == want


def test_archived_fragments(spark, tmp_path):
    with tarfile.open(tmp_path / "f.tar", "w") as t:
        for member, data in (("one.tsv.gz", gzip.compress(b"# note\nchr1\t5\t9\tAC-1\t2\n")), ("two.tsv", b"chr2\t1\t3\tGT-1\t1\nchrX\t1\t?\tGG-1\n")):
            info = tarfile.TarInfo(member)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = {tuple(r) for r in readers.archived_fragments(spark, str(tmp_path / "f.tar")).collect()}
    assert got == {("one.tsv.gz", "chr1", 5, 9, "AC-1", 2), ("two.tsv", "chr2", 1, 3, "GT-1", 1), ("two.tsv", "chrX", 1, None, "GG-1", None)}
