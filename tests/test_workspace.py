"""Scratch folders: with and without the setting, and their removal."""

import os
import subprocess
import sys

import pytest

from heddle import workspace

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PLAIN = """
from pyspark.sql import SparkSession
from heddle import workspace
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = workspace.shared_dir(spark), workspace.shared_dir(spark)
assert a == b
assert workspace.materialise(spark.range(3), "three").count() == 3
print("fine")
"""


def test_plain_session(tmp_path):
    """A session without any defaults materialises all the same."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=240)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_cluster_needs_the_setting():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())


def test_scope_removes_its_tables(spark):
    with workspace.scratch(spark) as path:
        got = workspace.materialise(spark.range(5), "five")
        assert got.count() == 5
    assert not os.path.exists(path.removeprefix("file://"))


AWAY = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from heddle.operators import ml
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, vector array<double>")
assert ml.summed(rows, lambda x, _: x.sum(0)).tolist() == [4.0, 6.0]
print("fine")
"""


def test_workers_get_the_package(tmp_path):
    """The driver alone has the repository on its path."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", AWAY.format(root=ROOT)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_fasta_headers_with_marks(spark, tmp_path):
    from heddle.sources import readers

    (tmp_path / "a.fa").write_bytes(b"\n>chr1 A->B change\r\nACGT\r\nAC\r\n>chr2\n>chr3 x\nGG\n")
    got = {r.name: r.sequence for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"chr1": "ACGTAC", "chr2": "", "chr3": "GG"}
    pieces = {(r.name, r.start): r.piece for r in readers.sequence_pieces(readers.fasta(spark, str(tmp_path / "a.fa")), 4).collect()}
    assert pieces == {("chr1", 0): "ACGT", ("chr1", 4): "AC", ("chr2", 0): "", ("chr3", 0): "GG"}
