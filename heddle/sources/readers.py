"""Readers of matrix, genomic and token files. All but HDF5 go through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.order import with_position
from heddle.schemas import FRAGMENTS, INTERVALS
from heddle.sources.partitioned import archive_lines, array_entries


#: Where a line stands: lines of one file, split or not, are in the order of the file, files in that of their names.
PLACE = lambda: F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


#: Entries of a task that joins them.
ENTRIES = 1 << 20


def tasks(entries: int) -> int:
    return max(1, -(-entries // ENTRIES))


def sidecar(spark: SparkSession, path: str, column: int, name: str) -> DataFrame:
    """position (1-based, by line) and one column of a tab file, or of a folder of its parts."""
    rows = spark.read.text(path).select(PLACE().alias("_at"), F.get(F.split("value", "\t"), F.lit(column)).alias(name))
    return with_position(rows, "_at", "position").select("position", name)


def matrix_market(spark: SparkSession, matrix: str, features: str, barcodes: str, name_column: int = 0) -> DataFrame:
    """cell_id, gene_id (as text), value of a coordinate file, genes by cells, and its sidecars.

    Each may be a folder of parts. Comments begin with %. The first other line holds the sizes; of parts, it is
    the first of the one that begins with the banner, or of the first by name where none does.
    """
    lines = spark.read.text(matrix).select(PLACE().alias("at"), F.split(F.trim("value"), r"\s+").alias("p"), "value")
    headed = lines.agg(F.min(F.when(F.col("value").startswith("%%MatrixMarket"), F.col("at.file"))).alias("file")).first()["file"]
    plain = lines.where(~F.col("value").startswith("%"))
    sizes = plain.where(F.lit(True) if headed is None else F.col("at.file") == headed)
    found = sizes.agg(F.min("at").alias("first"), F.min_by("p", "at").alias("p"))
    said = found.select(F.get("p", F.lit(2)).try_cast("long").alias("n")).first()["n"] or 0
    entries = plain.join(F.broadcast(found.select("first")), how="cross").where("at <> first").select(
        F.get("p", F.lit(0)).try_cast("long").alias("g"), F.get("p", F.lit(1)).try_cast("long").alias("c"), F.get("p", F.lit(2)).try_cast("double").alias("value")
    )
    genes = sidecar(spark, features, name_column, "gene_id").withColumnRenamed("position", "g")
    cells = sidecar(spark, barcodes, 0, "cell_id").withColumnRenamed("position", "c")
    if tasks(said) > 1:
        entries, cells = entries.repartition(tasks(said), "c"), cells.repartition(tasks(said), "c")
    return entries.join(genes, "g").join(cells, "c").select("cell_id", "gene_id", "value")


def expand_columns(triples: DataFrame) -> DataFrame:
    """col, row, value of compressed-column triples (data, indices, indptr as arrays), after the columns
    that say which triple is meant."""
    keys = [c for c in triples.columns if c not in ("data", "indices", "indptr")]
    spans = triples.select(*keys, "data", "indices", F.posexplode(F.arrays_zip(F.slice("indptr", F.lit(1), F.size("indptr") - 1).alias("a"), F.slice("indptr", F.lit(2), F.size("indptr") - 1).alias("b"))).alias("col", "s"))
    part = lambda c: F.slice(c, (F.col("s.a") + 1).cast("int"), (F.col("s.b") - F.col("s.a")).cast("int"))
    cells = spans.where("s.a < s.b").select(*keys, "col", F.explode(F.arrays_zip(part("indices").alias("row"), part("data").alias("value"))).alias("e"))
    return cells.select(*keys, "col", "e.row", "e.value")


def hdf5_counts(spark: SparkSession, path: str, group: str = "matrix") -> DataFrame:
    """The counts of an HDF5 matrix. Needs h5py, which is optional, and a path the driver can open."""
    import h5py

    with h5py.File(path, "r") as f:
        g = f[group]
        triple = spark.createDataFrame([(g["data"][:].tolist(), g["indices"][:].tolist(), g["indptr"][:].tolist())], "data array<double>, indices array<long>, indptr array<long>")
        cells = spark.createDataFrame(list(enumerate(x.decode() for x in g["barcodes"][:])), "col int, cell_id string")
        genes = spark.createDataFrame(list(enumerate(x.decode() for x in g["features"]["id"][:])), "row long, gene_id string")
    return expand_columns(triple).join(cells, "col").join(genes, "row").select("cell_id", "gene_id", "value")


def bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERVALS).csv(path, sep="\t", comment="#")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAGMENTS).csv(path, sep="\t", comment="#")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence of each record. Records begin with ``>`` at the start of a line; one within a
    header line is part of it."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return records.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def sequence_pieces(records: DataFrame, size: int = 1 << 20) -> DataFrame:
    """name, start (0-based), piece: sequences cut into pieces of ``size``, so that what follows can deal
    out a chromosome; an empty sequence is one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length("sequence") - 1), F.lit(size))
    return records.select("name", "sequence", F.explode(starts).alias("start")).select("name", F.col("start").cast("long").alias("start"), F.substring("sequence", F.col("start") + 1, F.lit(size)).alias("piece"))


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", " ").alias("tokens"))


def csv_columns(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True).select(*columns)


def headerless_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=False)


def documents_query(frame: DataFrame, since, protocol, answered: bool = True) -> DataFrame:
    """Conversation documents of a protocol, answered, since a time; filters go down to the source."""
    return frame.where((F.col("date") >= since) & (F.col("protocolId") == protocol) & (F.col("answered") == answered))


def pivot_samples(rows: DataFrame, probe: str, sample: str, value: str, samples: list) -> DataFrame:
    return rows.groupBy(probe).pivot(sample, samples).agg(F.first(value))


def numpy_matrix(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """sample_id, gene_id, value of the non-zero entries of a dense array file (npy, or one array of
    an npz), read by ranges."""
    return array_entries(spark, path, name).select(F.col("row").alias("sample_id"), F.col("col").alias("gene_id"), "value")


def archived_fragments(spark: SparkSession, path: str) -> DataFrame:
    """The fragments of all members of an archive, with their member; comments begin with #. What is missing or
    isn't a number where one belongs is null."""
    rows = archive_lines(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    part = F.split("line", "\t")
    columns = [F.get(part, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(FRAGMENTS)]
    return rows.select("member", *columns)


def hdf5_structure(path: str) -> list[tuple[int, str, str]]:
    """(depth, name, kind) of all groups and data sets, in file order. Needs h5py."""
    import h5py

    found = []

    def walk(node, depth: int) -> None:
        for name, child in node.items():
            group = isinstance(child, h5py.Group)
            found.append((depth, name, "group" if group else f"{child.dtype}{list(child.shape)}"))
            if group:
                walk(child, depth + 1)

    with h5py.File(path, "r") as f:
        walk(f, 0)
    return found
