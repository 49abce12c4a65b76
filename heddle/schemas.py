"""Explicit schemas of the canonical frames."""

from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("gene_id", T.LongType()), T.StructField("value", T.DoubleType())])
INTERVALS = T.StructType(
    [T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
     T.StructField("name", T.StringType()), T.StructField("score", T.StringType()), T.StructField("strand", T.StringType())]
)
FRAGMENTS = T.StructType(
    [T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
     T.StructField("barcode", T.StringType()), T.StructField("count", T.IntegerType())]
)
VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("stringValue", T.StringType()), T.StructField("structValue", T.MapType(T.StringType(), T.StringType()))])
ENTITY = T.MapType(T.StringType(), T.StructType([T.StructField("listValue", T.StructType([T.StructField("values", T.ArrayType(VALUE))]))]))
MECHANISM = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("driver_vars", T.ArrayType(T.IntegerType())), T.StructField("redundant_vars", T.ArrayType(T.IntegerType())),
     T.StructField("effects", T.ArrayType(T.DoubleType())), T.StructField("type", T.StringType())]
)
