"""Line-JSON sources and sinks, query documents, checkpoints of keyed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadloom.functions.text import ustrip

CORRUPT = "_corrupt_record"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbers from 1; every line counts, blank ones too.

    Blocks of a file are counted where they are read; only their counts, a row
    each, are summed up.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = d.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return d.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def read_ndjson(spark: SparkSession, path: str, schema: StructType, *, strict_encoding: bool = False) -> DataFrame:
    """Tolerant scan: (line_no, fields, ``_corrupt_record``, ``error``); the scan goes on after a bad line.

    Blank lines are skipped.  Bytes that are not UTF-8 read as U+FFFD, or raise
    with ``strict_encoding``.  ``error`` says what a bad line is.
    """
    raw = numbered_lines(spark, path)
    line = F.make_valid_utf8("line")
    if strict_encoding:
        line = F.when(F.is_valid_utf8("line"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: line "), F.col("line_no").cast("string"))).cast("string"))
    d = raw.select("line_no", ustrip(line).alias("line")).where("line <> ''")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    d = d.withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"r.{CORRUPT}")
    return d.select("line_no", "r.*", F.when(bad.isNotNull(), F.when(~bad.startswith("{"), "no object").otherwise("malformed or mistyped")).alias("error"))


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keep_last(lines: DataFrame, key: str) -> DataFrame:
    """One row per key of numbered rows: the last one counts."""
    rest = [c for c in lines.columns if c not in (key, "line_no")]
    one = lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
    return one.select(key, *(F.col("r")[c].alias(c) for c in rest))


def discovered_fields(spark: SparkSession, path: str) -> DataFrame:
    """(field): every key that some line has."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path).select(F.explode(F.map_keys(m)).alias("field")).distinct()


def read_query_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``queries`` array of one JSON document with its version, texts stripped, blank queries left out.

    A document without a query raises.
    """
    d = spark.read.option("multiLine", True).json(path)
    rows = d.select("version", F.explode("queries").alias("q")).select("version", "q.*").withColumn("query", ustrip(F.col("query"))).where("query <> ''")
    if rows.isEmpty():
        raise ValueError(f"no queries in {path}")
    return rows


def write_ndjson(df: DataFrame, path: str) -> None:
    """One object a line, over what was there; letters of any script stay as they are."""
    df.write.mode("overwrite").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): what was written last for each key, null included; empty if there is nothing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    # within one run the greater value counts, a value before null
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("value", F.struct("run", F.col("value").isNotNull(), "value")).alias("value"))


def append_values(df: DataFrame, path: str) -> None:
    """Write (key, value) as a further run over those at ``path``; runs are numbered, so the latest counts."""
    spark = df.sparkSession
    last = spark.read.parquet(path).agg(F.max("run")).first()[0] if path_exists(spark, path) else None
    df.select("key", "value", F.lit((last if last is not None else -1) + 1).cast("long").alias("run")).write.mode("append").parquet(path)

