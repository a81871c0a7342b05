"""Readers and writers: JSON lines, CSV, text, JDBC, and a resumable append-only sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Timestamps are written and read to the microsecond.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

#: Nulls are written as \\N, so that empty texts stay empty texts.
CSV = {"nullValue": "\\N", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, a bad line fails the read. ``path`` may be a glob."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "_corrupt_record") -> DataFrame:
    """JSON lines with the text of bad lines in ``bad`` (null for good ones); keep good rows with ``filter(bad is null)``."""
    full = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*full.fields, T.StructField(bad, T.StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header under a schema; quoted line breaks and blanks at the ends of values are kept."""
    return spark.read.schema(schema).options(header=True, multiLine=True, **CSV).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): one id per line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of whole JSON files, to be dug into by ``dig``."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def dig(body: str, path: str, default: str | None = None):  # noqa: ANN201
    """Value at a dotted path of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(body, "$." + path), F.lit(default))


def read_jdbc(spark: SparkSession, url: str, query: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A database query read in ``parts`` key ranges at a time instead of over one connection."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
        .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).load()
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; columns that are not asked for are left out."""
    (df.select(*columns) if columns else df).write.mode("overwrite").options(header=True, quoteAll=True, **CSV).csv(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys the Parquet table at ``path`` does not hold: a stopped job goes on where it was."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as e:  # noqa: BLE001  (no table yet)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], df.select(*keys).schema)
    df.join(done, keys, "left_anti").write.mode("append").parquet(path)


def manifest(inputs: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of binary files (``spark.read.format('binaryFile')``)."""
    return inputs.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
