"""At-least-once messages as streams: drop repeats within a watermark, or admit batches to a table exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry.operators.dedupe import admit, identity


def drop_repeats(stream: DataFrame, id_cols: list[str], arrival: str, delay: str = "1 day") -> DataFrame:
    """The first delivery of each message; state older than ``delay`` is given up, so it stays bounded."""
    keyed = stream.select("*", *identity(stream, id_cols)).withWatermark(arrival, delay)
    ids = [f"_id_{i}" for i in range(len(id_cols))]
    return keyed.dropDuplicatesWithinWatermark(ids).drop(*ids)


def admit_batches(stream: DataFrame, path: str, checkpoint: str, id_cols: list[str], arrival: str, tie: str) -> StreamingQuery:
    """Appends to the table at ``path`` every message it does not hold yet, however often and late it is delivered.

    A batch that is run again after a failure finds its messages stored and adds nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = stored_ids(spark, path, id_cols, batch)
        admit(batch, stored, id_cols, arrival, tie).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_ids(spark: SparkSession, path: str, id_cols: list[str], like: DataFrame) -> DataFrame:
    """Identities of the stored messages; none if there is no table yet."""
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  (no table yet)
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = spark.createDataFrame([], like.schema)
    return stored.select(*identity(stored, id_cols)).distinct()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Messages per key and tumbling window of event time; late ones count until the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
