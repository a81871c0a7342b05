"""Messages delivered more than once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: What counts as an outer blank: white space and no-break spaces.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2009\u200b\u3000\ufeff"


def identity(df: DataFrame, id_cols: list[str]) -> list[Column]:
    """Normalised comparison columns: without outer blanks and letter case; nulls stay null."""
    return [F.lower(F.trim(F.col(c).cast("string"), F.lit(BLANKS))).alias(f"_id_{i}") for i, c in enumerate(id_cols)]


def rank_copies(df: DataFrame, id_cols: list[str], arrival: str, tie: str, salts: int = SALTS) -> DataFrame:
    """Adds ``is_kept`` to (tie, other columns): true for the first copy of each message by arrival, then by ``tie``.

    A null arrival comes after every other. Two null identity fields are equal and null differs from any value.
    ``tie`` must be unique. Copies are ranked in ``salts`` parts of a message first and the parts' firsts among each
    other, so a message with a third of all deliveries is sorted by many tasks; the second ranking sees at most
    ``salts`` rows of a message.
    """
    ids = [f"_id_{i}" for i in range(len(id_cols))]
    order = [F.col(arrival).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int"))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*ids, "_salt").orderBy(*order)))
    heads = first.filter("_rank = 1").withColumn("_among", F.row_number().over(Window.partitionBy(*ids).orderBy(*order)))
    rest = first.filter("_rank > 1").withColumn("_among", F.lit(2))
    return heads.unionByName(rest).withColumn("is_kept", F.col("_among") == 1).drop("_rank", "_among", "_salt")


def repeated(df: DataFrame, id_cols: list[str], arrival: str, tie: str) -> DataFrame:
    """``tie`` of every delivery that is not the kept copy of its message."""
    thin = df.select(tie, arrival, *identity(df, id_cols))
    return rank_copies(thin, id_cols, arrival, tie).filter(~F.col("is_kept")).select(tie)


def kept(df: DataFrame, id_cols: list[str], arrival: str, tie: str) -> DataFrame:
    """The kept copy of each message, all columns: the repeats are found on thin rows and taken away by anti-join."""
    return df.join(repeated(df, id_cols, arrival, tie), tie, "left_anti")


def admit(batch: DataFrame, stored_ids: DataFrame, id_cols: list[str], arrival: str, tie: str) -> DataFrame:
    """Rows of a new batch to be added to a store: one copy of each message that the store does not hold yet.

    ``stored_ids`` has the columns of ``identity``. Nulls are matched as equal. Running batch after batch gives one
    row per message whatever is delivered again, in the same or in a later batch.
    """
    ids = [f"_id_{i}" for i in range(len(id_cols))]
    firsts = kept(batch, id_cols, arrival, tie)
    keyed = firsts.select("*", *identity(firsts, id_cols))
    same = None
    for c in ids:
        eq = F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
        same = eq if same is None else same & eq
    return keyed.alias("n").join(stored_ids.select(*ids).alias("s"), same, "left_anti").drop(*ids)
