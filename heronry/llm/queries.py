"""Queries on text: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import bpe, contamination, truncation
from heronry.session import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("HERONRY_TOKENIZERS", "/opt/tokenizers")


def _tokenizer(folder: str, name: str) -> str:
    """The file in the folder, else where an installed package of the tokenizers has it."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            pass
    return path


def p6_ids(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text", _tokenizer(tokenizers, "byte_bpe_50k.json"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text breaks off."""
    return truncation.truncated(table(spark, d, "documents"), "doc_id", "text", "source").select("doc_id", "source")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.rates(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths, and bands of lengths, at which a source ends texts far more often than at those near by."""
    found = truncation.limits(truncation.texts(truncation.measured(table(spark, d, "documents"), "doc_id", "text", "source")))
    return found.select("source", "unit", "length", "n_ended", "n_reached", F.round("hazard", 6).alias("hazard"), F.round("expected", 6).alias("expected"))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per source, length that is a limit (null for all others) and form of ending: what the hazards say and whether it is cut."""
    found = truncation.evidence(table(spark, d, "documents"), "doc_id", "text", "source")
    return found.select("source", "unit", "length", "form", "n", *[F.round(c, 6).alias(c) for c in ("share", "places", "relative_hazard")], "cut")


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p8_found, p8_rates, p8_limits, p8_evidence)}
ORACLE: dict[str, str] = {}
