"""Queries of the core: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.timestamps import normalise
from heronry.operators import dedupe, drift, flatten, temporal
from heronry.plans import agents, audit, functions, graph, relational, retrieval, sources  # noqa: F401  (each registers its queries)
from heronry.plans.registry import ORACLE as _SQL
from heronry.plans.registry import QUERIES as _PLANS
from heronry.session import table

HYBRID = "compact_hybrid_controlled_agent"
MESSAGE = ["run_id", "model", "condition", "instance_id"]


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").filter(F.col("condition") == HYBRID)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Revision in force at the instance's as_of of every paper its compact hybrid agents got back."""
    feeds = table(spark, d, "feeds")
    as_of = (
        normalise(table(spark, d, "frozen_ids").select("instance_id", "as_of", "feed"), "as_of", "feed", feeds)
        .filter(F.col("utc_us").isNotNull() & F.col("instance_id").isNotNull())
        .groupBy("instance_id").agg(F.min("utc_us").alias("at"))
    )
    base = F.regexp_replace("paper_id", r"v\d+$", "")
    pairs = flatten.returned_ids(_hybrid(spark, d), ["instance_id"]).select("instance_id", base.alias("paper_id")).filter("paper_id <> ''").distinct()
    papers = table(spark, d, "temporal_objects").filter(F.col("obj_id").startswith("paper:")).select("obj_id", "revision", "available_at", "feed")
    known = normalise(papers, "available_at", "feed", feeds).withColumn("paper_id", F.expr("substring(obj_id, 7)"))
    intervals = temporal.validity(known, "paper_id", "utc_us", "revision")
    got = temporal.as_of_join(pairs.join(as_of, "instance_id"), intervals, "paper_id", "at", ["instance_id"])
    return got.select("instance_id", "paper_id", F.coalesce("attribute", F.lit(0)).cast("int").alias("revision"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every readable as_of and available_at as one UTC instant."""
    # What the values of a feed say of its formats counts whichever table they stand in.
    each = [table(spark, d, name).select(F.lit(name).alias("tbl"), "rec_id", F.col(value).alias("value"), "feed") for name, value in (("frozen_ids", "as_of"), ("temporal_objects", "available_at"))]
    read = normalise(each[0].unionByName(each[1]), "value", "feed", table(spark, d, "feeds"))
    return read.filter(F.col("utc_us").isNotNull()).select("tbl", "rec_id", "utc_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that are not the kept copy of their message."""
    return dedupe.repeated(table(spark, d, "episodes"), MESSAGE, "received_at", "delivery_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Returned ids of the compact hybrid agent's tool calls, one flat row each."""
    return flatten.ids_table(_hybrid(spark, d), ["delivery_id"]).select("delivery_id", "call_no", "id_no", "tool", "query_text", "paper_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a result file's fields against the preceding file of its stream."""
    return drift.changes(table(spark, d, "raw_records"), table(spark, d, "result_files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All result records in one consistent table."""
    records, files = table(spark, d, "raw_records"), table(spark, d, "result_files")
    return drift.unified(records, files, drift.changes(records, files))


def p3_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of the last batch that a store of all earlier batches takes in."""
    e = table(spark, d, "episodes").select("delivery_id", "batch_no", "received_at", *MESSAGE)
    last = e.agg(F.max("batch_no").alias("last"))  # one row
    marked = e.crossJoin(F.broadcast(last))
    new, old = marked.filter("batch_no = last"), marked.filter("batch_no < last")
    return dedupe.admit(new, old.select(*dedupe.identity(old, MESSAGE)).distinct(), MESSAGE, "received_at", "delivery_id").select("delivery_id")


def p4_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls of the compact hybrid agent, the table above the returned ids."""
    return flatten.calls_table(_hybrid(spark, d), ["delivery_id"])


def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    """How the notations of each feed were read, unresolved ambiguity included."""
    read = normalise(table(spark, d, "temporal_objects").select("rec_id", "available_at", "feed"), "available_at", "feed", table(spark, d, "feeds"))
    return read.groupBy("feed", "reading").agg(F.count("*").alias("n"), F.round(F.min("posterior"), 6).alias("least_posterior"), F.count_if(F.col("posterior") < 1).alias("below_one"))


def p5_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of files in which each stream's field has a type."""
    return drift.islands(drift.catalogue(drift.footers(table(spark, d, "raw_records")), drift.file_order(table(spark, d, "result_files"))))


_IDS = ", ".join(f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) AS {c}" for c in MESSAGE)
_SAME = " AND ".join(f"s.{c} IS NOT DISTINCT FROM n.{c}" for c in MESSAGE)
_CALLS = f"""good AS (SELECT delivery_id, body FROM episodes WHERE condition = '{HYBRID}' AND json_valid(coalesce(body, ''))),
turned AS (SELECT delivery_id, 0 AS turn, json_extract(body, '$.tool_calls') AS tc FROM good UNION ALL SELECT delivery_id, CAST(t.i AS BIGINT), json_extract(body, '$.turns[' || t.i || '].tool_calls') FROM good, range(0, 64) t(i) WHERE t.i < coalesce(json_array_length(json_extract(body, '$.turns')), 0)),
calls AS (SELECT delivery_id, CAST(row_number() OVER (PARTITION BY delivery_id ORDER BY turn, j.i) AS INT) AS call_no, coalesce(json_extract_string(tc, '$[' || j.i || '].tool'), '') AS tool, json_extract(tc, '$[' || j.i || '].arguments') AS args, json_extract(tc, '$[' || j.i || '].returned_ids') AS ids FROM turned, range(0, 64) j(i) WHERE json_type(tc) = 'ARRAY' AND j.i < json_array_length(tc)),
asked AS (SELECT *, coalesce(CASE WHEN json_type(args) = 'VARCHAR' THEN json_extract_string(json_extract_string(args, '$'), '$.query') ELSE json_extract_string(args, '$.query') END, '') AS query_text, coalesce(json_array_length(ids), 0) AS n FROM calls)"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_readings, p3_found, p3_new_batch, p4_found, p4_calls, p5_found, p5_lifespans, p5_table)
}
ORACLE = {
    "p3_found": f"WITH k AS (SELECT delivery_id, received_at, {_IDS} FROM episodes) SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY {', '.join(MESSAGE)} ORDER BY received_at NULLS LAST, delivery_id) AS n FROM k) WHERE n > 1",
    "p3_new_batch": f"WITH k AS (SELECT delivery_id, received_at, batch_no, {_IDS} FROM episodes), n AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(MESSAGE)} ORDER BY received_at NULLS LAST, delivery_id) AS r FROM k WHERE batch_no = (SELECT max(batch_no) FROM k)) SELECT delivery_id FROM n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM k s WHERE s.batch_no < n.batch_no AND {_SAME})",
    "p4_found": f"WITH {_CALLS} SELECT delivery_id, call_no, CAST(CASE WHEN n = 0 THEN 0 ELSE k.i + 1 END AS INT) AS id_no, tool, query_text, coalesce(CASE WHEN json_type(json_extract(ids, '$[' || k.i || ']')) = 'OBJECT' THEN json_extract_string(ids, '$[' || k.i || '].id') ELSE json_extract_string(ids, '$[' || k.i || ']') END, '') AS paper_id FROM asked, range(0, 256) k(i) WHERE k.i < greatest(n, 1)",
    "p4_calls": f"WITH {_CALLS} SELECT delivery_id, call_no, tool, query_text, CAST(n AS INT) AS n_ids FROM asked",
}

QUERIES |= _PLANS
ORACLE |= _SQL
