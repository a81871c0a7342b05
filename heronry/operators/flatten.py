"""Deeply nested tool-call records to flat tables with parent-child links.

One higher-order projection per record: a first ``transform`` walks the calls of the body, a nested ``transform``
walks the ids of a call and attaches the ancestors' keys and positions, ``flatten`` joins the arrays, and one
``inline`` per target table emits the rows. Nothing is shuffled: the plan is scan, project, generate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Only what the target tables need is parsed; whatever may be of several types is taken as its JSON text.
CALL = "struct<tool:string,arguments:string,returned_ids:string,error:string,latency_ms:string>"
BODY = f"struct<tool_calls:array<{CALL}>,turns:array<struct<tool_calls:array<{CALL}>>>>"


def _ids(call: Column) -> Column:
    """Ids of a call as written: strings, or the ``id`` of objects; null elements are no ids."""
    listed = F.filter(F.from_json(call["returned_ids"], "array<string>"), lambda x: x.isNotNull())
    return F.transform(listed, lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.id"), F.lit(""))).otherwise(x))


def _calls(body: Column) -> Column:
    """All calls in written order, through all turns; null calls and turns hold none."""
    parsed = F.from_json(body, BODY)
    none = F.from_json(F.lit("[]"), f"array<{CALL}>")
    turns = F.coalesce(F.transform(parsed["turns"], lambda t: F.coalesce(t["tool_calls"], none)), F.array(none))
    every = F.flatten(F.concat(F.array(F.coalesce(parsed["tool_calls"], none)), turns))
    return F.filter(every, lambda c: c.isNotNull())


def _complete(body: Column) -> Column:
    """A body that goes on after its object ends is no JSON; the parser alone would stop reading there."""
    return F.rtrim(body).endswith("}")


def _call_rows(calls: Column) -> Column:
    return F.transform(
        calls,
        lambda c, i: F.struct(
            (i + 1).alias("call_no"),
            F.coalesce(c["tool"], F.lit("")).alias("tool"),
            F.coalesce(F.get_json_object(c["arguments"], "$.query"), F.lit("")).alias("query_text"),
            F.coalesce(_ids(c), F.array().cast("array<string>")).alias("ids"),
        ),
    )


def calls_table(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per tool call: ``keys``, call_no from 1, tool, query_text, n_ids.

    Bodies that are null, empty or no JSON object, and bodies without calls, give no rows. A missing or null tool or
    query is ''. Repeated input rows give repeated output rows.
    """
    rows = df.filter(_complete(F.col(body))).select(*keys, F.inline(_call_rows(_calls(F.col(body)))))
    return rows.select(*keys, "call_no", "tool", "query_text", F.size("ids").alias("n_ids"))


def ids_table(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per returned id: ``keys``, call_no and id_no from 1, tool, query_text, paper_id as written.

    A call without ids (null, missing or empty list) gives one row with id_no 0 and paper_id ''. Otherwise as
    ``calls_table``.
    """
    per_call = F.transform(
        _call_rows(_calls(F.col(body))),
        lambda c: F.transform(
            F.when(F.size(c["ids"]) > 0, c["ids"]).otherwise(F.array(F.lit(None).cast("string"))),
            lambda d, j: F.struct(
                c["call_no"].alias("call_no"),
                F.when(d.isNull(), 0).otherwise(j + 1).alias("id_no"),
                c["tool"].alias("tool"),
                c["query_text"].alias("query_text"),
                F.coalesce(d, F.lit("")).alias("paper_id"),
            ),
        ),
    )
    return df.filter(_complete(F.col(body))).select(*keys, F.inline(F.flatten(per_call)))


def shown_ids(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Distinct ids of each record as one list, ``shown``; a record has at most what its one body holds. No shuffle."""
    ids = F.array_distinct(F.flatten(F.transform(_calls(F.col(body)), lambda c: F.coalesce(_ids(c), F.array().cast("array<string>")))))
    return df.filter(_complete(F.col(body))).select(*keys, ids.alias("shown"))


def returned_ids(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Distinct ids of each record only, for consumers that need no calls: ``keys``, paper_id; no shuffle."""
    ids = F.array_distinct(F.flatten(F.transform(_calls(F.col(body)), lambda c: F.coalesce(_ids(c), F.array().cast("array<string>")))))
    return df.filter(_complete(F.col(body))).select(*keys, F.explode(ids).alias("paper_id"))
