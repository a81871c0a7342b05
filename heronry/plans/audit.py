"""Queries on episode rows: session operators, audits, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.text import base_id, error_class
from heronry.operators import episodes as E
from heronry.operators import flatten
from heronry.operators import relational as R
from heronry.plans.registry import query
from heronry.session import table

CALLS = """good AS (SELECT * FROM episodes WHERE json_valid(coalesce(body, ''))),
turned AS (SELECT delivery_id, 0 AS turn, json_extract(body, '$.tool_calls') AS tc FROM good UNION ALL SELECT delivery_id, CAST(t.i AS BIGINT), json_extract(body, '$.turns[' || t.i || '].tool_calls') FROM good, range(0, 12) t(i) WHERE t.i < coalesce(json_array_length(json_extract(body, '$.turns')), 0)),
calls AS (SELECT delivery_id, row_number() OVER (PARTITION BY delivery_id ORDER BY turn, j.i) AS call_no, json_extract_string(tc, '$[' || j.i || '].tool') AS tool, coalesce(json_array_length(json_extract(tc, '$[' || j.i || '].returned_ids')), 0) AS n_ids FROM turned, range(0, 40) j(i) WHERE json_type(tc) = 'ARRAY' AND j.i < json_array_length(tc))"""
ROWS = "rows AS (SELECT delivery_id, lower(trim(model)) AS model, condition, instance_id, CAST(json_extract(body, '$.latency_ms') AS BIGINT) AS latency_ms, CAST(json_extract(body, '$.n_tool_calls') AS INT) AS n_tool_calls, CAST(json_extract(body, '$.valid') AS BOOLEAN) AS valid, json_extract_string(body, '$.ranked[*]') AS ranked FROM episodes WHERE json_valid(coalesce(body, '')) AND coalesce(body, '') <> '')"

#: Calls with their error and ids, the classes of errors, and the ids that an episode was shown.
_ERR = "CASE WHEN error IS NULL OR error = '' THEN 'none' WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), 'unknown') THEN 'unknown_id' WHEN contains(lower(error), 'blocked') THEN 'blocked' WHEN contains(lower(error), 'budget') THEN 'budget' WHEN contains(lower(error), 'json') OR contains(lower(error), 'parse') THEN 'malformed' ELSE 'other' END"
FULL = CALLS.replace("json_extract_string(tc, '$[' || j.i || '].tool') AS tool,", "json_extract_string(tc, '$[' || j.i || '].tool') AS tool, json_extract_string(tc, '$[' || j.i || '].error') AS error, json_extract(tc, '$[' || j.i || '].returned_ids') AS ids,")
SEEN = "seen AS (SELECT DISTINCT delivery_id, id FROM (SELECT delivery_id, CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.id') ELSE json_extract_string(x, '$') END AS id FROM (SELECT delivery_id, json_extract(ids, '$[' || k.i || ']') AS x FROM calls, range(0, 128) k(i) WHERE k.i < n_ids)) WHERE id IS NOT NULL)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return flatten.calls_table(table(spark, d, "episodes"), ["delivery_id"])


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return E.read_episodes(table(spark, d, "episodes"))


@query(f"WITH {CALLS} SELECT delivery_id, CAST(call_no AS INT) AS call_no, tool, CAST(n_ids AS INT) AS n_ids FROM calls")
def e14_call_rows(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("delivery_id", "call_no", "tool", "n_ids")


@query(f"WITH {CALLS} SELECT delivery_id, CAST(count(*) AS BIGINT) AS n_calls, CAST(sum(n_ids) AS BIGINT) AS ids_shown, CAST(count(*) FILTER (n_ids = 0) AS BIGINT) AS empty_calls, CAST(min(CASE WHEN n_ids > 0 THEN call_no END) AS INT) AS first_hit_call, CAST(count(DISTINCT tool) AS BIGINT) AS tools_used FROM calls GROUP BY 1")
def e19_episode_assembly(spark: SparkSession, d: str) -> DataFrame:
    return E.steps(_calls(spark, d))


@query()
def e02_replayed_loop(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded episode run again through the bounded loop."""
    ids = flatten.ids_table(table(spark, d, "episodes"), ["delivery_id"])
    calls = ids.groupBy("delivery_id", "call_no", "tool").agg(F.array_sort(F.collect_list(F.when(F.col("id_no") > 0, F.struct("id_no", "paper_id"))))["paper_id"].alias("paper_ids"))
    return E.replay_episodes(calls, _rows(spark, d).select("delivery_id", "ranked"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type = 'purchase' THEN 'final' WHEN event_type IN ('click', 'view') THEN 'call' ELSE 'unknown_verb' END AS kind, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN 'finalize' ELSE event_type END AS verb FROM events""")
def e09_action_parser(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_type") == "error", "no object here").otherwise(F.concat(F.lit('I will {"action": "'), F.when(F.col("event_type") == "purchase", "finalize").otherwise(F.col("event_type")), F.lit('", "query": "x"} now')))
    return table(spark, d, "events").select("event_id", E.parse_action(t, ["click", "view"]).alias("a")).select("event_id", "a.kind", "a.verb")


@query("SELECT p_partkey, CAST(least(p_size, 20) AS INT) AS k, CAST(least(p_size % 7, 4) AS INT) AS max_hops FROM part")
def e07_call_validation(spark: SparkSession, d: str) -> DataFrame:
    a = F.struct(F.col("p_size").alias("k"), (F.col("p_size") % 7).alias("max_hops"))
    return table(spark, d, "part").select("p_partkey", E.validate_call(a).alias("v")).select("p_partkey", "v.*")


@query(f"WITH {FULL}, {SEEN}, {ROWS}, u AS (SELECT DISTINCT delivery_id FROM (SELECT delivery_id, unnest(ranked) AS id FROM rows) r WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.delivery_id = r.delivery_id AND s.id = r.id)) SELECT delivery_id, CASE WHEN len(ranked) <> len(list_distinct(ranked)) THEN 'repeated' WHEN len(ranked) < 5 THEN 'short_answer' WHEN delivery_id IN (SELECT delivery_id FROM u) THEN 'unobserved' ELSE '' END AS problem FROM rows")
def e08_answer_validation(spark: SparkSession, d: str) -> DataFrame:
    # What an episode was shown is one list per body; body and list are of one row, so nothing is gathered.
    shown = flatten.shown_ids(table(spark, d, "episodes"), ["delivery_id"])
    j = _rows(spark, d).join(shown, "delivery_id", "left")
    return j.select("delivery_id", E.validate_answer(F.col("ranked"), F.coalesce("shown", F.array().cast("array<string>")), 5).alias("problem"))


@query(f"WITH {ROWS} SELECT delivery_id, CAST(least(len(list_distinct(ranked)), 3) AS INT) AS n, coalesce(ranked[1], '') AS first FROM rows")
def e10_final_parser(spark: SparkSession, d: str) -> DataFrame:
    r = F.slice(F.array_distinct("ranked"), 1, 3)
    return _rows(spark, d).select("delivery_id", F.size(r).alias("n"), F.coalesce(F.get(r, 0), F.lit("")).alias("first"))


@query("SELECT paper_id AS inst, CAST(count(*) AS BIGINT) AS steps, md5(string_agg(l, chr(10) ORDER BY doc_id, l)) AS transcript FROM (SELECT *, md5(doc_id || ':' || coalesce(text, '')) AS l FROM documents) WHERE paper_id IS NOT NULL GROUP BY 1")
def e21_transcript(spark: SparkSession, d: str) -> DataFrame:
    # Whole texts; a line is hashed before lines are gathered, so that a paper's row holds 32 characters a line.
    line = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))))
    t = table(spark, d, "documents").filter("paper_id is not null").select(F.col("paper_id").alias("inst"), "doc_id", line.alias("l")).groupBy("inst")
    return t.agg(F.count("*").alias("steps"), F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "l")))["l"], "\n")).alias("transcript"))


@query("SELECT row_id, 'id=' || arxiv_id || ' | title=' || coalesce(title, '') || ' | abstract=' || left(coalesce(abstract, ''), 220) AS line FROM papers WHERE arxiv_id IS NOT NULL")
def e20_rendering(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").filter("arxiv_id is not null")
    return p.select("row_id", F.format_string("id=%s | title=%s | abstract=%s", "arxiv_id", F.coalesce("title", F.lit("")), F.left(F.coalesce("abstract", F.lit("")), F.lit(220))).alias("line"))


@query("SELECT instance_id, min(rec_id) AS rec_id, left(sha256(instance_id || '|9'), 16) AS h FROM frozen_ids WHERE instance_id IN (SELECT instance_id FROM (SELECT DISTINCT instance_id FROM frozen_ids) ORDER BY sha256(instance_id || '|9'), instance_id LIMIT 40) GROUP BY 1")
def e18_freeze(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frozen_ids").groupBy("instance_id").agg(F.min("rec_id").alias("rec_id"))
    return R.seeded_sample(f, 40, 9, "instance_id").select("instance_id", "rec_id", F.left(R.seeded_key(9, "instance_id"), F.lit(16)).alias("h"))


# --- audits and summaries


@query("WITH p AS (SELECT regexp_replace(arxiv_id, 'v[0-9]+$', '') AS b, min(submit_date) AS known FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1) SELECT rec_id, CASE WHEN known IS NULL THEN 'unknown' WHEN known > frozen_at THEN 'illegal' ELSE 'legal' END AS status FROM frozen_ids LEFT JOIN p ON b = regexp_replace(source_paper_id, 'v[0-9]+$', '')")
def q01_temporal_audit(spark: SparkSession, d: str) -> DataFrame:
    # What has no date is unknown, which is no violation; what became known after the freeze is one.
    f = table(spark, d, "frozen_ids").select("rec_id", "frozen_at", base_id("source_paper_id").alias("b"))
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("known") > F.col("frozen_at"), "illegal").otherwise("legal")
    return f.join(_known(spark, d), "b", "left").select("rec_id", status.alias("status"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """(b, known): the day from which a paper is known."""
    return table(spark, d, "papers").filter("arxiv_id is not null").groupBy(base_id("arxiv_id").alias("b")).agg(F.min("submit_date").alias("known"))


@query("WITH p AS (SELECT regexp_replace(arxiv_id, 'v[0-9]+$', '') AS b, min(submit_date) AS known FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1) SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (paper_id IS NULL) AS BIGINT) AS ownerless, CAST(count(*) FILTER (paper_id IS NOT NULL AND known IS NULL) AS BIGINT) AS undated, CAST(count(*) FILTER (known > ingested_at) AS BIGINT) AS future, bool_and(coalesce(known <= ingested_at, true)) AS passed FROM documents LEFT JOIN p ON b = regexp_replace(paper_id, 'v[0-9]+$', '') GROUP BY 1")
def q02_candidate_audit(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("source", "paper_id", "ingested_at", base_id("paper_id").alias("b")).join(_known(spark, d), "b", "left")
    future = F.coalesce(F.col("known") > F.col("ingested_at"), F.lit(False))
    return j.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("paper_id").isNull()).alias("ownerless"), F.count_if(F.col("paper_id").isNotNull() & F.col("known").isNull()).alias("undated"),
        F.count_if(future).alias("future"), F.bool_and(~future).alias("passed"),
    )


@query("SELECT o_orderkey AS k, role, id FROM (SELECT o_orderkey, 'source' AS role, o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey, 'anchor', o_custkey FROM orders)")
def q03_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("stack(2, 'source', o_orderkey, 'anchor', o_custkey) as (role, id)"))


@query(f"WITH {CALLS}, {ROWS}, s AS (SELECT delivery_id, sum(n_ids) AS shown FROM calls GROUP BY 1) SELECT model, condition, CAST(count(*) AS BIGINT) AS episodes, CAST(count(*) FILTER (shown > 0) AS BIGINT) AS observed, CAST(count(*) FILTER (shown > 0 AND len(ranked) > 0) AS BIGINT) AS selected FROM rows LEFT JOIN s USING (delivery_id) GROUP BY 1, 2")
def q05_candidate_funnel(spark: SparkSession, d: str) -> DataFrame:
    j = _rows(spark, d).join(E.steps(_calls(spark, d)), "delivery_id", "left")
    return j.groupBy("model", "condition").agg(F.count("*").alias("episodes"), F.count_if(F.col("ids_shown") > 0).alias("observed"), F.count_if((F.col("ids_shown") > 0) & (F.size("ranked") > 0)).alias("selected"))


@query(f"WITH {CALLS}, {ROWS} SELECT model, tool, CAST(count(*) AS BIGINT) AS calls, CAST(count(DISTINCT delivery_id) AS BIGINT) AS episodes FROM calls JOIN rows USING (delivery_id) GROUP BY 1, 2")
def q06_tool_utilisation(spark: SparkSession, d: str) -> DataFrame:
    per = _calls(spark, d).groupBy("delivery_id", "tool").agg(F.count("*").alias("k")).join(_rows(spark, d).select("delivery_id", "model"), "delivery_id")
    return per.groupBy("model", "tool").agg(F.sum("k").alias("calls"), F.count("*").alias("episodes"))


@query(f"WITH {FULL}, {ROWS}, s AS (SELECT delivery_id, sum(n_ids) AS shown, count(*) FILTER (coalesce(error, '') <> '') AS errors FROM calls GROUP BY 1) SELECT condition, CASE WHEN coalesce(errors, 0) > 0 THEN 'tool_error' WHEN NOT valid THEN 'invalid_answer' WHEN coalesce(shown, 0) = 0 THEN 'nothing_observed' WHEN len(ranked) = 0 THEN 'empty_answer' ELSE 'answered' END AS category, CAST(count(*) AS BIGINT) AS n FROM rows LEFT JOIN s USING (delivery_id) GROUP BY 1, 2")
def q07_failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    # Counters of an episode come from its own body.
    calls = flatten._calls(F.col("body"))
    errors = F.size(F.filter(calls, lambda c: F.coalesce(c["error"], F.lit("")) != ""))
    shown = F.aggregate(F.transform(calls, lambda c: F.coalesce(F.size(flatten._ids(c)), F.lit(0))), F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0)))
    per = table(spark, d, "episodes").select("delivery_id", errors.alias("errors"), shown.alias("shown"))
    j = _rows(spark, d).join(per, "delivery_id")
    return j.groupBy("condition", E.failure(F.col("valid"), F.col("shown"), F.col("ranked"), F.col("errors")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {FULL}, {SEEN}, {ROWS}, b AS (SELECT DISTINCT delivery_id, regexp_replace(id, 'v[0-9]+$', '') AS id FROM seen), bad AS (SELECT DISTINCT delivery_id FROM (SELECT delivery_id, regexp_replace(unnest(ranked), 'v[0-9]+$', '') AS id FROM rows) r WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.delivery_id = r.delivery_id AND b.id = r.id)) SELECT condition, CAST(count(*) AS BIGINT) AS n, round(avg((delivery_id NOT IN (SELECT delivery_id FROM bad))::INT), 6) AS faithful FROM rows GROUP BY 1")
def q08_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Share of episodes whose ranked ids were all returned by one of their calls, per condition."""
    seen = flatten.returned_ids(table(spark, d, "episodes"), ["delivery_id"]).select("delivery_id", base_id("paper_id").alias("id")).distinct().withColumn("s", F.lit(1))
    asked = _rows(spark, d).select("delivery_id", "condition", F.explode_outer("ranked").alias("r")).select("delivery_id", "condition", base_id("r").alias("id"))
    per = asked.join(seen, ["delivery_id", "id"], "left").groupBy("condition", "delivery_id").agg(F.bool_and(F.col("id").isNull() | F.col("s").isNotNull()).alias("ok"))
    return per.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("faithful"))


@query("WITH g AS (SELECT * FROM episodes WHERE json_valid(coalesce(body, '')) AND coalesce(body, '') <> ''), s AS (SELECT condition, m.i AS milestone, json_extract(body, '$.anytime.\"' || m.i || '\"') AS s FROM g, (VALUES (1), (2), (4), (8)) m(i)) SELECT condition, CAST(milestone AS INT) AS milestone, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(json_extract(s, '$.metrics.mrr') AS DOUBLE)), 6) AS mrr FROM s WHERE s IS NOT NULL GROUP BY 1, 2")
def q09_anytime_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.anytime(_rows(spark, d)).groupBy("condition", "milestone").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query(f"WITH {ROWS} SELECT model, condition, CAST(count(*) AS BIGINT) AS n, round(avg(latency_ms), 6) AS latency_ms, round(avg(n_tool_calls), 6) AS calls, round(avg(valid::INT), 6) AS valid FROM rows GROUP BY 1, 2")
def q10_metrics_by_condition(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).groupBy("model", "condition")
    return r.agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"), F.round(F.avg("n_tool_calls"), 6).alias("calls"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid"))


@query("SELECT condition, count(DISTINCT json_extract_string(body, '$.protocol')) = 1 AS one_protocol, count(DISTINCT json_extract_string(body, '$.prompt_version')) = 1 AS one_prompt FROM episodes WHERE json_valid(coalesce(body, '')) AND coalesce(body, '') <> '' GROUP BY 1")
def q11_invariants(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").select("condition", F.from_json("body", "protocol string, prompt_version string, n_tool_calls int").alias("e")).filter("e.n_tool_calls is not null")
    g = e.groupBy("condition").agg(F.min("e.protocol").alias("a"), F.max("e.protocol").alias("b"), F.min("e.prompt_version").alias("c"), F.max("e.prompt_version").alias("d"))
    return g.select("condition", (F.col("a") == F.col("b")).alias("one_protocol"), (F.col("c") == F.col("d")).alias("one_prompt"))


@query("SELECT check_name, passed FROM (SELECT 'orders have customers' AS check_name, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS passed UNION ALL SELECT 'lines have orders', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'ids are unique', (SELECT count(*) = count(DISTINCT doc_id) FROM documents))")
def q12_smoke_gate(spark: SparkSession, d: str) -> DataFrame:
    o, c, li = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    none = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), (F.col("n") == 0).alias("passed"))
    a = none(o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "orders have customers")
    b = none(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "lines have orders")
    twice = table(spark, d, "documents").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    return a.unionByName(b).unionByName(none(twice, "ids are unique"))


@query(f"WITH {ROWS}, m AS (SELECT condition, round(avg(latency_ms), 6) AS latency FROM rows GROUP BY 1), b AS (SELECT latency FROM m WHERE condition = 'bm25_one_shot_ctrl') SELECT m.condition, printf('%.3f', m.latency) AS latency, printf('%+.1f', m.latency - b.latency) AS against_one_shot FROM m, b")
def q14_appendix_table(spark: SparkSession, d: str) -> DataFrame:
    m = _rows(spark, d).groupBy("condition").agg(F.round(F.avg("latency_ms"), 6).alias("latency"))
    b = m.filter("condition = 'bm25_one_shot_ctrl'").select(F.col("latency").alias("base"))  # one row
    return m.crossJoin(F.broadcast(b)).select("condition", F.format_string("%.3f", "latency").alias("latency"), F.format_string("%+.1f", F.col("latency") - F.col("base")).alias("against_one_shot"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(model)), condition, instance_id ORDER BY received_at DESC, delivery_id DESC) AS n FROM episodes) SELECT delivery_id FROM k WHERE n = 1")
def q15_unified_loading(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.lower(F.trim("model")).alias("m"), F.col("condition"), F.col("instance_id")]
    last = F.max_by("delivery_id", F.struct("received_at", "delivery_id"))
    return table(spark, d, "episodes").groupBy(*keys).agg(last.alias("delivery_id")).select("delivery_id")


@query(f"WITH {ROWS} SELECT instance_id, CAST(count(DISTINCT condition) AS BIGINT) AS conditions, max(latency_ms) - min(latency_ms) AS spread FROM rows GROUP BY 1")
def e06_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).groupBy("instance_id")
    return r.agg(F.count_distinct("condition").alias("conditions"), (F.max("latency_ms") - F.min("latency_ms")).alias("spread"))


@query(f"WITH {FULL} SELECT {_ERR} AS class, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n_ids > 0) AS BIGINT) AS with_ids FROM calls WHERE coalesce(error, '') <> '' GROUP BY 1")
def q13_error_verification(spark: SparkSession, d: str) -> DataFrame:
    """Checks over calls that carry an error: class, and whether ids came with it all the same."""
    c = F.explode(F.transform(flatten._calls(F.col("body")), lambda c: F.struct(F.coalesce(c["error"], F.lit("")).alias("error"), F.coalesce(F.size(flatten._ids(c)), F.lit(0)).alias("n")))).alias("c")
    return table(spark, d, "episodes").select(c).filter("c.error <> ''").groupBy(error_class("c.error").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("c.n") > 0).alias("with_ids"))
