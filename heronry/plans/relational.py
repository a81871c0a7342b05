"""Queries of filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators import relational as R
from heronry.plans.registry import query
from heronry.session import table

CUTOFF = "1998-01-01"


# --- filters


@query("SELECT a.paper_id, b.n FROM (SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL) a LEFT JOIN (SELECT source_paper_id, CAST(count(*) AS BIGINT) AS n FROM frozen_ids GROUP BY 1) b ON a.paper_id = b.source_paper_id WHERE b.n IS NOT NULL")
def p01_null_filter(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "documents").select("paper_id").filter(F.col("paper_id").isNotNull()).distinct()
    n = table(spark, d, "frozen_ids").groupBy("source_paper_id").agg(F.count("*").alias("n"))
    return seen.join(n, F.col("paper_id") == F.col("source_paper_id"), "left").filter(F.col("n").isNotNull()).select("paper_id", "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 100 <> l_suppkey")
def p02_column_not_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter(F.col("l_partkey") % 100 != F.col("l_suppkey")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 5")
def p03_range_filter(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return parts.groupBy("l_orderkey").agg(F.count("*").alias("n_parts")).filter(F.col("n_parts").between(2, 5))


@query(f"SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_shipdate IS NOT NULL AND l_shipdate <= TIMESTAMP '{CUTOFF} 00:00:00')")
def p04_all_members_legal(spark: SparkSession, d: str) -> DataFrame:
    legal = F.col("l_shipdate").isNotNull() & (F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(legal).alias("ok")).filter("ok").select("l_orderkey")


@query(r"SELECT doc_id, concat_ws('|', CASE WHEN regexp_full_match(coalesce(text, ''), '\s*') THEN 'E1' END, CASE WHEN lang IS NULL OR lang = 'und' THEN 'E2' END, CASE WHEN paper_id IS NULL THEN 'E3' END, CASE WHEN n_chars > 2000 THEN 'E4' END, CASE WHEN section IS NULL THEN 'E5' END) AS reasons FROM documents")
def p05_rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = [
        ("E1", F.coalesce(c("text"), F.lit("")).rlike(r"^\s*$")), ("E2", c("lang").isNull() | (c("lang") == "und")),
        ("E3", c("paper_id").isNull()), ("E4", c("n_chars") > 2000), ("E5", c("section").isNull()),
    ]
    return table(spark, d, "documents").select("doc_id", R.reasons(rules).alias("reasons"))


@query(f"SELECT o_orderkey, o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '{CUTOFF} 00:00:00' AS visible FROM orders")
def p06_temporal_visibility(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", (at.isNotNull() & (at <= F.lit(CUTOFF).cast("timestamp"))).alias("visible"))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) FILTER (ts <= TIMESTAMP '2024-01-10 00:00:00') IS NOT NULL AS any_visible, CAST(count(*) FILTER (ts <= TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS n_visible, CAST(count(*) FILTER (ts > TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS n_hidden FROM events GROUP BY 1")
def p07_visible_hidden_split(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("ts") <= F.lit("2024-01-10").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(seen).alias("any_visible"), F.count_if(seen).alias("n_visible"), F.count_if(~seen).alias("n_hidden"))


@query("SELECT k.id AS obj_id, r.obj_id IS NOT NULL AS known, coalesce(r.any_dated, false) AS dated, r.obj_id IS NOT NULL AND NOT r.any_dated AS unverifiable FROM (SELECT DISTINCT 'paper:' || source_paper_id AS id FROM frozen_ids WHERE source_paper_id IS NOT NULL) k LEFT JOIN (SELECT obj_id, bool_or(available_at IS NOT NULL AND trim(available_at) <> '') AS any_dated FROM temporal_objects GROUP BY 1) r ON k.id = r.obj_id")
def p16_registry_probes(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "frozen_ids").filter(F.col("source_paper_id").isNotNull()).select(F.concat(F.lit("paper:"), "source_paper_id").alias("id")).distinct()
    dated = F.coalesce(F.trim("available_at") != "", F.lit(False))
    reg = table(spark, d, "temporal_objects").groupBy("obj_id").agg(F.bool_or(dated).alias("any_dated"))
    known = F.col("obj_id").isNotNull()
    return asked.join(reg, F.col("id") == F.col("obj_id"), "left").select(
        F.col("id").alias("obj_id"), known.alias("known"), F.coalesce("any_dated", F.lit(False)).alias("dated"), (known & ~F.coalesce("any_dated", F.lit(False))).alias("unverifiable")
    )


@query("SELECT delivery_id, concat_ws('|', CASE WHEN run_id IS NULL THEN 'run_id' END, CASE WHEN NOT regexp_full_match(coalesce(instance_id, ''), 'A1-[0-9]+') THEN 'instance_id' END, CASE WHEN condition NOT IN ('bm25_one_shot_ctrl','correct_hybrid_one_shot_ctrl') AND condition NOT LIKE '%_controlled_agent' THEN 'condition' END, CASE WHEN NOT json_valid(coalesce(body, '')) THEN 'body' END) AS violations FROM episodes WHERE run_id IS NULL OR NOT regexp_full_match(coalesce(instance_id, ''), 'A1-[0-9]+') OR NOT json_valid(coalesce(body, ''))")
def p17_schema_violations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = [
        ("run_id", c("run_id").isNull()), ("instance_id", ~F.coalesce(c("instance_id"), F.lit("")).rlike("^A1-[0-9]+$")),
        ("condition", ~c("condition").isin("bm25_one_shot_ctrl", "correct_hybrid_one_shot_ctrl") & ~c("condition").endswith("_controlled_agent")),
        ("body", F.try_parse_json("body").isNull()),
    ]
    return table(spark, d, "episodes").select("delivery_id", R.reasons(rules).alias("violations")).filter("violations <> ''")


@query("SELECT event_id, event_type, event_type NOT IN ('click','view','purchase') AS blocked, CASE WHEN event_type IN ('click','view','purchase') THEN value ELSE 0 END AS observed FROM events")
def p13_tool_whitelist(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    verbs = spark.createDataFrame([("click",), ("view",), ("purchase",)], "verb string")  # a literal rule table
    hit = ev.join(F.broadcast(verbs), F.col("event_type") == F.col("verb"), "left")
    return hit.select("event_id", "event_type", F.col("verb").isNull().alias("blocked"), F.when(F.col("verb").isNotNull(), F.col("value")).otherwise(0.0).alias("observed"))


@query("SELECT doc_id, section FROM documents WHERE NOT (paper_id IS NULL)")
def p14_verified_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("unverifiable", F.col("paper_id").isNull()).filter("not unverifiable").select("doc_id", "section")


@query("SELECT doc_id, 'D-' || doc_id AS instance_id, 'literature' AS task, '1.0' AS schema_version, left(coalesce(text, ''), 8000) AS masked_text FROM documents")
def p15_computed_projection(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("D-"), "doc_id").alias("instance_id"), F.lit("literature").alias("task"), F.lit("1.0").alias("schema_version"), F.left(F.coalesce("text", F.lit("")), F.lit(8000)).alias("masked_text"))
    return table(spark, d, "documents").select("doc_id", one.alias("i")).select("doc_id", "i.*")


# --- joins


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j01_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_mktsegment")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j02_inner_join(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j03_semi_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_quantity > 45")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT instance_id, CAST(count(*) AS BIGINT) AS n FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM frozen_ids f WHERE f.instance_id = e.instance_id) GROUP BY 1")
def j04_anti_join(spark: SparkSession, d: str) -> DataFrame:
    e, f = table(spark, d, "episodes"), table(spark, d, "frozen_ids").select("instance_id")
    return e.join(f, "instance_id", "left_anti").groupBy("instance_id").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.user_id, round(a.v, 6) AS hi, round(b.v, 6) AS lo, round(a.v - b.v, 6) AS diff FROM m a JOIN m b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def j05_paired_join(spark: SparkSession, d: str) -> DataFrame:
    # Both conditions of a pair are in one aggregation over the key: the self-join needs no second scan.
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    m = table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b"))
    return m.dropna().select("user_id", F.round("a", 6).alias("hi"), F.round("b", 6).alias("lo"), F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query("SELECT instance_id FROM episodes GROUP BY 1 HAVING count(DISTINCT condition) = (SELECT count(DISTINCT condition) FROM episodes)")
def j06_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").select("instance_id", "condition").distinct()
    n = e.select("condition").distinct().agg(F.count("*").alias("k"))  # one row
    return e.groupBy("instance_id").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("k")).select("instance_id")


@query("WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(n_name, '') AS n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k WHERE customers IS NOT NULL OR suppliers IS NOT NULL")
def j07_full_outer_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    both = a.join(b, "k", "full").join(c, "k", "full").filter("customers is not null or suppliers is not null")
    return both.select("k", F.coalesce("n_name", F.lit("")).alias("n_name"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_early FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY 1")
def j08_as_of_legality(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    near = (li.l_orderkey == o.o_orderkey) & (li.l_shipdate <= o.o_orderdate + F.expr("INTERVAL 30 DAY"))
    return li.join(o, near).groupBy("l_orderkey").agg(F.count("*").alias("n_early"))


@query("WITH p AS (SELECT a.s_suppkey AS anchor, c.s_suppkey AS near, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(round(c.s_acctbal - a.s_acctbal, 6)), c.s_suppkey) AS rank FROM supplier a JOIN supplier c ON c.s_suppkey <> a.s_suppkey) SELECT anchor, near, CAST(rank AS INT) AS rank FROM p WHERE rank <= 3")
def j12_nearest_by_gap(spark: SparkSession, d: str) -> DataFrame:
    return R.nearest(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 3)


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id, CAST(i AS INT) AS pos, a[i] AS a, a[len(a) + 1 - i] AS b FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM w)")
def j13_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    # The aligned lists are all words of a text and the same words from the end.
    docs = table(spark, d, "documents").filter("text is not null and text <> ''").select("doc_id", F.split("text", " ").alias("a"))
    z = F.arrays_zip("a", F.reverse("a").alias("b"))
    return docs.select("doc_id", F.posexplode(z).alias("p", "z")).select("doc_id", (F.col("p") + 1).alias("pos"), F.col("z.a").alias("a"), F.col("z.b").alias("b"))


@query("SELECT r_name, s.status, m.metric FROM region, (VALUES ('O'), ('F'), ('P')) s(status), (VALUES ('mrr'), ('recall')) m(metric)")
def j14_config_product(spark: SparkSession, d: str) -> DataFrame:
    # A product of literal settings with a dimension of five rows: one explode, no join.
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(m).alias("metric")) for s in "OFP" for m in ("mrr", "recall")]))
    return table(spark, d, "region").select("r_name", grid.alias("g")).select("r_name", "g.status", "g.metric")


@query("WITH o AS (SELECT section, source, lang, paper_id, count(*) AS same FROM documents GROUP BY ALL), n AS (SELECT section, source, lang, sum(same) AS n FROM o GROUP BY ALL) SELECT doc_id, CAST(n - same AS BIGINT) AS others FROM documents d JOIN n USING (section, source, lang) JOIN o ON o.section = d.section AND o.source = d.source AND o.lang = d.lang AND o.paper_id IS NOT DISTINCT FROM d.paper_id WHERE n > same")
def j15_group_exclusion(spark: SparkSession, d: str) -> DataFrame:
    # Others are the rows of the group less those of the own paper, from counts: no pairs.
    docs = table(spark, d, "documents").select("doc_id", "section", "source", "lang", "paper_id")
    keys = ["section", "source", "lang"]
    own = docs.groupBy(*keys, "paper_id").agg(F.count("*").alias("same"))
    all_in = own.groupBy(*keys).agg(F.sum("same").alias("n"))
    match = reduce(lambda x, y: x & y, [F.col(f"x.{k}") == F.col(f"o.{k}") for k in keys]) & F.col("x.paper_id").eqNullSafe(F.col("o.paper_id"))
    both = docs.join(all_in, keys).alias("x").join(own.alias("o"), match, "left")
    return both.select(F.col("x.doc_id").alias("doc_id"), (F.col("x.n") - F.coalesce("o.same", F.lit(0))).alias("others")).filter("others > 0")


@query("SELECT DISTINCT user_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts < a.ts)")
def j16_seen_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("ts")))
    e = table(spark, d, "events").groupBy("user_id").agg(first("click").alias("c"), first("view").alias("v"))
    return e.filter("c is not null and (v is null or v >= c)").select("user_id")


# --- aggregations


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def a01_group_min_max_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def a02_sorted_distinct_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("parts"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def a03_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT count(*) AS a, count(*) FILTER (l_quantity > 10) AS b, count(*) FILTER (l_quantity > 10 AND l_discount < 0.05) AS c, count(*) FILTER (l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'R') AS d FROM lineitem) SELECT 0 AS stage_no, 'all' AS stage, CAST(a AS BIGINT) AS n FROM s UNION ALL SELECT 1, 'quantity', CAST(b AS BIGINT) FROM s UNION ALL SELECT 2, 'discount', CAST(c AS BIGINT) FROM s UNION ALL SELECT 3, 'returned', CAST(d AS BIGINT) FROM s")
def a04_funnel(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return R.funnel(table(spark, d, "lineitem"), [("all", F.lit(True)), ("quantity", c("l_quantity") > 10), ("discount", c("l_discount") < 0.05), ("returned", c("l_returnflag") == "R")])


@query("WITH u AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round(avg(v), 6) AS macro_mean, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1")
def a05_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return u.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("macro_mean"), F.count("*").alias("n"))


@query("SELECT source, round(coalesce(avg(CASE WHEN lang <> 'und' THEN n_chars END), 0), 6) AS mean_chars FROM documents GROUP BY 1")
def a06_null_skipping_mean(spark: SparkSession, d: str) -> DataFrame:
    v = F.avg(F.when(F.col("lang") != "und", F.col("n_chars")))
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.coalesce(v, F.lit(0)), 6).alias("mean_chars"))


@query("SELECT l_linestatus, round(coalesce(avg(l_quantity), 0), 6) AS mean_quantity FROM lineitem GROUP BY 1")
def a07_null_failing_mean(spark: SparkSession, d: str) -> DataFrame:
    checked = F.when(F.col("l_quantity").isNull(), F.raise_error(F.lit("null in a mean that takes none")).cast("double")).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.coalesce(F.avg(checked), F.lit(0.0)), 6).alias("mean_quantity"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / greatest(sum(l_extendedprice), 1), 6) AS share FROM lineitem GROUP BY 1")
def a08_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    num, den = F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(num / F.greatest(den, F.lit(1.0)), 6).alias("share"))


@query("SELECT source, round(count(*) FILTER (lang = 'de') / nullif(count(*) FILTER (lang = 'fr'), 0), 6) AS ratio FROM documents GROUP BY 1")
def a09_ratio_blank_on_zero(spark: SparkSession, d: str) -> DataFrame:
    r = F.try_divide(F.count_if(F.col("lang") == "de"), F.count_if(F.col("lang") == "fr"))
    return table(spark, d, "documents").groupBy("source").agg(F.round(r, 6).alias("ratio"))


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_error, round(avg(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate FROM events GROUP BY 1")
def a10_conditional_count(spark: SparkSession, d: str) -> DataFrame:
    err = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(err).alias("n_error"), F.round(F.avg(err.cast("double")), 6).alias("rate"))


@query("SELECT source, CAST(count(DISTINCT w) AS BIGINT) AS n_words FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def a11_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").filter("text is not null").select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("w"))
    return w.distinct().groupBy("source").agg(F.count("*").alias("n_words"))


@query("SELECT c_nationkey, min(c_acctbal) AS upper_median FROM (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i = n // 2 GROUP BY 1")
def a12_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(R.upper_median("c_acctbal").alias("upper_median"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1) SELECT user_id, round(-sum((n / total) * log2(n / total)), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY 1")
def a13_entropy(spark: SparkSession, d: str) -> DataFrame:
    return R.entropy(table(spark, d, "events"), ["user_id"], "event_type").select("user_id", F.round("entropy", 6).alias("entropy"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS duplicates, CAST(count(*) FILTER (l_orderkey = l_partkey) AS BIGINT) AS self_loops FROM lineitem")
def a15_duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("k"))
    loops = F.sum(F.when(F.col("l_orderkey") == F.col("l_partkey"), F.col("k")).otherwise(0))
    return pairs.agg(F.sum("k").alias("n"), (F.sum("k") - F.count("*")).alias("duplicates"), loops.alias("self_loops"))


@query("SELECT l_orderkey, bool_and(l_returnflag = 'N') AS all_n, bool_or(l_discount > 0.09) AS any_deep FROM lineitem GROUP BY 1")
def a16_any_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("all_n"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"))


@query("SELECT slice, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS mean_price FROM (SELECT o_totalprice, unnest(['general'] || CASE WHEN o_orderstatus = 'F' THEN ['finished'] ELSE [] END || CASE WHEN o_totalprice > 200000 THEN ['large'] ELSE [] END) AS slice FROM orders) GROUP BY 1")
def a17_overlapping_slices(spark: SparkSession, d: str) -> DataFrame:
    some = F.array(F.lit("general"), F.when(F.col("o_orderstatus") == "F", "finished"), F.when(F.col("o_totalprice") > 200000, "large"))
    sliced = table(spark, d, "orders").select("o_totalprice", F.explode(F.array_compact(some)).alias("slice"))
    return sliced.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS shipped_before_order, CAST(sum(CASE WHEN l_quantity <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_quantity, CAST(sum(CASE WHEN l_discount > 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def a19_violation_rollup(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("shipped_before_order"),
        F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if(F.col("l_discount") > 1).alias("bad_discount"),
    )


@query("WITH c AS (SELECT model, condition, count(*) AS n FROM episodes GROUP BY 1, 2) SELECT model, condition, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM c")
def a20_taxonomy_shares(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "episodes").groupBy("model", "condition").agg(F.count("*").alias("n"))
    return c.select("model", "condition", "n", F.round(R.share(c, "n", "model"), 6).alias("share"))


@query("WITH t AS (SELECT source, left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 120) AS k FROM documents) SELECT source, CAST(count(*) AS BIGINT) AS n, round((count(k) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> '')) / count(*), 6) AS rate FROM t GROUP BY 1")
def a21_duplicate_title_rate(spark: SparkSession, d: str) -> DataFrame:
    from heronry.functions.text import normalised_title

    t = table(spark, d, "documents").select("source", normalised_title("text").alias("k"))
    per = t.groupBy("source", "k").agg(F.count("*").alias("m"))
    named = F.coalesce(F.col("k") != "", F.lit(False))
    return per.groupBy("source").agg(F.sum("m").alias("n"), F.round((F.sum(F.when(named, F.col("m")).otherwise(0)) - F.count_if(named)) / F.sum("m"), 6).alias("rate"))


@query("SELECT source, CAST(count(DISTINCT left(paper_id, 2)) AS BIGINT) AS years, CAST(count(DISTINCT section) AS BIGINT) AS sections, round(avg(CASE WHEN section = 'results' THEN 1.0e0 ELSE 0.0e0 END), 6) AS same_rate FROM documents GROUP BY 1")
def a22_diversity(spark: SparkSession, d: str) -> DataFrame:
    same = F.coalesce((F.col("section") == "results").cast("double"), F.lit(0.0))
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct(F.left("paper_id", F.lit(2))).alias("years"), F.count_distinct("section").alias("sections"), F.round(F.avg(same), 6).alias("same_rate"))


@query("SELECT event_type, round(avg(value) / avg(1.0e0), 6) AS per_call, round(avg(value) / (avg(greatest(1, length(props) // 4)) / 1000), 6) AS per_kilo_token FROM events GROUP BY 1")
def a23_recall_cost(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.floor(F.length("props") / 4))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("per_call"), F.round(F.avg("value") / (F.avg(tokens) / 1000), 6).alias("per_kilo_token"))


@query("SELECT base_arxiv_id, max(CAST(version AS VARCHAR)) AS version FROM papers GROUP BY 1")
def a24_text_typed_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").groupBy("base_arxiv_id").agg(F.max(F.col("version").cast("string")).alias("version"))


# --- windows


@query("SELECT source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 5")
def w01_rank_in_list(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "documents"), ["source", "lang"], 5, "-n_chars", "doc_id").select("source", "doc_id", "rank")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def w02_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_first(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w03_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_last(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, CAST(n AS BIGINT) AS n, CAST(taken AS BIGINT) AS taken_before FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(n) OVER () AS total FROM n) WHERE taken < 0.2 * total")
def w05_prefix_sum_stop(spark: SparkSession, d: str) -> DataFrame:
    return R.prefix_clusters(table(spark, d, "customer"), "c_nationkey", 0.2, "-n", "c_nationkey")


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256(c_custkey || '|7'), c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'dev' ELSE 'test' END AS split FROM r")
def w06_rank_fraction_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", R.seeded_key(7, "c_custkey").alias("key"))
    return R.rank_split(c, [("train", 0.7), ("dev", 0.85)], "test", "key", "c_custkey").select("c_custkey", "split")


@query("SELECT doc_id, first_value(source) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS first_source FROM documents WHERE text IS NOT NULL")
def w07_first_of_group(spark: SparkSession, d: str) -> DataFrame:
    # The first row of a group of copies is found by aggregation, which combines before the shuffle, and joined back.
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.md5("text").alias("k"))
    first = docs.groupBy("k").agg(F.min_by("source", "doc_id").alias("first_source"))
    return docs.join(first, "k").select("doc_id", "first_source")


@query("SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, min(ts) AS first_ts FROM events GROUP BY 1")
def w08_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("ts").alias("first_ts"))


@query("WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, CAST(min(CASE WHEN event_type = 'purchase' THEN i END) AS INT) AS first_hit FROM r GROUP BY 1")
def w09_calls_to_first_hit(spark: SparkSession, d: str) -> DataFrame:
    r = R.ranked(table(spark, d, "events"), ["user_id"], "ts", "event_id", name="i")
    return r.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("i"))).alias("first_hit"))


@query()
def w10_budget_fold(spark: SparkSession, d: str) -> DataFrame:
    """Token budget over each episode's calls in order: an observation that no longer fits is skipped, not the end."""
    from heronry.operators import flatten

    calls = flatten.calls_table(table(spark, d, "episodes"), ["delivery_id"])
    cost = calls.groupBy("delivery_id").agg(F.array_sort(F.collect_list(F.struct("call_no", (F.col("n_ids") * 12).cast("bigint").alias("cost")))).alias("steps"))
    return cost.select("delivery_id", R.budget_fold(F.col("steps"), "cost", 200).alias("f")).select("delivery_id", "f.*")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, CAST(i AS INT) AS milestone, round(s, 6) AS so_far FROM (SELECT user_id, i, sum(value) OVER (PARTITION BY user_id ORDER BY i) AS s FROM r) WHERE i IN (1, 2, 4, 8)")
def w11_milestones(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "value", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # Only eight rows of a user are needed; the limit is pushed before the shuffle.
    e = e.withColumn("milestone", F.row_number().over(w)).filter("milestone <= 8")
    s = e.withColumn("so_far", F.sum("value").over(Window.partitionBy("user_id").orderBy("milestone")))
    return s.filter(F.col("milestone").isin(1, 2, 4, 8)).select("user_id", "milestone", F.round("so_far", 6).alias("so_far"))


@query("SELECT paper_id, CAST(dense_rank() OVER (ORDER BY paper_id) AS BIGINT) AS gid FROM (SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL)")
def w12_dense_group_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("paper_id").filter("paper_id is not null").distinct()
    return R.global_rank(ids, "paper_id").select("paper_id", (F.col("position") + 1).alias("gid"))


@query("SELECT event_type, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def w13_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.select("event_type", F.round(R.share(c, "n"), 6).alias("share"))


# --- sort, top-k, sampling


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) - 1 AS position FROM orders")
def t01_multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    return R.global_rank(table(spark, d, "orders"), "-o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice", "position")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def t02_top_k_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "orders"), ["o_custkey"], 3, "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS deep FROM orders) SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM r WHERE deep <= 10 AND o_orderstatus = 'F') WHERE rank <= 2")
def t04_scan_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return R.scan_then_keep(table(spark, d, "orders"), ["o_custkey"], 10, F.col("o_orderstatus") == "F", 2, "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey || '|42'), o_orderkey LIMIT 50")
def t06_seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return R.seeded_sample(table(spark, d, "orders").select("o_orderkey"), 50, 42, "o_orderkey")


@query("SELECT vec_id FROM embeddings ORDER BY sha256(vec_id || '|3'), vec_id LIMIT 20")
def t07_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.seeded_sample(table(spark, d, "embeddings").select("vec_id"), 20, 3, "vec_id")


@query("SELECT l_orderkey, min_by(l_partkey, sha256(l_orderkey || '|' || l_partkey || '|11')) AS l_partkey FROM lineitem GROUP BY 1")
def t08_pick_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.seeded_pick(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey", 11)


@query("SELECT l_orderkey, min_by(l_partkey, sha256(l_orderkey || '|' || l_partkey || '|13')) AS l_partkey FROM lineitem WHERE l_discount < 0.05 AND l_partkey <> l_orderkey GROUP BY 1")
def t09_rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    legal = table(spark, d, "lineitem").filter("l_discount < 0.05 and l_partkey <> l_orderkey").select("l_orderkey", "l_partkey")
    return R.seeded_pick(legal, ["l_orderkey"], "l_partkey", 13)


@query("SELECT doc_id, CAST(min(i) AS INT) AS first_at, w FROM (SELECT doc_id, w, i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i)) GROUP BY doc_id, w")
def t10_ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    ws = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", ws.alias("ws"))
    # array_distinct keeps the first of each; where it stood is looked up in the row itself.
    return docs.select("doc_id", "ws", F.explode(F.array_distinct("ws")).alias("w")).select("doc_id", F.array_position("ws", F.col("w")).cast("int").alias("first_at"), "w")


# --- set operations


@query("SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k")))


@query("WITH a AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS i FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_partkey, 100 + min(l_linenumber) AS i FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), u AS (SELECT l_orderkey, l_partkey, min(i) AS i FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) SELECT l_orderkey, CAST(pos AS INT) AS pos, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i, l_partkey) AS pos FROM u) WHERE pos <= 4")
def u02_padded_union(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    hit = F.col("l_returnflag") == "R"
    lists = li.groupBy("l_orderkey").agg(*[F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "l_partkey")))).alias(n) for n, c in (("a", hit), ("b", ~hit))])
    both = R.padded(F.col("a.l_partkey"), F.col("b.l_partkey"), 4)
    return lists.select("l_orderkey", F.posexplode(both).alias("p", "l_partkey")).select("l_orderkey", (F.col("p") + 1).alias("pos"), "l_partkey")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def u03_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def u04_except(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'N'").select("l_partkey").subtract(li.filter("l_returnflag = 'R'").select("l_partkey"))


@query("WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(['N','R'], f) AS subset FROM g")
def u05_subset(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return g.select("l_orderkey", F.forall("f", lambda x: x.isin("N", "R")).alias("subset"))


@query("WITH g AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'A') AS b FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'r_only' WHEN b THEN 'a_only' ELSE 'neither' END AS found_by FROM g")
def u06_found_by(spark: SparkSession, d: str) -> DataFrame:
    has = lambda x: F.bool_or(F.col("l_returnflag") == x)
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(has("R").alias("a"), has("A").alias("b"))
    return g.select("l_partkey", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "r_only").when(F.col("b"), "a_only").otherwise("neither").alias("found_by"))


@query("WITH f AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS only_a, CAST(count(*) FILTER (b AND NOT a) AS BIGINT) AS only_b, CAST(count(*) FILTER (a AND b) AS BIGINT) AS overlap FROM f GROUP BY 1")
def u07_channel_overlap(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("l_returnflag") == "R"
    f = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.bool_or(hit).alias("a"), F.bool_or(~hit).alias("b"))
    return f.groupBy("l_orderkey").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))
