"""Queries of scans and sinks: what is written is read again and compared with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.text import base_id
from heronry.operators import relational as R
from heronry.plans.registry import query
from heronry.session import scratch, table
from heronry.sources import files, model


@query("SELECT coalesce(base_arxiv_id, arxiv_id) AS pid, max(title) AS title, max(abstract) AS abstract, min(submit_date) AS submit_date FROM papers GROUP BY 1")
def s01_grouped_scan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").groupBy(F.coalesce("base_arxiv_id", "arxiv_id").alias("pid"))
    return p.agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"), F.min("submit_date").alias("submit_date"))


@query("SELECT coalesce(base_arxiv_id, arxiv_id) AS pid, title, abstract, min(submit_date) AS submit_date FROM papers GROUP BY 1, 2, 3")
def s02_three_key_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").groupBy(F.coalesce("base_arxiv_id", "arxiv_id").alias("pid"), "title", "abstract").agg(F.min("submit_date").alias("submit_date"))


@query(r"""SELECT row_id, nullif(regexp_extract(metadata, '[''"]categories[''"]\s*:\s*\[\s*[''"]([^''"]+)', 1), '') AS category FROM papers""")
def s03_metadata_categories(spark: SparkSession, d: str) -> DataFrame:
    # The parser takes JSON and literals in single quotes alike.
    meta = F.from_json("metadata", "categories array<string>", {"allowSingleQuotes": "true"})
    return table(spark, d, "papers").select("row_id", F.get(meta["categories"], 0).alias("category"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def s04_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(ids, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, left(p_name, 12) AS head FROM part WHERE p_name LIKE 'red%' ORDER BY p_partkey LIMIT 10")
def s05_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_name").startswith("red")).orderBy("p_partkey").limit(10).select("p_partkey", F.left("p_name", F.lit(12)).alias("head"))


@query("SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL AND text <> ''")
def s06_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "documents").filter("text is not null and text <> ''"), path, ["doc_id", "text", "source"])
    return files.read_csv(spark, path, "doc_id bigint, text string, source string")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s07_jsonl(spark: SparkSession, d: str) -> DataFrame:
    ev, path = table(spark, d, "events"), scratch(spark, "jsonl")
    files.write_jsonl(ev, path)
    return files.read_jsonl(spark, path, ev.schema)


@query("SELECT condition, CAST(count(*) FILTER (json_valid(coalesce(body, ''))) AS BIGINT) AS good, CAST(count(*) FILTER (NOT json_valid(coalesce(body, '')) AND coalesce(body, '') <> '') AS BIGINT) AS bad FROM episodes GROUP BY 1")
def s08_tolerant_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tolerant")
    table(spark, d, "episodes").filter("body is not null").select("condition", "body").write.partitionBy("condition").text(path)
    read = files.read_jsonl_tolerant(spark, path, "seed bigint").select("condition", (F.col("seed").isNotNull() | F.col("_corrupt_record").isNull()).alias("ok"))
    return read.groupBy("condition").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s09_globbed_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "glob")
    table(spark, d, "events").select("event_id", "event_type").write.partitionBy("event_type").json(path)
    read = files.read_jsonl(spark, f"{path}/*/*.json", "event_id bigint").withColumn("file", F.input_file_name())
    return read.groupBy(F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), 'none') AS k, 'none' AS missing FROM events")
def s10_path_dig(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", files.dig("props", "k", "none").alias("k"), files.dig("props", "a.b", "none").alias("missing"))


@query("SELECT instance_id, CAST(count(*) AS BIGINT) AS n FROM episodes WHERE instance_id NOT IN (SELECT instance_id FROM frozen_ids WHERE list_name = 'scaling_slice') GROUP BY 1")
def s11_id_list(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ids")
    table(spark, d, "frozen_ids").filter("list_name = 'scaling_slice' and instance_id is not null").select("instance_id").write.text(path)
    ids = files.read_ids(spark, path).withColumnRenamed("id", "instance_id")
    return table(spark, d, "episodes").join(ids, "instance_id", "left_anti").groupBy("instance_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def s14_append_sink(spark: SparkSession, d: str) -> DataFrame:
    o, path = table(spark, d, "orders").select("o_orderkey", "o_custkey"), scratch(spark, "append")
    files.append_missing(o.filter("o_custkey % 3 = 0"), path, ["o_orderkey"])
    files.append_missing(o, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("SELECT doc_id, sha256(text) AS h, left(sha256(text), 16) AS short FROM documents WHERE text IS NOT NULL")
def s18_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.left(F.sha2("text", 256), F.lit(16)).alias("short"))


@query("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1")
def s19_id_list_hash(spark: SparkSession, d: str) -> DataFrame:
    ids = F.sort_array(F.collect_list("o_orderkey")).cast("array<string>")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sha2(F.concat_ws("\n", ids), 256).alias("h"))


@query("WITH k AS (SELECT DISTINCT batch_no = (SELECT max(batch_no) FROM episodes) AS now, condition, concat_ws('|', model, condition, instance_id) AS prompt FROM episodes), o AS (SELECT DISTINCT prompt FROM k WHERE NOT now) SELECT condition, CAST(count(*) FILTER (prompt IN (SELECT prompt FROM o)) AS BIGINT) AS hits, CAST(count(*) FILTER (prompt NOT IN (SELECT prompt FROM o)) AS BIGINT) AS misses, CAST(count(*) AS BIGINT) AS answered FROM k WHERE now GROUP BY 1")
def s21_response_cache(spark: SparkSession, d: str) -> DataFrame:
    # Requests of the last batch against a store with the answers of all earlier ones; the misses are asked and appended.
    e = table(spark, d, "episodes").select("batch_no", "condition", F.concat_ws("|", "model", "condition", "instance_id").alias("prompt"))
    marked = e.crossJoin(F.broadcast(e.agg(F.max("batch_no").alias("last"))))  # one row
    now, before = (marked.filter(c).select("condition", "prompt").distinct() for c in ("batch_no = last", "batch_no < last"))
    store = scratch(spark, "responses")
    key = model.request_key("offline", "v1")
    before.select("prompt").distinct().select(key.alias("key"), F.lit("{}").alias("response")).write.parquet(store)
    model.append_missing(now, store, "offline", "v1")
    stored = spark.read.parquet(store)
    answered = now.withColumn("key", key).join(stored, "key")
    return answered.groupBy("condition").agg(F.count_if(F.col("response") == "{}").alias("hits"), F.count_if(F.col("response") != "{}").alias("misses"), F.count("*").alias("answered"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS j FROM orders) WHERE j % 4 = 1")
def s22_shard_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.shard(table(spark, d, "orders").select("o_orderkey"), 4, 1, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s23_resume_filter(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT obj_id, max_by(rec_id, rec_id) AS rec_id, CAST(count(*) AS BIGINT) AS added FROM temporal_objects GROUP BY 1")
def s26_temporal_registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_objects").groupBy("obj_id").agg(F.max("rec_id").alias("rec_id"), F.count("*").alias("added"))


@query("SELECT split_part(obj_id, ':', 1) AS variant, CAST(count(*) AS BIGINT) AS nodes, CAST(count(DISTINCT regexp_replace(obj_id, 'v[0-9]+$', '')) AS BIGINT) AS ids FROM temporal_objects GROUP BY 1")
def s25_variant_load(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "variants")
    table(spark, d, "temporal_objects").select(F.substring_index("obj_id", ":", 1).alias("variant"), "obj_id").write.partitionBy("variant").json(path)
    per = files.read_jsonl(spark, path, "obj_id string").select("variant", base_id("obj_id").alias("b")).groupBy("variant", "b").agg(F.count("*").alias("k"))
    return per.groupBy("variant").agg(F.sum("k").alias("nodes"), F.count("*").alias("ids"))


@query("SELECT file_name, CAST(count(*) AS BIGINT) AS n, md5(string_agg(md5(body), '' ORDER BY r.rec_id)) AS h FROM raw_records r JOIN result_files f USING (file_id) GROUP BY 1")
def s17_manifest(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").join(table(spark, d, "result_files").select("file_id", "file_name"), "file_id")
    lines = F.array_sort(F.collect_list(F.struct("rec_id", F.md5("body").alias("h"))))
    return r.groupBy("file_name").agg(F.count("*").alias("n"), F.md5(F.array_join(lines["h"], "")).alias("h"))
