"""Queries of the scalar functions, over whole text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.plans import audit as A
from heronry.plans.registry import query
from heronry.session import table


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS INT) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) AS tokens_md5 FROM documents")
def f01_tokenise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("SELECT row_id, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS base FROM papers")
def f02_version_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("row_id", T.base_id("arxiv_id").alias("base"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}', ' [CITATION] ', 'g')) AS h, CAST(len(regexp_extract_all(text, '\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}')) AS INT) AS n FROM documents WHERE text IS NOT NULL")
def f03_neutralise_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(T.neutralise_citations("text")).alias("h"), T.citation_count("text").alias("n"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(item_text, '\[CITATION\]', ' ', 'g'), '\[\d+(?:\s*[,–-]\s*\d+)*\]', ' ', 'g'), '\s+', ' ', 'g')) AS query, CAST(len(regexp_extract_all(item_text, '\[CITATION\]')) + len(regexp_extract_all(item_text, '\[\d+(?:\s*[,–-]\s*\d+)*\]')) AS INT) AS removed FROM eval_items")
def f04_scrub_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", T.scrub("item_text").alias("query"), T.scrubbed_count("item_text").alias("removed"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '\\[A-Za-z]+\*?', ' ', 'g'), '[A-Za-z]{2,}')) AS INT) AS n FROM documents WHERE text IS NOT NULL")
def f05_context_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.context_tokens("text").alias("n"))


@query("SELECT row_id, replace(abstract, split_part(title, ':', 1), '[TITLE]') AS delexed, array_to_string(regexp_extract_all(title, '\\b([A-Z])[A-Za-z]*', 1), '') AS acronym FROM papers WHERE title IS NOT NULL AND abstract IS NOT NULL AND title <> upper(title)")
def f06_delexicalise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").filter("title is not null and abstract is not null and title <> upper(title)")
    return p.select("row_id", F.replace("abstract", F.split_part("title", F.lit(":"), F.lit(1)), F.lit("[TITLE]")).alias("delexed"), T.acronym("title").alias("acronym"))


_CITED = "'As \\cite{other} has it, \\citep[see][p.~3]{a.b,' || arxiv_id || '} extends ' || arxiv_id || ' and \\citet*{' || arxiv_id || 'x}.'"


@query(f"SELECT row_id, 'As [CITATION] has it, [MASKED_CITATION] extends ' || arxiv_id || ' and [CITATION].' AS masked FROM papers WHERE arxiv_id IS NOT NULL")
def f06_mask_target(spark: SparkSession, d: str) -> DataFrame:
    # The command that holds the target key is masked; others, a longer key among them, become plain citations.
    p = table(spark, d, "papers").filter("arxiv_id is not null")
    return p.select("row_id", T.mask_target(F.expr(_CITED.replace("\\", "\\\\")), "arxiv_id").alias("masked"))


@query("SELECT row_id, 'See [TITLE] and [TITLE]; ' || right(coalesce(abstract, ''), 40) AS delexed FROM papers WHERE length(title) > 12 AND position(lower(title) IN lower(right(coalesce(abstract, ''), 40))) = 0 AND regexp_full_match(title, '[ -~]*')")
def f06_delexicalised_title(spark: SparkSession, d: str) -> DataFrame:
    # Mentions of the title go whatever their case.
    tail = F.right(F.coalesce("abstract", F.lit("")), F.lit(40))
    p = table(spark, d, "papers").filter((F.length("title") > 12) & ~F.contains(F.lower(tail), F.lower("title")) & F.col("title").rlike("^[ -~]*$"))
    return p.select("row_id", T.delexicalise(F.concat(F.lit("See "), "title", F.lit(" and "), F.upper("title"), F.lit("; "), tail), "title").alias("delexed"))


@query("SELECT row_id, left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 120) AS t FROM papers")
def f07_normalised_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("row_id", T.normalised_title("title").alias("t"))


@query("SELECT doc_id, left(sha256(left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 400)), 16) AS k FROM documents WHERE text IS NOT NULL")
def f08_near_duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.near_duplicate_key("text").alias("k"))


@query("SELECT row_id, length(split_part(title, ':', 1)) > 12 AND contains(lower(abstract), lower(split_part(title, ':', 1))) AS inside FROM papers WHERE title IS NOT NULL AND abstract IS NOT NULL")
def f09_title_in_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").filter("title is not null and abstract is not null")
    return p.select("row_id", T.title_in_text(F.split_part("title", F.lit(":"), F.lit(1)), "abstract").alias("inside"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS n FROM documents WHERE text IS NOT NULL")
def f10_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_estimate("text").alias("n"))


@query("SELECT rec_id, starts_with(obj_id, 'paper:') AS is_paper, split_part(obj_id, ':', 1) AS kind, left(obj_id, 9) AS head FROM temporal_objects")
def f11_prefix_split(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("obj_id")
    return table(spark, d, "temporal_objects").select("rec_id", o.startswith("paper:").alias("is_paper"), F.substring_index(o, ":", 1).alias("kind"), F.left(o, F.lit(9)).alias("head"))


@query("SELECT item_id, 'a ' || ' b' AS stripped, regexp_replace('<think>' || item_text || '</think>answer ' || item_id, '(?s)<think>.*?(</think>|$)', '', 'g') AS rest FROM eval_items")
def f12_strip_think(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit("<think>"), "item_text", F.lit("</think>answer "), "item_id")
    return table(spark, d, "eval_items").select("item_id", T.strip_think(F.lit("a <think>x</think> b")).alias("stripped"), T.strip_think(whole).alias("rest"))


@query("SELECT event_id, regexp_extract('note ' || props || ' end', '(?s)\\{.*\\}', 0) AS obj, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f13_first_object(spark: SparkSession, d: str) -> DataFrame:
    found = T.first_object(F.concat(F.lit("note "), "props", F.lit(" end")))
    return table(spark, d, "events").select("event_id", found.alias("obj")).select("event_id", "obj", F.get_json_object("obj", "$.k").cast("bigint").alias("k"))


@query(r"WITH v AS (SELECT rec_id, trim(available_at) AS v FROM temporal_objects), m AS (SELECT rec_id, regexp_extract(v, '^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}))?.*)?$', 1) AS a, regexp_extract(v, '^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}))?.*)?$', 2) AS b, regexp_extract(v, '^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}))?.*)?$', 3) AS c FROM v) SELECT rec_id, CASE WHEN a <> '' THEN a || ' ' || CASE WHEN b = '' THEN '00:00' ELSE b END || ':' || CASE WHEN c = '' THEN '00' ELSE c END END AS ts FROM m")
def f14_canonical_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_objects").select("rec_id", T.canonical_timestamp("available_at").alias("ts"))


@query("SELECT rec_id, TRY_CAST(strftime(TRY_CAST(left(as_of, 10) AS DATE), '%Y%m%d') AS INT) AS n FROM frozen_ids WHERE regexp_matches(as_of, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def f15_date_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frozen_ids").filter(F.col("as_of").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).select("rec_id", T.date_number("as_of").alias("n"))


@query("SELECT row_id, CAST(year(submit_date) AS INT) AS y, left(CAST(submit_date AS VARCHAR), 4) AS y_text FROM papers WHERE submit_date IS NOT NULL")
def f16_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").filter("submit_date is not null").select("row_id", F.year("submit_date").alias("y"), F.left(F.col("submit_date").cast("string"), F.lit(4)).alias("y_text"))


@query("SELECT rec_id, coalesce(regexp_matches(as_of, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$'), false) AS iso FROM frozen_ids")
def f17_iso_check(spark: SparkSession, d: str) -> DataFrame:
    iso = F.col("as_of").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$")
    return table(spark, d, "frozen_ids").select("rec_id", F.coalesce(iso, F.lit(False)).alias("iso"))


@query("SELECT event_id, round(least(greatest(value / 50, 0), 1), 6) AS c, 0.0e0 AS bad FROM events")
def f18_clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(T.clamp(F.col("value") / 50), 6).alias("c"), T.clamp(F.lit("none")).alias("bad"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_quantity + 1), 6) AS nat, round(log2(l_quantity + 1), 6) AS two FROM lineitem")
def f19_logs(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity") + 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.ln(q), 6).alias("nat"), F.round(F.log2(q), 6).alias("two"))


@query("SELECT event_id, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS v FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def f20_min_max(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return table(spark, d, "events").select("event_id", F.round(F.when(hi == lo, 0.0).otherwise((F.col("value") - lo) / (hi - lo)), 6).alias("v"))


@query("SELECT o_orderkey, round(o_totalprice / 3, 3) AS r3, round(o_totalprice / 7, 4) AS r4, round(o_totalprice / 11, 6) AS r6 FROM orders")
def f21_round(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(p / 3, 3).alias("r3"), F.round(p / 7, 4).alias("r4"), F.round(p / 11, 6).alias("r6"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, list_contains(embedding, embedding[3]) AS has, CAST(list_position(embedding, embedding[3]) AS INT) AS at, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS some_large, len(list_filter(embedding, lambda x: x > 10)) = 0 AS all_small FROM embeddings")
def f22_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.array_contains(e, e[2]).alias("has"), F.array_position(e, e[2]).cast("int").alias("at"),
        F.exists(e, lambda x: x > 0.3).alias("some_large"), F.forall(e, lambda x: x <= 10).alias("all_small"),
    )


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(coalesce(max(CASE WHEN event_type = 'click' THEN n END), 0) AS BIGINT) AS clicks, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def f23_map_counter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("n"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), "n")


@query("""SELECT o_orderkey, '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}' AS js FROM orders""")
def f24_json_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("js"))


@query("SELECT l_orderkey, left(sha256(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey)), 16) AS h FROM lineitem GROUP BY 1")
def f25_pool_hash(spark: SparkSession, d: str) -> DataFrame:
    ids = F.sort_array(F.collect_list("l_partkey")).cast("array<string>")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(T.list_hash(ids).alias("h"))


@query(f"WITH {A.FULL} SELECT {A._ERR} AS class, CAST(count(*) AS BIGINT) AS n FROM calls GROUP BY 1")
def f26_error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of tool-call errors and their counts."""
    from heronry.operators import flatten

    err = F.explode(F.transform(flatten._calls(F.col("body")), lambda c: F.coalesce(c["error"], F.lit("")))).alias("error")
    return table(spark, d, "episodes").filter(flatten._complete(F.col("body"))).select(err).groupBy(T.error_class("error").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, TRY_CAST(regexp_replace('p' || p_size, '^p+', '') AS INT) AS n, TRY_CAST(regexp_replace(p_name, '^p+', '') AS INT) AS bad FROM part")
def f27_paragraph_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.paragraph_number(F.concat(F.lit("p"), F.col("p_size").cast("string"))).alias("n"), T.paragraph_number("p_name").alias("bad"))


@query("SELECT o_orderkey, printf('%.3f', o_totalprice) AS a, printf('%+.5f', o_totalprice / 1000) AS b FROM orders")
def f28_number_format(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%.3f", p).alias("a"), F.format_string("%+.5f", p / 1000).alias("b"))
