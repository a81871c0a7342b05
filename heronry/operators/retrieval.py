"""Full-text retrieval and fusion on long frames (query, document, score or rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import tokens
from heronry.operators.relational import top_k
from heronry.session import materialise

K1, B, RRF_K = 1.5, 0.75, 60
#: Documents of a part, about, and queries whose terms a task has at a time.
DOCS, BLOCK = 2000, 500


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, length, term, tf) of documents (doc, text); with ``terms`` (term) only those are kept.

    An empty or null text has length 1 and no postings.
    """
    t = docs.select("doc", tokens("text").alias("t")).select("doc", F.greatest(F.size("t"), F.lit(1)).alias("length"), F.explode("t").alias("term"))
    if terms is not None:
        t = t.join(terms, "term", "left_semi")
    return t.groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))


def weights(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, w): what a term adds to a document's BM25 score; the index to keep for many query sets."""
    post = postings(docs, terms)
    size = docs.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size(tokens("text")), F.lit(1))).alias("avg_length"))  # one row
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return post.join(df, "term").crossJoin(F.broadcast(size)).select("term", "doc", (idf * tf).alias("w"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term): each term of a query once."""
    return queries.select("query", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def scored_pairs(queries: DataFrame, docs: DataFrame, of_doc: tuple[str, ...] = (), of_query: tuple[str, ...] = ()) -> DataFrame:
    """(part, doc, query, score) of all documents that share a term with a query, with columns of either; ``doc`` is unique.

    Texts are laid out in parts of about DOCS documents. Postings, the join with the queries' terms and the sums of scores
    stay in the task that has the part, so postings and pairs are neither shuffled nor written. The terms of BLOCK queries
    at a time go to every task; a task holds the sums of BLOCK queries and the documents of its part.
    """
    of_doc, of_query = list(of_doc), list(of_query)
    n_docs, n_blocks = docs.count(), max(1, -(-queries.count() // BLOCK))
    n_parts = max(1, -(-n_docs // DOCS))
    size = docs.agg(F.avg(F.greatest(F.size(tokens("text")), F.lit(1))).alias("avg_length"))  # one row
    df = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query", *of_query, F.explode(F.array_distinct(tokens("text"))).alias("term"))
    idf = F.ln(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = materialise(asked.join(df, "term").crossJoin(F.broadcast(size)).select("query", *of_query, "term", idf.alias("idf"), "avg_length"))
    laid = docs.select(F.pmod(F.xxhash64("doc"), F.lit(n_parts)).alias("part"), "doc", "text", *of_doc).repartition(n_parts, "part")
    words = laid.select("part", "doc", *of_doc, tokens("text").alias("t"))
    words = words.select("part", "doc", *of_doc, F.greatest(F.size("t"), F.lit(1)).alias("length"), F.explode("t").alias("term"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    out = None
    for b in range(n_blocks):
        some = asked.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b)
        met = words.join(F.broadcast(some.select("term").distinct()), "term", "left_semi")
        post = met.groupBy("part", "doc", *of_doc, "length", "term").agg(F.count("*").alias("tf")).join(F.broadcast(some), "term")
        sums = post.groupBy("part", "doc", *of_doc, "query", *of_query).agg(F.sum(F.col("idf") * tf).alias("score"))
        out = sums if out is None else out.unionByName(sums)
    return out


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, score) of all documents that share a term with the query; ties are left to the ranking."""
    return scored_pairs(queries, docs).select("query", "doc", "score")


def rank_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (score, doc), scores compared to nine digits."""
    return top_k(scores.withColumn("_s", -F.round("score", 9)), ["query"], k, "_s", "doc").drop("_s")


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int) -> DataFrame:
    """Fuses rankings (query, doc, rank): the sum of 1/(60 + rank)."""
    every = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    return rank_scores(every.groupBy("query", "doc").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")), k)


def normalised_fusion(ranking: DataFrame, scored: DataFrame, k: int, share: float = 0.5) -> DataFrame:
    """Fuses a ranking (its place, from 1 down) with scores (min-max per query) by a weighted sum."""
    n = F.count("*").over(Window.partitionBy("query"))
    a = ranking.select("query", "doc", ((1 - (F.col("rank") - 1) / n) * (1 - share)).alias("v"))
    w = Window.partitionBy("query")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    b = scored.select("query", "doc", (F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0) * share).alias("v"))
    return rank_scores(a.unionByName(b).groupBy("query", "doc").agg(F.sum("v").alias("score")), k)


def fusible(ranking: DataFrame, scored: DataFrame, k: int, share: float = 0.5) -> DataFrame:
    """The rows of ``scored`` (query, doc, score, rank) that a normalised fusion's k best depend on, and its k best by rank.

    A document that is not in ``ranking``, of which a query has n, is among the k best only if it is among the k + n best
    scores as the fusion rounds them; all that reach that value stay, those that are in ``ranking``, and a document with
    either extreme, by which scores are scaled.
    """
    listed = ranking.groupBy("query").agg(F.collect_set("doc").alias("_listed"))  # as many as a ranking has places
    w = Window.partitionBy("query")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    v = F.round(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0) * share, 9)
    ends = F.array(F.min_by("doc", "score").over(w), F.max_by("doc", "score").over(w))
    met = scored.join(listed, "query", "left").withColumn("_v", v).withColumn("_ends", ends)
    met = met.withColumn("_least", F.min(F.when(F.col("rank") <= k + F.coalesce(F.size("_listed"), F.lit(0)), F.col("_v"))).over(w))
    keep = (F.col("rank") <= k) | (F.col("_v") >= F.col("_least")) | F.array_contains("_ends", F.col("doc")) | F.coalesce(F.array_contains("_listed", F.col("doc")), F.lit(False))
    return met.filter(keep).select(*scored.columns)


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two rankings agree: largest score difference, share of equal places, overlap."""
    j = a.alias("a").join(b.alias("b"), (F.col("a.query") == F.col("b.query")) & (F.col("a.doc") == F.col("b.doc")), "full")
    both = F.col("a.doc").isNotNull() & F.col("b.doc").isNotNull()
    return j.agg(
        F.max(F.when(both, F.abs(F.col("a.score") - F.col("b.score")))).alias("max_diff"),
        F.avg((both & (F.col("a.rank") == F.col("b.rank"))).cast("double")).alias("same_place"),
        F.avg(both.cast("double")).alias("overlap"),
    )
