"""BM25 of a query set against all documents as one matrix product per batch of documents.

Scores of a whole query set are dense: common words let nearly every document score for nearly every query. Joining
postings with query terms makes a row for each word, query and document; here a task multiplies the term weights of
its documents with the queries' terms, and keeps the k best of each query before anything is shuffled. Queries are
taken in blocks, so what a task holds is bounded by the terms of BLOCK queries and by BATCH documents, not by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.relational import top_k

K1, B = 1.5, 0.75
#: Queries per pass and documents per product.
BLOCK, BATCH = 500, 512
_TOKEN = re.compile("[a-z0-9]+")


def _counts(texts: list[str | None], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term frequencies (documents x terms) and lengths of a few texts."""
    tf, length = np.zeros((len(texts), len(number))), np.ones(len(texts))
    for n, t in enumerate(texts):
        ws = _TOKEN.findall((t or "").lower())
        length[n] = max(1, len(ws))
        at = [i for i in map(number.get, ws) if i is not None]
        np.add.at(tf[n], at, 1.0)
    return tf, length


def statistics(docs: DataFrame, number: dict[str, int]) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and in how many of them each query term stands; one pass, a row per term and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(number)), 0, 0.0
        for b in batches:
            texts = b.column(0).to_pylist()
            for a in range(0, len(texts), BATCH):
                tf, length = _counts(texts[a : a + BATCH], number)
                df += (tf > 0).sum(axis=0)
                n += len(length)
                total += length.sum()
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(number)), -1, -2], pa.int64()), pa.array([*df.tolist(), float(n), total], pa.float64())], ["term", "v"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "term bigint, v double").groupBy("term").agg(F.sum("v").alias("v")).collect()
    v = {r.term: r.v for r in rows}
    n = int(v.get(-1, 0))
    return n, v.get(-2, 0.0) / max(1, n), np.array([v.get(i, 0.0) for i in range(len(number))])


def search(queries: DataFrame, docs: DataFrame, k: int, visible: bool = False) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query (query, text) by (score, doc).

    Same scores as ``retrieval.bm25``; a document that shares no term with a query is not ranked. With ``visible`` a
    document counts only if its ``avail`` is not after the query's ``as_of`` (dates; null is never visible). ``doc`` is
    a bigint. Null and empty texts match nothing.
    """
    n_blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for part in range(n_blocks):
        cols = ["query", "text", *(["as_of"] if visible else [])]
        rows = queries.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == part).select(*cols).collect()
        terms = [sorted(set(_TOKEN.findall((r.text or "").lower()))) for r in rows]
        number = {w: i for i, w in enumerate(sorted({w for ws in terms for w in ws}))}
        if not number:
            continue
        places = [np.array([number[w] for w in ws], np.int64) for ws in terms]
        n, mean, df = statistics(docs, number)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        ids = np.array([r.query for r in rows])
        until = np.array([r.as_of for r in rows], "datetime64[D]") if visible else None

        def run(batches: Iterator[pa.RecordBatch], number=number, places=places, idf=idf, mean=mean, ids=ids, until=until) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            asked = np.zeros((len(number), len(places)))
            for j, at in enumerate(places):
                asked[at, j] = 1.0
            for b in batches:
                docs_in, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
                avail = b.column(2).to_numpy(zero_copy_only=False).astype("datetime64[D]") if until is not None else None
                out: list[list[np.ndarray]] = [[], [], []]
                for a in range(0, len(texts), BATCH):
                    tf, length = _counts(texts[a : a + BATCH], number)
                    w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)[:, None])
                    score = np.round(w @ asked, 9)
                    if avail is not None:
                        score[~(avail[a : a + BATCH, None] <= until[None, :])] = 0.0
                    d = docs_in[a : a + BATCH]
                    order = np.lexsort((d,))
                    score, d = score[order], d[order]
                    best = np.argsort(-score, axis=0, kind="stable")[:k]
                    s = np.take_along_axis(score, best, axis=0)
                    r, c = np.nonzero(s > 0)
                    for o, x in zip(out, (ids[c], d[best[r, c]], s[r, c]), strict=True):
                        o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).astype(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2]).astype(np.float64))], ["query", "doc", "score"])

        one = docs.select("doc", F.col("text").cast("string"), *(["avail"] if visible else [])).mapInArrow(run, "query bigint, doc bigint, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "query bigint, doc bigint, score double, rank int")
    return top_k(found.withColumn("_s", -F.col("score")), ["query"], k, "_s", "doc").drop("_s")
