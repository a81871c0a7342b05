"""Queries do the whole job: results against brute force or SQL without the cuts they once had."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from heronry import session
from heronry.operators import graph as G
from heronry.operators import relational as R
from heronry.operators import retrieval as S
from heronry.plans import graph as PG
from heronry.queries import QUERIES


def agrees(spark, folder, name, sql):
    assert oracle.difference(spark, folder, QUERIES[name], sql) == ""


def paths_by_search(edges, a, b, most, k):
    nbrs = {}
    for x, y in edges:
        nbrs.setdefault(x, set()).add(y)
        nbrs.setdefault(y, set()).add(x)
    found, stack = [], [(a,)]
    while stack:
        p = stack.pop()
        for n in nbrs.get(p[-1], set()) - set(p):
            if n == b:
                found.append((len(p), ">".join((*p, n))))
            elif len(p) < most:
                stack.append((*p, n))
    return sorted(found)[:k]


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_paths_beyond_any_number_of_neighbours(spark, most):
    rng = random.Random(most)
    edges = [("p:1", f"o:{i:02}") for i in range(40)] + [("p:2", "o:39"), ("p:3", "o:39"), ("p:3", "p:2")] + [(f"p:{rng.randint(4, 9)}", f"o:{rng.randint(0, 39):02}") for _ in range(60)]
    asked = [("p:1", "p:2"), ("p:1", "p:3"), ("p:4", "p:5"), ("p:2", "p:9"), ("p:1", "p:none")]
    got = G.simple_paths(spark.createDataFrame([(x, y, "r") for x, y in edges], "src string, dst string, rel string"), spark.createDataFrame(asked, "a string, b string"), most, 5)
    want = [(a, b, h, p, i + 1) for a, b in asked for i, (h, p) in enumerate(paths_by_search(edges, a, b, most, 5))]
    assert sorted((r.a, r.b, r.hops, r.path, r["rank"]) for r in got.collect()) == sorted(want)


def test_g21_paths(spark, small):
    con = oracle.connect(small)
    edges = con.sql("SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem").fetchall()
    asked = con.sql("SELECT 'p:' || a.p_partkey, 'p:' || b.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 50 WHERE a.p_partkey % 50 = 0").fetchall()
    want = [(a, b, h, p) for a, b in asked for h, p in paths_by_search(edges, a, b, 4, 5)]
    assert want and sorted((r.a, r.b, r.hops, r.path) for r in QUERIES["g21_paths"](spark, small).collect()) == sorted(want)


def test_paths_keep_only_edges_where_walks_come(spark, monkeypatch):
    """What is written is bound by the walks of the asked pairs, not by the graph."""
    edges = [("p:1", "o:1"), ("p:2", "o:1"), ("p:2", "o:2"), ("p:3", "o:2")] + [(f"x:{i}", f"y:{i % 50}") for i in range(2000)]
    written, real = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: written.append(real(df)) or written[-1])
    got = G.simple_paths(spark.createDataFrame([(x, y, "r") for x, y in edges], "src string, dst string, rel string"), spark.createDataFrame([("p:1", "p:3")], "a string, b string"), 4, 5)
    assert [tuple(r) for r in got.collect()] == [("p:1", "p:3", "p:1>o:1>p:2>o:2>p:3", 4, 1)]
    assert max(df.count() for df in written) < 10


def test_j12_nearest_by_gap(spark, small):
    sql = "WITH p AS (SELECT a.s_suppkey AS anchor, c.s_suppkey AS near, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(round(c.s_acctbal - a.s_acctbal, 6)), c.s_suppkey) AS rank FROM supplier a JOIN supplier c ON c.s_suppkey <> a.s_suppkey) SELECT anchor, near, CAST(rank AS INT) AS rank FROM p WHERE rank <= 3"
    agrees(spark, small, "j12_nearest_by_gap", sql)


def test_nearest_among_ties_and_outliers(spark):
    rng = random.Random(7)
    values = [float(rng.randint(0, 12)) for _ in range(60)] + [1e6, 1e6 + 0.25, -5e5, None]
    ids = rng.sample(range(1000), len(values))
    known = [(i, v) for i, v in zip(ids, values, strict=True) if v is not None]
    want = [(i, n, r + 1) for i, v in known for r, (_, n) in enumerate(sorted((abs(w - v), j) for j, w in known if j != i)[:3])]
    got = R.nearest(spark.createDataFrame(list(zip(ids, values, strict=True)), "id int, v double"), "id", "v", 3)
    assert sorted((r.anchor, r.near, r["rank"]) for r in got.collect()) == sorted(want)


def test_j13_positional_zip(spark, small):
    sql = "WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id, CAST(i AS INT) AS pos, a[i] AS a, a[len(a) + 1 - i] AS b FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM w)"
    agrees(spark, small, "j13_positional_zip", sql)


def test_j15_group_exclusion(spark, small):
    sql = "WITH o AS (SELECT section, source, lang, paper_id, count(*) AS same FROM documents GROUP BY ALL), n AS (SELECT section, source, lang, sum(same) AS n FROM o GROUP BY ALL) SELECT doc_id, CAST(n - same AS BIGINT) AS others FROM documents d JOIN n USING (section, source, lang) JOIN o ON o.section = d.section AND o.source = d.source AND o.lang = d.lang AND o.paper_id IS NOT DISTINCT FROM d.paper_id WHERE n > same"
    agrees(spark, small, "j15_group_exclusion", sql)
    pairs = "SELECT a.doc_id, CAST(count(*) AS BIGINT) AS others FROM documents a JOIN documents b ON a.section = b.section AND a.source = b.source AND a.lang = b.lang AND b.paper_id IS DISTINCT FROM a.paper_id GROUP BY 1"
    agrees(spark, small, "j15_group_exclusion", pairs)


def test_e21_transcript(spark, small, tmp_path):
    sql = "SELECT paper_id AS inst, CAST(count(*) AS BIGINT) AS steps, md5(string_agg(l, chr(10) ORDER BY doc_id, l)) AS transcript FROM (SELECT *, md5(doc_id || ':' || coalesce(text, '')) AS l FROM documents) WHERE paper_id IS NOT NULL GROUP BY 1"
    agrees(spark, small, "e21_transcript", sql)
    start = "x" * 7000
    rows = [("a", 1, start + "one"), ("b", 1, start + "two"), ("c", 1, start + "one")]
    spark.createDataFrame(rows, "paper_id string, doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = {r.inst: r.transcript for r in QUERIES["e21_transcript"](spark, str(tmp_path)).collect()}
    assert t["a"] == t["c"] != t["b"]


def test_t01_multi_key_sort(spark, small):
    sql = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) - 1 AS position FROM orders"
    agrees(spark, small, "t01_multi_key_sort", sql)


def test_r13_graph_variants(spark, small):
    arms = {}
    for r in QUERIES["r13_graph_variants"](spark, small).collect():
        arms.setdefault((r.variant, r.rule), {}).setdefault(r.anchor, {})[r["rank"]] = r.doc
    graphs, doses = ["all", "untyped", "type_shuffled", "rewired"], [f"dose_{n}" for n in (0, 25, 50, 75, 100)]
    want = {(g, r) for g in graphs for r in ("graph", "rrf", "norm")} | {(v, r) for v in [*doses, "has_part", "supplied_by", "placed_by"] for r in ("graph", "rrf")} | {("none", "bm25")}
    assert set(arms) == want - {("placed_by", "graph")}  # no part has such an edge
    anchors = set(arms["none", "bm25"])
    assert all(set(v) == anchors and all(sorted(x) == [1, 2, 3, 4, 5] for x in v.values()) for k, v in arms.items() if k[0] in graphs)
    assert arms["all", "graph"] == arms["dose_0", "graph"] == arms["untyped", "graph"] != arms["rewired", "graph"]
    assert arms["placed_by", "rrf"] == arms["none", "bm25"]
    old = oracle.connect(small).sql(f"WITH {PG.AA} SELECT 'all' AS variant, anchor, doc, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, doc) AS rank FROM aa) WHERE rank <= 5").fetchall()
    assert {(a, k): x for v, a, x, k in old} == {(a, k): x for a, xs in arms["all", "graph"].items() for k, x in xs.items()}


def test_r13_shuffled_types_expand_alike(spark, small):
    """The arms of a graph with relations dealt anew are those of expanding it, though it is expanded once with the others."""
    e, a = PG.edges(spark, small), PG._anchors(spark, small)
    key = lambda df: sorted((r.anchor, r["rank"], r.doc) for r in df.collect())
    assert key(G.adamic_adar(G.shuffle_types(e, 5), a, "p:", 5)) == key(G.adamic_adar(e, a, "p:", 5)) == key(G.adamic_adar(G.untyped(e), a, "p:", 5))


def test_numbers_are_named_again(spark, small):
    key = lambda df: sorted(map(tuple, df.select("src", "dst", "rel").collect()))
    assert key(PG.named(PG.numbered(spark, small))) == key(PG.edges(spark, small))


def test_fusion_needs_few_of_all_scores(spark):
    rng = random.Random(13)
    scores = [(q, f"d{i:03}", rng.choice([0.0, 0.5, round(rng.random(), 2), rng.random()])) for q in range(4) for i in range(300 if q else 1)]
    scored = R.top_k(spark.createDataFrame(scores, "query int, doc string, score double").withColumn("_s", -F.round("score", 9)), ["query"], 1 << 30, "_s", "doc").drop("_s")
    ranking = spark.createDataFrame([(q, f"d{i:03}", r + 1) for q in (0, 1, 2, 9) for r, i in enumerate(rng.sample(range(330), 8))], "query int, doc string, rank int")
    key = lambda df: sorted((r.query, r["rank"], r.doc, r.score) for r in df.collect())
    some = S.fusible(ranking, scored, 10)
    assert key(S.normalised_fusion(ranking, some, 10)) == key(S.normalised_fusion(ranking, scored, 10))
    assert key(some.filter("rank <= 10")) == key(scored.filter("rank <= 10")) and some.count() < 200 < scored.count()


@pytest.mark.parametrize("name", ["r03_bm25_joined", "r04_bm25_equivalence", "r08_bm25_per_base_id"])
def test_scores_stay_where_their_document_is(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    # One layout of the texts by number of parts; no join that shuffles postings by term.
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [term" not in plan


def test_scores_in_many_parts_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices("abcdefghij", k=n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 9)) or None, f"p{i % 4}") for i in range(60)], "doc bigint, text string, paper_id string")
    q = spark.createDataFrame([(i, text(3), i * 2) for i in range(9)], "query bigint, text string, w int")
    key = lambda df: sorted((r.query, r.doc, round(r.score, 9)) for r in df.collect())
    want = key(S.query_terms(q).join(S.weights(docs), "term").groupBy("query", "doc").agg(F.sum("w").alias("score")))
    monkeypatch.setattr(S, "DOCS", 7)
    monkeypatch.setattr(S, "BLOCK", 2)
    assert want and key(S.bm25(q, docs)) == want
    got = S.scored_pairs(q, docs, ("paper_id",), ("w",)).collect()
    assert len(got) == len(want) and all(r.paper_id == f"p{r.doc % 4}" and r.w == r.query * 2 for r in got)


def test_rewiring_in_many_parts(spark):
    rng = random.Random(8)
    rows = [(f"a{rng.randint(0, 80)}", f"b{rng.randint(0, 90)}", "r") for _ in range(900)] + [(f"a{i}", f"a{(i * 7 + 1) % 80}", "s") for i in range(80)] + [("a1", "b1", "r")] * 3
    e = spark.createDataFrame(rows, "src string, dst string, rel string")
    one, again = G.rewire(e, 5, rounds=4, bucket=20, part=100), G.rewire(e.repartition(7), 5, rounds=4, bucket=20, part=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    s = G.sanity(e, one).collect()[0]
    assert (s.src_degrees_changed, s.dst_degrees_changed, s.edges, s.new_edges, s.new_self_loops) == (0, 0, len(rows), len(rows), 0)
    assert s.new_duplicates <= s.duplicates == len(rows) - len(set(rows)) and s.edges_kept == len(set(rows) & set(map(tuple, one.collect()))) < 0.5 * len(rows)
    half = G.sanity(e, G.rewire(e, 6, rounds=2, bucket=20, part=100, share=0.3)).collect()[0]
    assert half.src_degrees_changed == half.dst_degrees_changed == 0 and 0.5 * len(set(rows)) < half.edges_kept < len(set(rows))


def test_rewiring_in_slices(spark, monkeypatch):
    """Slices bound what is shuffled at a time and change no row, of the graph or of its check."""
    rng = random.Random(9)
    e = spark.createDataFrame([(rng.randint(0, 80), rng.randint(100, 190), i % 2) for i in range(900)], "src bigint, dst bigint, rel int")
    whole = G.rewire(e, 5, rounds=2, bucket=20, part=100)
    checked = G.sanity(e, whole).collect()
    monkeypatch.setattr(G, "SLICE", 300)
    sliced = G.rewire(e, 5, rounds=2, bucket=20, part=100)
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, whole.collect()))
    assert G.sanity(e, sliced).collect() == checked and checked[0].edges_kept < 600


def test_g10_keeps_no_graph(spark, small):
    """The graph of a dose is gone when the next one is made, and none is left at the end."""
    session.tidy(spark)
    rows = QUERIES["g10_dose_validation"](spark, small)
    assert session._SCRATCH == []
    assert sorted(map(tuple, rows.collect())) == [(10, 0, True), (50, 0, True)]
    string, number = PG.edges(spark, small), PG.numbered(spark, small)
    count = lambda df: sorted(r.degree for r in G.degrees(df).collect())
    assert count(string) == count(number) and string.distinct().count() == number.distinct().count()


def test_q04_builds_no_table_of_intervals(spark, small):
    got = QUERIES["q04_reverification"](spark, small)
    assert "ShuffledHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(0, 0)]
