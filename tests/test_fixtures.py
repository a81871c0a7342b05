"""Small fixtures with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import episodes as E
from heronry.operators import graph as G
from heronry.operators import metrics as M
from heronry.operators import relational as R
from heronry.operators import retrieval as S
from heronry.operators import stats as X
from heronry.operators import topk_bm25
from heronry.sources import files, model, report

RANKED = [("q", d, i + 1) for i, d in enumerate(["p3", "p7", "p1", "p9", "p2"])]
SCHEMA = "query string, doc string, rank int"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_metric_list(spark):
    gold = spark.createDataFrame([("q", d) for d in ("p7", "p2", "p5")] + [("other", "p1")], "query string, doc string")
    m = one(M.evaluate(spark.createDataFrame(RANKED, SCHEMA), gold, ks=(2, 5)))
    assert m.top1 == 0 and m.mrr == 0.5 and m.hit_5 == 1 and m.recall_5 == pytest.approx(2 / 3) and m.recall_2 == pytest.approx(1 / 3)
    assert m.oracle_recall_2 == 0.5 and m.ndcg_2 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and m.ap_5 == pytest.approx((1 / 2 + 2 / 5) / 3)
    none = one(M.evaluate(spark.createDataFrame(RANKED, SCHEMA), gold.filter("false")))
    assert none.mrr == 0 and none.recall_10 == 0 and none.ndcg_5 == 0


def test_tolerant_recall(spark):
    r = spark.createDataFrame([("q", 6, 1)], "query string, doc int, rank int")
    for gold, want in ((7, 1.0), (9, 0.0)):
        assert one(M.tolerant_recall(r, spark.createDataFrame([("q", gold)], "query string, doc int"), 5)).tolerant_recall == want


def test_bootstrap_and_permutation(spark):
    rows = [(i, c, v) for i in range(40) for c, v in (("hi", 1.0), ("lo", 0.0))]
    p = X.paired(spark.createDataFrame(rows, "k int, c string, v double"), "k", "c", "v", "hi", "lo")
    b = one(X.bootstrap(p, "k", 100, 1))
    assert (b.n, b.mean, b.lo, b.hi) == (40, 1.0, 1.0, 1.0)
    assert one(X.sign_flip(p, "k", 100, 1)).p_value < 0.02
    same = p.withColumn("diff", F.lit(0.0))
    assert one(X.sign_flip(same, "k", 100, 1)).p_value == 1.0
    r = one(X.replay(p.withColumn("g", F.lit("x")), 100, 1, ("g",), "k"))
    assert (r.n, r.mean, r.lo, r.hi) == (40, 1.0, 1.0, 1.0)


def test_bootstrap_interval_covers_the_mean(spark):
    rng = random.Random(3)
    x = [rng.gauss(0.5, 1) for _ in range(400)]
    b = one(X.bootstrap(spark.createDataFrame(list(enumerate(x)), "k int, diff double"), "k", 300, 2))
    se = 1.96 / math.sqrt(400)
    assert b.lo == pytest.approx(sum(x) / 400 - se, abs=0.035) and b.hi == pytest.approx(sum(x) / 400 + se, abs=0.035)


def test_holm_and_claims(spark):
    t = spark.createDataFrame([("f", "a", 0.001), ("f", "b", 0.04), ("f", "c", 0.5), ("f", "d", None)], "family string, name string, p double")
    got = {r.name: r for r in X.holm(t, "p", "family").collect()}
    assert got["a"].reject and not got["c"].reject and got["a"].p_holm == pytest.approx(0.003) and got["b"].p_holm == pytest.approx(0.08) and got["d"].p_holm is None
    rows = spark.createDataFrame([([True, True], 1.0), ([True, False], 1.0), ([False], 1.0), ([True], 0.5)], "ok array<boolean>, u double")
    assert [r[0] for r in rows.select(X.claim(F.col("ok"), F.col("u"))).collect()] == ["Supported", "Mixed", "Not supported", "Inconclusive uptake"]


def test_trend(spark):
    d = spark.createDataFrame([("a", x, float(x)) for x in range(6)] + [("b", x, float(-x)) for x in range(6)], "g string, dose int, v double")
    got = {r.g: r for r in X.trend(d, "dose", "v", ("g",), 200, 1).collect()}
    assert got["a"].rho == pytest.approx(1) and got["b"].rho == pytest.approx(-1) and got["a"].p_value < 0.05


EDGES = [("a", "x", "r1"), ("b", "y", "r1"), ("c", "z", "r1"), ("d", "w", "r1"), ("a", "y", "r2"), ("b", "z", "r2"), ("c", "x", "r2"), ("x", "a", "r3"), ("y", "b", "r3"), ("z", "c", "r3")]


def test_rewire_keeps_degrees(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, rel string")
    a, b = (sorted(map(tuple, G.rewire(x, 5, rounds=6).collect())) for x in (e, e.repartition(3)))
    s = one(G.sanity(e, spark.createDataFrame(a, e.schema)))
    assert a == b and a != sorted(EDGES)
    assert (s.src_degrees_changed, s.dst_degrees_changed, s.new_self_loops, s.new_duplicates, s.new_edges) == (0, 0, 0, 0, 10)
    assert sorted(r[2] for r in G.shuffle_types(e, 3).collect()) == sorted(x[2] for x in EDGES)


def test_expansion_reach_and_paths(spark):
    e = spark.createDataFrame([("p:1", "p:2", "c"), ("p:2", "p:3", "c"), ("p:1", "q:1", "h"), ("q:1", "p:4", "c"), ("p:4", "p:4", "c")], "src string, dst string, rel string")
    pairs = spark.createDataFrame([("p:1", "p:2"), ("p:1", "p:3"), ("p:1", "p:4"), ("p:3", "p:4")], "a string, b string")
    assert {(r.a, r.b): (r.hops, r.witness) for r in G.reach(e, pairs).collect()} == {("p:1", "p:2"): (1, None), ("p:1", "p:3"): (2, "p:2"), ("p:1", "p:4"): (2, "q:1"), ("p:3", "p:4"): (None, None)}
    legal = spark.createDataFrame([("p:2",), ("p:3",)], "node string")
    assert {(r.b, r.hops) for r in G.reach(e, pairs.filter("a = 'p:1'"), legal).collect()} == {("p:2", 1), ("p:3", 2), ("p:4", None)}
    aa = {r.doc: r.score for r in G.adamic_adar(e, spark.createDataFrame([("p:1",)], "anchor string"), "p:", 9).collect()}
    assert aa == pytest.approx({"p:2": 2.0, "p:3": 1 / math.log(3), "p:4": 1 / math.log(3)})
    paths = [r.path for r in G.simple_paths(e, spark.createDataFrame([("p:3", "p:4")], "a string, b string"), 4, 5).collect()]
    assert paths == ["p:3>p:2>p:1>q:1>p:4"]


def test_search_masks_blocks_and_cutoffs(spark):
    e = spark.createDataFrame([("p:1", "p:2", "c"), ("p:2", "p:3", "c"), ("p:3", "p:5", "c"), ("p:1", "q:1", "h"), ("q:1", "p:4", "c")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("k", "p:1", 0)], "query string, seed string, seed_rank int")
    run = lambda **x: {r.doc: r.hops for r in G.bounded_bfs(e, seeds, "p:", ["q:"], **x).collect()}
    assert run() == {"p:2": 1, "p:3": 2, "p:5": 3, "p:4": 2}
    assert run(max_hops=2) == {"p:2": 1, "p:3": 2, "p:4": 2} and run(cap=1) == {"p:2": 1}
    assert run(relations=["c"]) == {"p:2": 1, "p:3": 2, "p:5": 3}
    assert run(masked=spark.createDataFrame([("p:1", "p:2"), ("p:2", "p:1")], "node string, nbr string")) == {"p:4": 2}
    assert run(blocked=spark.createDataFrame([("k", "q:1")], "query string, node string")) == {"p:2": 1, "p:3": 2, "p:5": 3}
    legal = spark.createDataFrame([("k", "p:3"), ("k", "p:4")], "query string, node string")
    assert run(legal=legal) == {"p:3": 2, "p:4": 2} and run(legal=legal, through_illegal=False) == {"p:4": 2}


def test_timestamps_masking_and_ids(spark):
    df = spark.createDataFrame([("2020-01-02",), ("2020-01-02T03:04",), ("2020-01-02 03:04:05.678+02:00",), ("2020-01-02T03:04:05Z",), ("",), ("nan",), ("None",), ("NaT",), (None,), ("02.01.2020",)], "v string")
    got = [r[0] for r in df.select(T.canonical_timestamp("v")).collect()]
    assert got == ["2020-01-02 00:00:00", "2020-01-02 03:04:00", "2020-01-02 03:04:05", "2020-01-02 03:04:05"] + [None] * 6
    t = spark.createDataFrame([(r"As \citep[see][]{a1,b2} and \cite{c3} and \Citet*{d4}", "b2")], "t string, k string")
    r = one(t.select(T.mask_target("t", F.col("k")).alias("m"), T.citation_count("t").alias("n"), T.neutralise_citations("t").alias("c"), T.context_tokens("t").alias("w")))
    assert r.m == "As [MASKED_CITATION] and [CITATION] and [CITATION]" and r.n == 3 and "{" not in r.c
    few = spark.createDataFrame([(r"\alpha\cdot x \frac{1}{2}",), ("one two three four five",)], "t string")
    counts = [r[0] for r in few.select(T.context_tokens("t")).collect()]
    assert counts[0] < 3 and counts[1] == 5
    ids = spark.createDataFrame([("1706.03762v5",), ("1706.03762",), ("v2x",)], "i string")
    assert [r[0] for r in ids.select(T.base_id("i")).collect()] == ["1706.03762", "1706.03762", "v2x"]
    assert one(spark.range(1).select(T.clamp(F.lit("1.5")).alias("a"), T.clamp(F.lit("x")).alias("b"), T.paragraph_number(F.lit("p7")).alias("c"), T.paragraph_number(F.lit("q")).alias("d"))) == (1.0, 0.0, 7, None)


@pytest.mark.parametrize("block", [500, 4])
def test_bm25_forms_agree(spark, monkeypatch, block):
    monkeypatch.setattr(topk_bm25, "BLOCK", block)
    monkeypatch.setattr(topk_bm25, "BATCH", 16)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefghijk") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))), rng.randint(0, 9)) for i in range(120)] + [(500, None, 1), (501, "", 1)]
    qs = [(i, " ".join(rng.choice("abcdefghijkz") for _ in range(4)), rng.randint(0, 9)) for i in range(9)] + [(90, None, 1)]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)).alias
    d = spark.createDataFrame(docs, "doc bigint, text string, n int").select("doc", "text", day("n")("avail"))
    q = spark.createDataFrame(qs, "query bigint, text string, n int").select("query", "text", day("n")("as_of"))
    key = lambda df: [(r.query, r.doc, round(r.score, 5), r.rank) for r in df.orderBy("query", "rank").collect()]
    assert key(topk_bm25.search(q, d, 7)) == key(S.rank_scores(S.bm25(q, d), 7))
    legal = S.bm25(q, d).join(d, "doc").join(q.select("query", "as_of"), "query").filter("avail <= as_of").select("query", "doc", "score")
    assert key(topk_bm25.search(q, d, 7, visible=True)) == key(S.rank_scores(legal, 7))
    assert topk_bm25.search(q, d.limit(0), 5).collect() == [] and topk_bm25.search(q.limit(0), d, 5).collect() == []


def test_global_rank_split_and_shard(spark):
    xs = [(x % 7, x) for x in random.Random(1).sample(range(1000), 300)]
    df = spark.createDataFrame(xs, "a int, b int").repartition(5)
    got = {(r.a, r.b): r.position for r in R.global_rank(df, "a", "-b").collect()}
    want = {x: i for i, x in enumerate(sorted(xs, key=lambda t: (t[0], -t[1])))}
    assert got == want
    assert sorted(r.b for r in R.shard(df, 4, 1, "b").collect()) == sorted(x[1] for x in xs)[1::4]
    split = [r.split for r in R.rank_split(df, [("train", 0.7), ("dev", 0.85)], "test", "b").collect()]
    assert (split.count("train"), split.count("dev"), split.count("test")) == (210, 45, 45)
    assert R.global_rank(df.limit(0), "a").collect() == []


def test_budget_fold_skips_and_goes_on(spark):
    df = spark.createDataFrame([([(1, 50), (2, 70), (3, 40), (4, 20)],), ([],)], "s array<struct<n:int,cost:bigint>>")
    assert [tuple(r.f) for r in df.select(R.budget_fold(F.col("s"), "cost", 100).alias("f")).collect()] == [(90, 2, 2), (0, 0, 0)]


def test_actions_answers_and_loop(spark):
    text = [('<x> {"action": "search", "query": "q"} y', "call"), ('{"action": "finalize"}', "final"), ('{"action": "fly"}', "unknown_verb"), ("none", "malformed"), ('{"action": ', "malformed"), (None, "malformed")]
    df = spark.createDataFrame([(t,) for t, _ in text], "t string")
    assert [r.a.kind for r in df.select(E.parse_action(F.col("t"), ["search"]).alias("a")).collect()] == [k for _, k in text]
    answers = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), (["a", "a"], ["a"]), (["a"], ["a"]), (["a", "z"], ["a"])], "r array<string>, o array<string>")
    assert [r[0] for r in answers.select(E.validate_answer(F.col("r"), F.col("o"), 2)).collect()] == ["", "repeated", "short_answer", "unobserved"]
    tools = {"search": lambda a: a["ids"], "open": lambda a: ["x" * 40_000]}
    script = [{"action": "search", "ids": ["a", "b"]}, {"action": "fly"}, {"action": "open"}, {"action": "search", "ids": ["b", "c"]}, {"action": "finalize", "ranked": ["c", "z", "c"]}]
    out = E.run_loop(E.MockPolicy(script), tools)
    assert out["ranked"] == ["c"] and out["observed"] == ["a", "b", "c"] and out["calls"] == 4 and [x["blocked"] for x in out["log"]] == [False, True, False, False]
    assert E.run_loop(E.MockPolicy(script), tools, max_calls=1) == {"ranked": ["a", "b"], "calls": 1, "observed": ["a", "b"], "log": out["log"][:1], "forced": True}


def test_files_model_and_report(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    (tmp_path / "in.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    rows = files.read_jsonl_tolerant(spark, path, "a int").collect()
    assert sorted((r.a is None, r.a or 0) for r in rows) == [(False, 1), (False, 2), (True, 0)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        files.read_jsonl(spark, path, "a int").collect()
    odd = spark.createDataFrame([(1, ' a "b", \n c '), (2, ""), (3, None)], "k int, t string")
    files.write_csv(odd, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "k int, t string").collect())) == [(1, ' a "b", \n c '), (2, ""), (3, None)]
    prompts = spark.createDataFrame([("x",), ("y",), ("x",)], "prompt string")
    first = model.ask(prompts, spark.createDataFrame([], "key string, response string"), "m", "1")
    assert first.count() == 2 and all(json.loads(r.response) for r in first.collect())

    def never(p):
        raise AssertionError(p)

    again = model.ask(prompts, spark.createDataFrame(first.collect(), first.schema), "m", "1", never)
    assert again.count() == 2
    assert report.markdown(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n|---|---|---|\n| a\\|b | 0.500 |  |\n"
    with pytest.raises(ValueError, match="rows"):
        report.markdown(spark.range(2000).toDF("n"))
    assert report.run_directory(str(tmp_path / "runs"), "run-7").endswith("run-7")
    with pytest.raises(ValueError, match="identifier"):
        report.run_directory(str(tmp_path), "../x")
