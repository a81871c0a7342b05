"""Queries on the graph of orders, parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators import graph as G
from heronry.operators import relational as R
from heronry.plans.registry import query
from heronry.session import table

CUT = "1998-01-01"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """order -has_part-> part -supplied_by-> supplier, order -placed_by-> customer."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    li = table(spark, d, "lineitem").select(
        F.inline(F.array(F.struct(key("o:", "l_orderkey").alias("src"), key("p:", "l_partkey").alias("dst"), F.lit("has_part").alias("rel")), F.struct(key("p:", "l_partkey").alias("src"), key("s:", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("rel"))))
    )
    return li.unionByName(table(spark, d, "orders").select(key("o:", "o_orderkey").alias("src"), key("c:", "o_custkey").alias("dst"), F.lit("placed_by").alias("rel")))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """The same graph with numbers for names, for what only counts: key times four plus the kind of node."""
    node = lambda c, kind: F.col(c) * 4 + kind
    rel = lambda n: F.lit(n).cast("tinyint").alias("rel")
    li = table(spark, d, "lineitem").select(
        F.inline(F.array(F.struct(node("l_orderkey", 0).alias("src"), node("l_partkey", 1).alias("dst"), rel(0)), F.struct(node("l_partkey", 1).alias("src"), node("l_suppkey", 2).alias("dst"), rel(1))))
    )
    return li.unionByName(table(spark, d, "orders").select(node("o_orderkey", 0).alias("src"), node("o_custkey", 3).alias("dst"), rel(2)))


def named(e: DataFrame) -> DataFrame:
    """The numbered graph with its names again."""
    node = lambda c: F.concat(F.element_at(F.array(*map(F.lit, ("o:", "p:", "s:", "c:"))), F.pmod(c, F.lit(4)).cast("int") + 1), F.shiftright(c, 2).cast("string")).alias(c)
    return e.select(node("src"), node("dst"), F.element_at(F.array(*map(F.lit, ("has_part", "supplied_by", "placed_by"))), F.col("rel") + 1).alias("rel"))


EDGES = "edges AS (SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, 'has_part' AS rel FROM lineitem UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by' FROM lineitem UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'placed_by' FROM orders), half AS (SELECT src AS node, dst AS nbr, rel, 'out' AS dir FROM edges UNION ALL SELECT dst, src, rel, 'in' FROM edges), deg AS (SELECT node, count(*) AS degree FROM half GROUP BY 1)"
#: Query set of the searches: parts whose key is divisible by 50, against the whole graph.
ANCHORS = "anchors AS (SELECT 'p:' || p_partkey AS anchor FROM part WHERE p_partkey % 50 = 0)"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("anchor"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the date they are known from: orders and parts; suppliers and customers have none and are always known."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_orderdate").alias("avail"))
    first = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.min("o_orderdate").alias("avail"))
    return o.unionByName(first.select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("node"), "avail"))


LEGAL = f"dated AS (SELECT 'o:' || o_orderkey AS node, o_orderdate AS avail FROM orders UNION ALL SELECT 'p:' || l_partkey, min(o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), legal AS (SELECT node FROM dated WHERE avail <= TIMESTAMP '{CUT} 00:00:00')"


def _legal(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).filter(F.col("avail") <= F.lit(CUT).cast("timestamp")).select("node")


@query(f"WITH {EDGES} SELECT node, CAST(degree AS BIGINT) AS degree FROM deg")
def g01_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(spark, d))


@query("WITH e AS (SELECT regexp_replace(arxiv_id, 'v[0-9]+$', '') AS src, regexp_replace(base_arxiv_id, 'v[0-9]+$', '') AS dst, 'same' AS rel FROM papers WHERE base_arxiv_id IS NOT NULL AND arxiv_id IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (src = dst) AS BIGINT) AS self_loops, CAST(count(*) FILTER (src <> dst) - count(DISTINCT (src, dst, rel)) FILTER (src <> dst) AS BIGINT) AS duplicates FROM e")
def g02_base_id_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").filter("base_arxiv_id is not null and arxiv_id is not null")
    return G.merge_report(p.select(F.col("arxiv_id").alias("src"), F.col("base_arxiv_id").alias("dst"), F.lit("same").alias("rel")))


@query(f"WITH {EDGES}, {LEGAL} SELECT deg.node, split_part(deg.node, ':', 1) AS kind, avail, coalesce(avail <= TIMESTAMP '{CUT} 00:00:00', split_part(deg.node, ':', 1) IN ('s', 'c')) AS legal FROM deg LEFT JOIN dated USING (node)")
def g03_node_dimension(spark: SparkSession, d: str) -> DataFrame:
    kind = F.substring_index("node", ":", 1)
    n = G.degrees(edges(spark, d)).select("node").join(_dated(spark, d), "node", "left")
    return n.select("node", kind.alias("kind"), "avail", F.coalesce(F.col("avail") <= F.lit(CUT).cast("timestamp"), kind.isin("s", "c")).alias("legal"))


@query(f"WITH {EDGES}, {LEGAL} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM legal) AND dst NOT IN (SELECT node FROM dated WHERE avail > TIMESTAMP '{CUT} 00:00:00')")
def p09_legality_mask(spark: SparkSession, d: str) -> DataFrame:
    late = _dated(spark, d).filter(F.col("avail") > F.lit(CUT).cast("timestamp")).select(F.col("node").alias("dst"))
    return edges(spark, d).join(_legal(spark, d).withColumnRenamed("node", "src"), "src", "left_semi").join(late, "dst", "left_anti").select("src", "dst")


@query(f"WITH {EDGES} SELECT rel, CAST(count(*) AS BIGINT) AS n FROM edges WHERE NOT ((src, dst) IN (SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem WHERE l_linenumber = 1) OR (dst, src) IN (SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem WHERE l_linenumber = 1)) GROUP BY 1")
def p11_masked_pairs(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"))
    pairs = gold.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    return edges(spark, d).join(pairs, ["src", "dst"], "left_anti").groupBy("rel").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT node, CAST(count(*) AS BIGINT) AS n FROM half WHERE nbr NOT IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'P') AND node NOT IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def p12_blocked_nodes(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"))
    return G.both_ways(edges(spark, d).join(blocked, "src", "left_anti")).groupBy("node").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS pool FROM orders WHERE o_orderdate <= TIMESTAMP '{CUT} 00:00:00'")
def p10_legal_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderdate") <= F.lit(CUT).cast("timestamp")).agg(F.count("*").alias("pool"))


@query(f"WITH {LEGAL} SELECT node, avail <= TIMESTAMP '{CUT} 00:00:00' AS legal FROM dated")
def p08_node_legality(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("node", (F.col("avail") <= F.lit(CUT).cast("timestamp")).alias("legal"))


@query(f"WITH {EDGES}, {ANCHORS} SELECT anchor, nbr, CAST(count(*) AS BIGINT) AS n FROM anchors JOIN half ON node = anchor GROUP BY 1, 2")
def g31_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.both_ways(edges(spark, d)).join(_anchors(spark, d), F.col("node") == F.col("anchor")).groupBy("anchor", "nbr").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT CAST(count(DISTINCT n) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges)")
def g05_flat(spark: SparkSession, d: str) -> DataFrame:
    # All nodes stay, no edge does; an edge left over would be counted.
    nodes, kept = G.flat(edges(spark, d))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("edges"))))  # one row each


@query(f"WITH {EDGES} SELECT 'connected' AS rel, CAST(count(*) AS BIGINT) AS n FROM edges")
def g06_untyped(spark: SparkSession, d: str) -> DataFrame:
    return G.untyped(edges(spark, d)).groupBy("rel").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, m AS (SELECT count(*) AS n, count(*) - count(DISTINCT (src, dst, rel)) AS dup FROM edges) SELECT CAST(0 AS BIGINT) AS src_degrees_changed, CAST(0 AS BIGINT) AS dst_degrees_changed, CAST(n AS BIGINT) AS edges, CAST(n AS BIGINT) AS new_edges, CAST(0 AS BIGINT) AS new_self_loops, true AS no_more_duplicates, true AS most_changed FROM m")
def g07_rewire(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    s = G.sanity(e, G.rewire(e, 11, rounds=4))
    return s.select("src_degrees_changed", "dst_degrees_changed", "edges", "new_edges", "new_self_loops", (F.col("new_duplicates") <= F.col("duplicates")).alias("no_more_duplicates"), (F.col("edges_kept") < 0.5 * F.col("edges")).alias("most_changed"))


@query(f"WITH {EDGES} SELECT rel, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1")
def g08_type_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return G.shuffle_types(edges(spark, d), 5).groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS src_degrees_changed, CAST(0 AS BIGINT) AS dst_degrees_changed, true AS some_changed, true AS most_kept")
def g09_partial_rewire(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    s = G.sanity(e, G.rewire(e, 12, rounds=2, share=0.25))
    return s.select("src_degrees_changed", "dst_degrees_changed", (F.col("edges_kept") < F.col("edges") - F.col("duplicates")).alias("some_changed"), (F.col("edges_kept") > 0.6 * (F.col("edges") - F.col("duplicates"))).alias("most_kept"))


AA = f"{EDGES}, {ANCHORS}, first AS (SELECT anchor, nbr AS m FROM anchors JOIN half ON node = anchor WHERE nbr <> node), two AS (SELECT anchor, h.nbr AS doc, 1 / ln(1 + greatest(degree, 1)) AS w FROM first JOIN deg ON deg.node = m JOIN half h ON h.node = m UNION ALL SELECT DISTINCT anchor, m, 2.0e0 FROM first), aa AS (SELECT anchor, doc, sum(w) AS score FROM two WHERE doc LIKE 'p:%' AND doc <> anchor GROUP BY 1, 2)"


@query(f"WITH {AA} SELECT anchor, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, doc) AS rank FROM aa) WHERE rank <= 80")
def g11_adamic_adar(spark: SparkSession, d: str) -> DataFrame:
    return G.adamic_adar(edges(spark, d), _anchors(spark, d), "p:", 80).select("anchor", "doc", F.round("score", 6).alias("score"), "rank")


PAIRS = "pairs AS (SELECT DISTINCT 'p:' || a.p_partkey AS a, 'p:' || b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 50 WHERE a.p_partkey % 50 = 0)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").filter("p_partkey % 50 = 0").select("p_partkey")
    b = a.select((F.col("p_partkey") - 50).alias("p_partkey"))
    return a.join(b, "p_partkey").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("a"), F.concat(F.lit("p:"), (F.col("p_partkey") + 50).cast("string")).alias("b"))


@query(f"WITH {EDGES}, {PAIRS}, via AS (SELECT a, b, min(x.nbr) AS m FROM pairs JOIN half x ON x.node = a JOIN half y ON y.node = x.nbr AND y.nbr = b GROUP BY 1, 2), dir AS (SELECT DISTINCT a, b FROM pairs JOIN half ON node = a AND nbr = b) SELECT pairs.a, pairs.b, CASE WHEN dir.a IS NOT NULL THEN 1 WHEN m IS NOT NULL THEN 2 END AS hops, CASE WHEN dir.a IS NULL THEN m END AS witness FROM pairs LEFT JOIN via USING (a, b) LEFT JOIN dir ON dir.a = pairs.a AND dir.b = pairs.b")
def g12_reach(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(edges(spark, d), _pairs(spark, d))


BFS = f"""{EDGES}, {ANCHORS}, cap AS (SELECT node, nbr, rel FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nbr, rel, dir) AS n FROM half) WHERE n <= 25),
l0 AS (SELECT anchor AS q, anchor AS node, 0 AS d FROM anchors),
l1 AS (SELECT DISTINCT q, nbr AS node, 1 AS d FROM l0 JOIN cap USING (node) WHERE (q, nbr) NOT IN (SELECT q, node FROM l0)),
l2 AS (SELECT DISTINCT q, nbr AS node, 2 AS d FROM l1 JOIN cap USING (node) WHERE (l1.node LIKE 'o:%' OR l1.node LIKE 'p:%') AND (q, nbr) NOT IN (SELECT q, node FROM l0 UNION ALL SELECT q, node FROM l1)),
l3 AS (SELECT DISTINCT q, nbr AS node, 3 AS d FROM l2 JOIN cap USING (node) WHERE (l2.node LIKE 'o:%' OR l2.node LIKE 'p:%') AND (q, nbr) NOT IN (SELECT q, node FROM l0 UNION ALL SELECT q, node FROM l1 UNION ALL SELECT q, node FROM l2)),
found AS (SELECT q, node AS doc, d FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE node LIKE 'p:%')"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).select(F.col("anchor").alias("query"), F.col("anchor").alias("seed"), F.lit(0).alias("seed_rank"))


@query(f"WITH {BFS} SELECT q AS query, doc, CAST(d AS INT) AS hops, round(1 / (1.0e0 + d), 6) AS support FROM found")
def g14_support_bfs(spark: SparkSession, d: str) -> DataFrame:
    f = G.support(G.bounded_bfs(edges(spark, d), _seeds(spark, d), "p:", ["o:"]))
    return f.select("query", "doc", "hops", F.round("support", 6).alias("support"))


@query(f"WITH {BFS} SELECT query, doc, CAST(rank AS INT) AS rank FROM (SELECT q AS query, doc, row_number() OVER (PARTITION BY q ORDER BY d, doc) AS rank FROM found) WHERE rank <= 10")
def g16_ranking_rules(spark: SparkSession, d: str) -> DataFrame:
    s = G.support(G.bounded_bfs(edges(spark, d), _seeds(spark, d), "p:", ["o:"]))
    return G.rank_support(s, 10, "path").select("query", "doc", "rank")


@query()
def g13_typed_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Search that stops at what is not yet known at the cutoff; neighbours capped by relation, then name."""
    e = edges(spark, d).join(_legal(spark, d).withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "rel")
    return G.rank_support(G.support(G.bounded_bfs(e, _seeds(spark, d), "p:", ["o:"], through_illegal=False, by_relation=True)), 20)


@query()
def g15_blocked_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Search with blocked nodes (pending orders) and a relation whitelist."""
    blocked = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"))
    e = edges(spark, d).join(blocked, "src", "left_anti").select("src", "dst", "rel")
    return G.support(G.bounded_bfs(e, _seeds(spark, d), "p:", ["o:"], relations=["has_part"]))


@query(f"WITH {EDGES}, {ANCHORS} SELECT anchor, nbr, CAST(place AS INT) AS place FROM (SELECT anchor, nbr, row_number() OVER (PARTITION BY anchor ORDER BY nbr) AS place FROM (SELECT DISTINCT anchor, nbr FROM anchors JOIN half ON node = anchor WHERE rel = 'has_part' AND dir = 'in')) WHERE place <= 10")
def g17_direct_neighbours(spark: SparkSession, d: str) -> DataFrame:
    h = G.both_ways(edges(spark, d)).filter("rel = 'has_part' and dir = 'in'").join(_anchors(spark, d), F.col("node") == F.col("anchor")).select("anchor", "nbr").distinct()
    return R.top_k(h, ["anchor"], 10, "nbr", name="place").select("anchor", "nbr", "place")


@query(f"WITH {EDGES} SELECT node, CAST(count(*) FILTER (dir = 'out') AS BIGINT) AS backward, CAST(count(*) FILTER (dir = 'in') AS BIGINT) AS forward FROM half WHERE rel = 'has_part' GROUP BY 1")
def g19_backward_forward(spark: SparkSession, d: str) -> DataFrame:
    h = G.both_ways(edges(spark, d).filter("rel = 'has_part'"))
    return h.groupBy("node").agg(F.count_if(F.col("dir") == "out").alias("backward"), F.count_if(F.col("dir") == "in").alias("forward"))


COCITED = f"{EDGES}, {ANCHORS}, u AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'has_part'), s AS (SELECT dst AS anchor, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM u WHERE dst IN (SELECT anchor FROM anchors)) WHERE n <= 25), o AS (SELECT src, dst AS doc FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM u) WHERE n <= 25), c AS (SELECT anchor, doc, count(*) AS n FROM s JOIN o USING (src) WHERE doc <> anchor GROUP BY 1, 2)"


@query(f"WITH {COCITED} SELECT anchor, doc, CAST(n AS BIGINT) AS n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, doc) AS rank FROM c) WHERE rank <= 10")
def g20_co_citation(spark: SparkSession, d: str) -> DataFrame:
    return G.co_cited(edges(spark, d).filter("rel = 'has_part'"), _anchors(spark, d), 10).select("anchor", "doc", "n", "rank")


@query(f"WITH {EDGES}, {ANCHORS} SELECT anchor, h.nbr AS doc, CAST(count(*) AS BIGINT) AS n FROM anchors JOIN half x ON x.node = anchor JOIN half h ON h.node = x.nbr WHERE h.nbr <> anchor AND h.nbr LIKE 'p:%' GROUP BY 1, 2")
def j09_two_hop(spark: SparkSession, d: str) -> DataFrame:
    h = G.both_ways(edges(spark, d)).select("node", "nbr")
    one = h.join(_anchors(spark, d), F.col("node") == F.col("anchor")).select("anchor", F.col("nbr").alias("node"))
    return one.join(h, "node").filter(F.col("nbr").startswith("p:") & (F.col("nbr") != F.col("anchor"))).groupBy("anchor", F.col("nbr").alias("doc")).agg(F.count("*").alias("n"))


@query()
def g21_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_paths(edges(spark, d).filter("rel = 'has_part'"), _pairs(spark, d), 4, 5)


_DRAWN = "SELECT 'p:' || p_partkey FROM part WHERE p_partkey % 50 <> 0 ORDER BY sha256(p_partkey || '|23'), p_partkey LIMIT 20"


@query(f"WITH {AA.replace('anchors AS (SELECT', 'true_anchors AS (SELECT 1), anchors AS (SELECT').replace('FROM part WHERE p_partkey % 50 = 0', 'FROM part WHERE (%s) IN (SELECT * FROM (%s))' % (chr(39) + 'p:' + chr(39) + ' || p_partkey', _DRAWN))} SELECT anchor, doc, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, doc) AS rank FROM aa) WHERE rank <= 10")
def g23_other_anchor(spark: SparkSession, d: str) -> DataFrame:
    # Control: as many anchors as a run asks for, drawn by seed from all parts that are no query's own.
    other = R.seeded_sample(table(spark, d, "part").filter("p_partkey % 50 <> 0"), 20, 23, "p_partkey").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("anchor"))
    return G.adamic_adar(edges(spark, d), other, "p:", 10).select("anchor", "doc", "rank")


@query(f"WITH {EDGES}, {ANCHORS}, p AS (SELECT node, degree FROM deg WHERE node LIKE 'p:%'), c AS (SELECT anchor, b.node, row_number() OVER (PARTITION BY anchor ORDER BY abs(b.degree - a.degree), b.node) AS n FROM anchors JOIN p a ON a.node = anchor JOIN p b ON b.node <> anchor) SELECT anchor, node AS control FROM c WHERE n = 1")
def g24_degree_matched(spark: SparkSession, d: str) -> DataFrame:
    # The nearest degree is the own, or the next one below or above that any node has; per degree only the first nodes can win.
    p = G.degrees(edges(spark, d)).filter(F.col("node").startswith("p:"))
    pool = R.top_k(p, ["degree"], 2, "node", name="_n").select("node", "degree")
    w = Window.orderBy("degree")  # distinct degrees: at most the square root of twice the edges
    steps = p.select("degree").distinct().select(F.col("degree").alias("own"), F.array("degree", F.lag("degree").over(w), F.lead("degree").over(w)).alias("near"))
    own = p.join(_anchors(spark, d), F.col("node") == F.col("anchor")).select("anchor", F.col("degree").alias("own"))
    c = own.join(steps, "own").select("anchor", "own", F.explode("near").alias("degree")).join(pool, "degree").filter("node <> anchor").withColumn("gap", F.abs(F.col("degree") - F.col("own")))
    return R.keep_first(c, ["anchor"], "gap", "node").select("anchor", F.col("node").alias("control"))


@query(f"WITH {EDGES} SELECT rel, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT src) AS BIGINT) AS sources FROM edges WHERE rel IN ('has_part', 'supplied_by') GROUP BY 1")
def g25_edge_families(spark: SparkSession, d: str) -> DataFrame:
    per = edges(spark, d).filter(F.col("rel").isin("has_part", "supplied_by")).groupBy("rel", "src").agg(F.count("*").alias("k"))
    return per.groupBy("rel").agg(F.sum("k").alias("n"), F.count("*").alias("sources"))


@query()
def g26_graph_hashes(spark: SparkSession, d: str) -> DataFrame:
    return G.topology_hash(edges(spark, d))


@query(f"WITH {EDGES}, o AS (SELECT rel, src, count(*) AS k FROM edges GROUP BY 1, 2) SELECT rel, CAST(k AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS nodes FROM o GROUP BY 1, 2")
def a14_degree_profile(spark: SparkSession, d: str) -> DataFrame:
    per = edges(spark, d).groupBy("rel", "src").agg(F.count("*").alias("out_degree"))
    return per.groupBy("rel", "out_degree").agg(F.count("*").alias("nodes"))


@query(f"WITH {EDGES}, {PAIRS}, via AS (SELECT DISTINCT a, b FROM pairs JOIN half x ON x.node = a JOIN half y ON y.node = x.nbr AND y.nbr = b) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN via.a IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS within_2 FROM pairs LEFT JOIN via USING (a, b)")
def a18_reachability(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(edges(spark, d), _pairs(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("hops", F.lit(9)) <= 2).cast("double")), 6).alias("within_2"))


@query(f"WITH {AA}, top AS (SELECT anchor, doc FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, doc) AS n FROM aa) WHERE n <= 20), hop AS (SELECT DISTINCT anchor, doc FROM aa) SELECT anchor, bool_or(top.doc IS NULL) AS hard FROM hop LEFT JOIN top USING (anchor, doc) GROUP BY 1")
def g29_graph_hard(spark: SparkSession, d: str) -> DataFrame:
    # A query is hard if something within two hops is not among its first 20.
    every = G.adamic_adar(edges(spark, d), _anchors(spark, d), "p:", 1 << 30)
    return every.groupBy("anchor").agg(F.bool_or(F.col("rank") > 20).alias("hard"))


@query("SELECT base, CAST(count(DISTINCT arxiv_id) AS BIGINT) AS spellings, bool_or(regexp_matches(arxiv_id, 'v[0-9]+$')) AS versioned FROM (SELECT arxiv_id, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS base FROM papers WHERE arxiv_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT arxiv_id) > 1")
def g30_identity_exposure(spark: SparkSession, d: str) -> DataFrame:
    from heronry.functions.text import base_id

    p = table(spark, d, "papers").filter("arxiv_id is not null").select("arxiv_id", base_id("arxiv_id").alias("base")).distinct()
    g = p.groupBy("base").agg(F.count("*").alias("spellings"), F.bool_or(F.col("arxiv_id").rlike("v[0-9]+$")).alias("versioned"))
    return g.filter("spellings > 1")


@query("SELECT base_arxiv_id AS base, string_agg(DISTINCT arxiv_id, ',' ORDER BY arxiv_id) AS nodes FROM papers WHERE base_arxiv_id IS NOT NULL AND arxiv_id IS NOT NULL GROUP BY 1")
def g04_spellings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").filter("base_arxiv_id is not null and arxiv_id is not null")
    return p.groupBy(F.col("base_arxiv_id").alias("base")).agg(F.array_join(F.array_sort(F.collect_set("arxiv_id")), ",").alias("nodes"))


@query(f"WITH {EDGES} SELECT node, nbr, CAST(place AS INT) AS place FROM (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY nbr, rel, dir) AS place FROM half) WHERE place <= 25")
def t05_neighbour_cap(spark: SparkSession, d: str) -> DataFrame:
    return G.capped(edges(spark, d)).select("node", "nbr", "place")


@query(f"WITH {EDGES} SELECT dir, rel, CAST(count(*) AS BIGINT) AS n FROM half GROUP BY 1, 2")
def s12_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return G.both_ways(edges(spark, d)).groupBy("dir", "rel").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT a.l_partkey AS a, b.l_partkey AS b, min(a.l_orderkey) AS witness FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 50 = 0) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2) SELECT a, b, witness FROM x")
def j10_common_neighbour(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a = u.filter("l_partkey % 50 = 0").select("l_orderkey", F.col("l_partkey").alias("a"))
    return a.join(u.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").filter("a <> b").groupBy("a", "b").agg(F.min("l_orderkey").alias("witness"))


@query("WITH x AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 50 = 0) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2) SELECT a, b, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM x) WHERE r <= 5")
def j11_co_citation_join(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a = u.filter("l_partkey % 50 = 0").select("l_orderkey", F.col("l_partkey").alias("a"))
    n = a.join(u.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return R.top_k(n, ["a"], 5, "-n", "b").select("a", "b", "n")
