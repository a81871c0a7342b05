"""Typed directed graphs as edge frames (src, dst, rel): neighbourhoods, expansion, search, perturbation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import base_id
from heronry.operators.relational import global_rank, top_k
from heronry.session import discard, materialise, scratch, sweep

ONE_HOP_BONUS, PER_NODE_CAP = 2.0, 25
#: Edges that a task of a rewiring holds, about.
PART = 250_000
#: Edges that are shuffled at a time, about, by a rewiring or its check; a larger graph is done slice by slice, so that shuffle files take the disk of one.
SLICE = 20_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, nbr, rel, dir) with every edge seen from either end; parallel edges stay."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit("out").alias("dir")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.lit("in").alias("dir")))
    return edges.select("rel", F.inline(ends)).select("node", "nbr", "rel", "dir")


def flat(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the variant that keeps every node and no edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges.filter("false")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), parallel edges counted."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def merge_base_ids(edges: DataFrame) -> DataFrame:
    """Version suffixes off, self-loops and repeats out."""
    plain = edges.select(base_id("src").alias("src"), base_id("dst").alias("dst"), "rel")
    return plain.filter("src <> dst").distinct()


def merge_report(edges: DataFrame) -> DataFrame:
    """(n, self_loops, duplicates) of a merge, from one aggregation."""
    plain = edges.select(base_id("src").alias("src"), base_id("dst").alias("dst"), "rel").groupBy("src", "dst", "rel").agg(F.count("*").alias("k"))
    loop = F.col("src") == F.col("dst")
    return plain.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(loop, F.col("k"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.when(~loop, F.col("k") - 1)), F.lit(0)).alias("duplicates"))


def adamic_adar(edges: DataFrame, anchors: DataFrame, candidates: str, k: int, legal: DataFrame | None = None) -> DataFrame:
    """(anchor, doc, score, rank) by the at most 2-hop Adamic-Adar expansion of each anchor (column ``anchor``).

    A middle node m adds 1/ln(1 + degree(m)) per edge on either side, a direct neighbour two more. Degrees are those of
    the whole graph; middle nodes and candidates must be ``legal`` (node) if given. Candidates are the nodes whose name
    begins with ``candidates``; anchors are none. Expanding starts from the anchors, never from all pairs.
    """
    ends = both_ways(edges).select("node", "nbr")
    allowed = lambda df: df if legal is None else df.join(legal.select(F.col("node").alias("nbr")), "nbr", "left_semi").select("node", "nbr")
    first = allowed(ends.join(anchors.select(F.col("anchor").alias("node")).distinct(), "node", "left_semi")).filter("nbr <> node").select(F.col("node").alias("anchor"), F.col("nbr").alias("m"))
    # Only the edges at middle nodes go on: their number is the middle node's degree, and they lead to the candidates.
    near = ends.join(first.select(F.col("m").alias("node")).distinct(), "node", "left_semi")
    weight = near.groupBy(F.col("node").alias("m")).agg((1.0 / F.ln(1.0 + F.greatest(F.count("*"), F.lit(1)))).alias("w"))
    two = first.join(weight, "m").join(allowed(near).select(F.col("node").alias("m"), "nbr"), "m").groupBy("anchor", F.col("nbr").alias("doc")).agg(F.sum("w").alias("score"))
    one = first.select("anchor", F.col("m").alias("doc")).distinct().select("anchor", "doc", F.lit(ONE_HOP_BONUS).alias("score"))
    total = two.unionByName(one).filter(F.col("doc").startswith(candidates) & (F.col("doc") != F.col("anchor"))).groupBy("anchor", "doc").agg(F.sum("score").alias("score"))
    return top_k(total.withColumn("_s", -F.round("score", 9)), ["anchor"], k, "_s", "doc").drop("_s")


def reach(edges: DataFrame, pairs: DataFrame, legal: DataFrame | None = None) -> DataFrame:
    """(a, b, hops, witness) of asked pairs (a, b): 1 if adjacent, 2 with the least legal middle node, null if neither."""
    # Only edges at an asked end can make a path of at most two.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    half = both_ways(edges).select("node", "nbr").join(asked, "node", "left_semi").distinct()
    direct = pairs.join(half.select(F.col("node").alias("a"), F.col("nbr").alias("b"), F.lit(1).alias("direct")), ["a", "b"], "left")
    mid = half if legal is None else half.join(legal.select(F.col("node").alias("nbr")), "nbr", "left_semi").select("node", "nbr")
    via = pairs.join(mid.select(F.col("node").alias("a"), F.col("nbr").alias("m")), "a").join(half.select(F.col("node").alias("b"), F.col("nbr").alias("m")), ["b", "m"])
    via = via.filter("m <> a and m <> b").groupBy("a", "b").agg(F.min("m").alias("m"))
    hops = F.when(F.col("direct") == 1, 1).when(F.col("m").isNotNull(), 2)
    return direct.join(via, ["a", "b"], "left").select("a", "b", hops.alias("hops"), F.when(F.coalesce("direct", F.lit(0)) == 0, F.col("m")).alias("witness"))


def capped(edges: DataFrame, by_relation: bool = False, cap: int = PER_NODE_CAP) -> DataFrame:
    """Adjacency cut to each node's first ``cap`` neighbours by name (or relation, then name), before any other filter."""
    order = ("rel", "nbr", "dir") if by_relation else ("nbr", "rel", "dir")
    return top_k(both_ways(edges), ["node"], cap, *order, name="place")


def bounded_bfs(
    edges: DataFrame, seeds: DataFrame, candidates: str, waypoints: Sequence[str], max_hops: int = 3, cap: int = PER_NODE_CAP,
    relations: Sequence[str] | None = None, masked: DataFrame | None = None, blocked: DataFrame | None = None,
    legal: DataFrame | None = None, through_illegal: bool = True, by_relation: bool = False,
) -> DataFrame:
    """(query, seed, seed_rank, doc, hops): candidates that breadth-first search meets from each seed, level by level.

    ``seeds`` has (query, seed, seed_rank). The frontier of a level is joined with the capped adjacency and what was
    seen is taken away, so the work per seed is bounded by cap**hops whatever the degree of a hub. Nodes named like
    ``candidates`` or ``waypoints`` are searched on; candidates count only if ``legal`` (query, node), if that is
    given, and illegal ones are searched through only with ``through_illegal``. ``masked`` (node, nbr) pairs are not
    walked; ``blocked`` (query, node) nodes are never met.
    """
    adj = capped(edges, by_relation, cap).select("node", "nbr", "rel")
    if relations is not None:
        adj = adj.filter(F.col("rel").isin(*relations))
    if masked is not None:
        adj = adj.join(masked.select("node", "nbr"), ["node", "nbr"], "left_anti")
    adj = materialise(adj.select("node", "nbr").distinct())
    keys = ["query", "seed", "seed_rank"]
    seen = seeds.select(*keys, F.col("seed").alias("doc"), F.lit(0).alias("hops"), F.lit(True).alias("walk"), F.lit(False).alias("counts"))
    front = seen
    for hop in range(1, max_hops + 1):
        met = front.filter("walk").select(*keys, F.col("doc").alias("node")).join(adj, "node").select(*keys, F.col("nbr").alias("doc")).distinct()
        met = met.join(seen.select(*keys, "doc"), [*keys, "doc"], "left_anti")
        if blocked is not None:
            met = met.join(blocked.select("query", F.col("node").alias("doc")), ["query", "doc"], "left_anti")
        cand = F.col("doc").startswith(candidates)
        if legal is not None:
            met = met.join(legal.select("query", F.col("node").alias("doc"), F.lit(True).alias("_ok")).distinct(), ["query", "doc"], "left")
            ok = F.coalesce("_ok", F.lit(False))
        else:
            ok = F.lit(True)
        on = F.lit(False)
        for w in waypoints:
            on = on | F.col("doc").startswith(w)
        walk = (cand if through_illegal else cand & ok) | on
        front = materialise(met.select(*keys, "doc", F.lit(hop).alias("hops"), walk.alias("walk"), (cand & ok).alias("counts")))
        seen = seen.unionByName(front)
    return seen.filter("counts").select(*keys, "doc", "hops")


def support(found: DataFrame) -> DataFrame:
    """(query, doc, support, hops, seed_rank): the sum of 1/((1 + seed rank)(1 + hops)), shortest path, best seed."""
    return found.groupBy("query", "doc").agg(F.sum(1.0 / ((1 + F.col("seed_rank")) * (1 + F.col("hops")))).alias("support"), F.min("hops").alias("hops"), F.min("seed_rank").alias("seed_rank"))


def rank_support(s: DataFrame, k: int, rule: str = "support") -> DataFrame:
    """Ranking by support (then hops, seed, name) or by path (seed, hops, name)."""
    if rule == "path":
        return top_k(s, ["query"], k, "seed_rank", "hops", "doc")
    return top_k(s.withColumn("_s", -F.round("support", 9)), ["query"], k, "_s", "hops", "seed_rank", "doc").drop("_s")


def co_cited(edges: DataFrame, anchors: DataFrame, k: int, cap: int = PER_NODE_CAP) -> DataFrame:
    """(anchor, doc, n, rank): what the first ``cap`` sources of an anchor point to besides it, each source's first ``cap``."""
    src = top_k(edges.select("src", "dst").distinct().join(anchors.select(F.col("anchor").alias("dst")), "dst", "left_semi"), ["dst"], cap, "src", name="_p").select(F.col("dst").alias("anchor"), "src")
    out = top_k(edges.select("src", "dst").distinct(), ["src"], cap, "dst", name="_p").select("src", F.col("dst").alias("doc"))
    n = src.join(out, "src").filter("doc <> anchor").groupBy("anchor", "doc").agg(F.count("*").alias("n"))
    return top_k(n, ["anchor"], k, "-n", "doc")


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int, k: int) -> DataFrame:
    """(a, b, path, hops, rank): the k shortest undirected simple paths of each asked pair, by (hops, path).

    Walks set out from either end and meet in the middle, so no walk is longer than half of ``max_hops``; every
    neighbour is walked to. Of the graph only the edges at nodes where a walk has come to are kept, for both ends at once.
    """
    half = both_ways(edges).select("node", "nbr")
    asked = materialise(pairs.select("a", "b").distinct())
    there, back = ([asked.select("a", "b", F.array(end).alias("walk"))] for end in ("a", "b"))
    last = F.element_at("walk", -1)
    for i in range((max_hops + 1) // 2):
        sides = [side for side, most in ((there, (max_hops + 1) // 2), (back, max_hops // 2)) if i < most]
        front = sides[0][-1].select(last.alias("node"))
        for side in sides[1:]:
            front = front.unionByName(side[-1].select(last.alias("node")))
        adj = materialise(half.join(front.distinct(), "node", "left_semi").distinct())
        for side in sides:
            step = side[-1].withColumn("node", last).join(adj, "node").filter(~F.array_contains("walk", F.col("nbr")))
            side.append(materialise(step.select("a", "b", F.concat("walk", F.array("nbr")).alias("walk"))))
    found = None
    for hops in range(1, max_hops + 1):
        x = there[(hops + 1) // 2].select("a", "b", F.element_at("walk", -1).alias("mid"), F.col("walk").alias("x"))
        y = back[hops // 2].select("a", "b", F.element_at("walk", -1).alias("mid"), F.reverse(F.slice("walk", 1, hops // 2)).alias("y"))
        met = x.join(y, ["a", "b", "mid"]).filter(~F.arrays_overlap("x", "y"))
        met = met.select("a", "b", F.array_join(F.concat("x", "y"), ">").alias("path"), F.lit(hops).alias("hops"))
        found = met if found is None else found.unionByName(met)
    return top_k(found, ["a", "b"], k, "hops", "path", name="rank")


# --- perturbations


def untyped(edges: DataFrame) -> DataFrame:
    return edges.withColumn("rel", F.lit("connected"))


def shuffle_types(edges: DataFrame, seed: int) -> DataFrame:
    """Relations dealt anew to the edges: the histogram of relations stays, who has which does not."""
    e = global_rank(edges.withColumn("_k", F.concat_ws("|", "src", "dst", "rel")), "_k").select("src", "dst", "position")
    r = global_rank(edges.select("rel", F.sha2(F.concat_ws("|", "src", "dst", "rel", F.lit(str(seed))), 256).alias("_h")), "_h", "rel").select("rel", "position")
    return e.join(r, "position").select("src", "dst", "rel")


def rewire(edges: DataFrame, seed: int, rounds: int = 10, bucket: int = 2000, share: float = 1.0, part: int = PART) -> DataFrame:
    """Degree-preserving rewiring by double-edge swaps within each relation, many at a time.

    In each round the sources of a relation are dealt anew to parts of about ``part`` edges; there, edges are dealt to
    buckets of about ``bucket`` by hash and paired, and a pair swaps its ends. A swap is undone if an end would become a
    self-loop, or an edge that exists or that another swap makes too; all edges of a source are in its part, so a round
    shuffles the edges once. In- and out-degrees per relation hold exactly after every round. With ``share`` below 1 only
    edges whose hash falls below it take part. Between rounds edges are in a scratch table, which the next one replaces.
    """
    spark = edges.sparkSession
    # Hashes come from the edges themselves, so that a seed gives the same graph however the input is partitioned; equal edges can stand for each other.
    take = F.pmod(F.xxhash64("src", "dst", "rel", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    path = scratch(spark, "rewired")
    edges.select("src", "dst", "rel", take.alias("_take")).write.parquet(path)
    n = spark.read.parquet(path).count()
    slices = max(1, n // SLICE)
    n_parts = max(1, n // part // slices)
    for r in range(rounds):
        now, old, path = spark.read.parquet(path), path, scratch(spark, "rewired")
        sizes = now.groupBy("rel").agg(F.count("*").alias("_n")).select(F.col("rel").alias("_r"), "_n", F.greatest(F.lit(1), F.floor(F.col("_n") / part)).alias("_parts"))  # a row per relation
        sizes = sizes.select("_r", "_parts", F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_parts") / bucket)).alias("_buckets"))
        sizes = sizes if slices == 1 else materialise(sizes)
        for i in range(slices):
            _round(now, sizes, seed, r, n_parts, slices, i).write.mode("append").parquet(path)
            if slices > 1:
                sweep(spark)
        discard(spark, old)
    return spark.read.parquet(path).select("src", "dst", "rel")


def _round(now: DataFrame, sizes: DataFrame, seed: int, r: int, n_parts: int, slices: int, i: int) -> DataFrame:
    """The edges of the i-th slice of the parts after round r."""
    # Windows name a hash of their keys first, which decides nearly every comparison of a sort; the keys themselves follow.
    by = lambda *keys: Window.partitionBy(F.xxhash64(*keys), *keys)
    h = F.xxhash64("src", "dst", "rel", F.lit(seed), F.lit(r))
    dealt = now.join(F.broadcast(sizes), F.col("rel").eqNullSafe(F.col("_r"))).withColumn("_part", F.xxhash64("rel", F.pmod(F.xxhash64("src", F.lit(r), F.lit(seed)), F.col("_parts"))))
    if slices > 1:
        dealt = dealt.filter(F.pmod("_part", F.lit(slices)) == i)
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("src", "dst", "rel", F.lit(r), F.lit(seed + 1)), F.col("_buckets"))).select("src", "dst", "rel", "_take", "_part", "_b").repartition(n_parts, "_part")
    w = by("_part", "rel", "_take", "_b").orderBy(h, "src", "dst")
    n = F.row_number().over(w)
    dealt = dealt.select("*", n.alias("_n"), F.lead("dst").over(w).alias("_next"), F.lag("dst").over(w).alias("_last"))
    to = F.when(F.col("_n") % 2 == 1, F.col("_next")).otherwise(F.col("_last"))
    asked = dealt.withColumn("_to", F.when(F.col("_take") & (to != F.col("src")), to)).withColumn("_pair", F.floor((F.col("_n") - 1) / 2)).drop("_n", "_next", "_last")
    # Every edge as it is, and the one it asks to be: that one must be free and asked for once.
    both = asked.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.lit(False).alias("new"), F.col("dst").alias("end")))).otherwise(F.array(F.struct(F.lit(False).alias("new"), F.col("dst").alias("end")), F.struct(F.lit(True).alias("new"), F.col("_to").alias("end"))))))
    both = both.withColumn("_new", F.col("_at.new")).withColumn("_end", F.col("_at.end")).drop("_at")
    alone = F.count("*").over(by("_part", "rel", "src", "_end")) == 1
    free = both.withColumn("_good", F.col("_new") & alone).filter("not _new or _good").drop("_end")
    k = F.count_if(F.col("_good")).over(by("_part", "rel", "_take", "_b", "_pair"))
    return free.withColumn("_k", k).filter("not _new").select("src", F.when(F.col("_k") == 2, F.col("_to")).otherwise(F.col("dst")).alias("dst"), "rel", "_take")


def sanity(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a perturbation kept: edges, in- and out-degrees per relation, self-loops, duplicates, share of edges changed.

    Either graph is read once for degrees, once for edges, and both are counted side by side; of large ones, slice by slice of nodes and edges.
    """
    slices = max(1, 2 * after.count() // SLICE)
    if slices == 1:
        return _sanity(before, after, 1, 0)
    out = None
    for i in range(slices):
        one = materialise(_sanity(before, after, slices, i))
        sweep(before.sparkSession)
        out = one if out is None else out.unionByName(one)
    return out.agg(*[F.sum(c).alias(c) for c in out.columns])


def _sanity(before: DataFrame, after: DataFrame, slices: int, i: int) -> DataFrame:
    mine = lambda *keys: F.lit(True) if slices == 1 else F.pmod(F.xxhash64(*keys), F.lit(slices)) == i
    both = before.select("src", "dst", "rel", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(after.select("src", "dst", "rel", F.lit(0).alias("x"), F.lit(1).alias("y")))
    sums = [F.sum("x").alias("x"), F.sum("y").alias("y")]
    ends = both.select("rel", "x", "y", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out"))))).filter(mine("node"))
    off = ends.groupBy("node", "rel", "out").agg(*sums).filter("x <> y").agg(F.count_if("out").alias("src_degrees_changed"), F.count_if(~F.col("out")).alias("dst_degrees_changed"))
    loop, k = F.col("src") == F.col("dst"), both.filter(mine("src", "dst")).groupBy("src", "dst", "rel").agg(*sums)
    count = lambda n, p: [F.sum(F.when(F.col(n) > 0, F.col(n))).alias(p + "edges"), F.sum(F.when(F.col(n) > 0, F.col(n) - 1)).alias(p + "duplicates"), F.count_if(loop & (F.col(n) > 0)).alias(p + "self_loops")]
    return off.crossJoin(F.broadcast(k.agg(*count("x", ""), *count("y", "new_"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("edges_kept"))))  # one row each


def topology_hash(edges: DataFrame) -> DataFrame:
    """One row: an order-free hash of all edges and of all degrees, from sums of 64-bit hashes."""
    e = edges.agg(F.sum(F.xxhash64("src", "dst", "rel").cast("decimal(38,0)")).alias("t"), F.bit_xor(F.xxhash64("rel", "dst", "src")).alias("x"))
    g = degrees(edges).agg(F.sum(F.xxhash64("node", "degree").cast("decimal(38,0)")).alias("d"))
    return e.crossJoin(F.broadcast(g)).select(F.left(F.sha2(F.concat_ws("|", "t", "x"), 256), F.lit(16)).alias("topology"), F.left(F.sha2(F.col("d").cast("string"), 256), F.lit(16)).alias("degree"))
