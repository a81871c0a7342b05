import random

from pyspark.sql import functions as F

from heronry.operators import temporal as T

DAY = 86_400_000_000


def brute(revs, entity, at):
    known = [(t, r) for e, t, r in revs if e is not None and e == entity and t is not None and at is not None and t <= at]
    return max(known)[1] if known else None


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    revs = [(rng.choice("abc"), rng.choice([None, rng.randrange(-3000, 30000) * DAY // 3]), n) for n in range(300)]
    revs += [("far", -(1 << 61), 1), ("far", (1 << 61), 2), ("x", 0, 7), ("x", 0, 9), ("x", 0, 9), (None, 5, 1)]
    events = {(n, rng.choice(["a", "b", "c", "none", None]), rng.choice([None, rng.randrange(-4000, 31000) * DAY // 3])) for n in range(400)}
    events |= {(1000, "far", 5), (1001, "far", (1 << 61) + 1), (1002, "far", -(1 << 62)), (1003, "x", 0), (1004, "x", -1)}
    events |= {(2000 + n, e, t) for n, (e, t, _) in enumerate(revs[:50])}  # on the boundaries
    r = spark.createDataFrame(revs, "e string, t bigint, rev int")
    ev = spark.createDataFrame(sorted(events, key=repr), "k bigint, e string, at bigint")
    got = {(x.k, x.e, x.at): x.attribute for x in T.as_of_join(ev, T.validity(r, "e", "t", "rev"), "e", "at", ["k"]).collect()}
    assert len(got) == len(events)
    for k, e, at in events:
        assert got[k, e, at] == brute(revs, e, at), (k, e, at)


def test_overlapping_intervals_latest_start_wins(spark):
    iv = spark.createDataFrame([("a", 0, 100, 1), ("a", 50, 60, 2), ("a", 50, 55, 3), ("a", 70, 70, 4)], "entity string, valid_from bigint, valid_to bigint, attribute int")
    ev = spark.createDataFrame([(1, "a", 49), (2, "a", 50), (3, "a", 55), (4, "a", 60), (5, "a", 70), (6, "a", 100)], "k bigint, e string, at bigint")
    got = {r.k: r.attribute for r in T.as_of_join(ev, iv, "e", "at", ["k"]).collect()}
    assert got == {1: 1, 2: 3, 3: 2, 4: 1, 5: 1, 6: None}


def test_names_do_not_clash(spark):
    r = spark.createDataFrame([("a", 3, 1)], "entity string, valid_from bigint, attribute int")
    ev = spark.createDataFrame([(7, "a", 5, 1)], "valid_from bigint, entity string, _at bigint, _node int")
    got = T.as_of_join(ev, T.validity(r, "entity", "valid_from", "attribute"), "entity", "_at", ["valid_from", "_node"]).collect()
    assert [tuple(x) for x in got] == [(7, 1, "a", 5, 1)] and got[0].__fields__ == ["valid_from", "_node", "entity", "_at", "attribute"]


def test_empty_tables(spark):
    r = spark.createDataFrame([], "e string, t bigint, rev int")
    ev = spark.createDataFrame([(1, "a", 5)], "k bigint, e string, at bigint")
    assert [x.attribute for x in T.as_of_join(ev, T.validity(r, "e", "t", "rev"), "e", "at", ["k"]).collect()] == [None]
    assert T.as_of_join(ev.limit(0), T.validity(r, "e", "t", "rev"), "e", "at", ["k"]).collect() == []


def test_nodes_cover_exactly_once(spark):
    """Every leaf of an interval is in exactly one covering node, and its neighbours outside in none."""
    rng, leaf, rows = random.Random(9), 1 << T.LEAF, []
    for _ in range(300):
        s = rng.randrange(-8 * 10**15, 7 * 10**15)
        e = s + rng.randrange(1, rng.choice([5, leaf, leaf * 9, 10**15]) + 1)
        rows += [(s, e, p) for p in {s, e - 1, (s + e) // 2, s - leaf, e - 1 + leaf}]
    df = spark.createDataFrame(rows, "s bigint, e bigint, p bigint")
    for r in df.select("*", T.covering_nodes(df.s, df.e).alias("c"), T.enclosing_nodes(df.p).alias("n")).collect():
        assert len(set(r.c)) == len(r.c) <= 2 * 7 * len(T.LEVELS)
        assert len(set(r.c) & set(r.n)) == (1 if r.s <= r.p < r.e else 0)


def test_hot_entities_are_spread_and_nothing_is_hashed_whole(spark):
    """An entity with more events than a part holds is spread; intervals are sorted, and partitions not merged before nodes are spelt out."""
    rng = random.Random(6)
    revs = [("hot", rng.randrange(0, 30000) * DAY, n) for n in range(80)] + [("cold", 5 * DAY, 1)]
    events = [(n, "hot" if n % 9 else rng.choice(["cold", "none", None]), rng.randrange(-10, 31000) * DAY) for n in range(500)]
    r, ev = spark.createDataFrame(revs, "e string, t bigint, rev int"), spark.createDataFrame(events, "k bigint, e string, at bigint")
    out = T.as_of_join(ev, T.validity(r, "e", "t", "rev"), "e", "at", ["k"], hot=50)
    got = {x.k: x.attribute for x in out.collect()}
    assert got == {k: brute(revs, e, at) for k, e, at in events}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and plan.count("REPARTITION_BY_NUM") >= 2


def test_last_known_without_pairs(spark):
    """The same as of a search through all revisions, for a hot entity too, of which revisions are not held against events."""
    rng = random.Random(12)
    revs = [("hot", rng.randrange(0, 3000) * DAY // 7, n) for n in range(300)] + [("cold", 5 * DAY, 1), ("cold", 5 * DAY, 3), ("blank", DAY, None), ("blank", 9 * DAY, 4)]
    events = [(n, rng.choice(["hot", "hot", "cold", "blank", "none"]), rng.randrange(-10, 3100) * DAY // 7) for n in range(400)] + [(400, "cold", 5 * DAY), (401, "blank", DAY)]
    r, ev = spark.createDataFrame(revs, "e string, t bigint, rev int"), spark.createDataFrame(events, "k bigint, e string, t bigint")
    out = T.last_known(ev, r, "e", "t", "rev")
    assert {x.k: x.last_known for x in out.collect()} == {k: brute(revs, e, at) for k, e, at in events}
    keys = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert keys and all("_slot" in x for x in keys)


def test_reverification_finds_what_is_wrong(spark, tmp_path, monkeypatch):
    """q04 pairs no revisions with events, and counts what an as-of join gets wrong."""
    from heronry.plans import agents

    spark.createDataFrame([(1, "x", "2020-05-01T00:00:00Z", "f"), (2, "x", "2021-05-01T00:00:00Z", "f"), (3, "y", "2021-05-01T00:00:00Z", "f")], "rec_id bigint, source_paper_id string, as_of string, feed string").write.parquet(str(tmp_path / "frozen_ids.parquet"))
    spark.createDataFrame([("paper:x", 1, "2019-01-01T00:00:00Z", "f"), ("paper:x", 2, "2021-01-01T00:00:00Z", "f")], "obj_id string, revision int, available_at string, feed string").write.parquet(str(tmp_path / "temporal_objects.parquet"))
    spark.createDataFrame([("f", "UTC", "ymd")], "feed string, tz_name string, date_order string").write.parquet(str(tmp_path / "feeds.parquet"))
    df = agents.q04_reverification(spark, str(tmp_path))
    assert [tuple(x) for x in df.collect()] == [(0, 0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in "".join(x for x in plan.split("\n") if "Join" in x and "_node" not in x)
    wrong = lambda ev, *_: ev.withColumn("attribute", F.when(F.col("rec_id") == 3, 7).when(F.col("rec_id") == 2, 1).otherwise(1))
    monkeypatch.setattr(T, "as_of_join", wrong)
    assert [tuple(x) for x in agents.q04_reverification(spark, str(tmp_path)).collect()] == [(1, 2)]
