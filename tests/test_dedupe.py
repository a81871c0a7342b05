import datetime
import random

from heronry.operators import dedupe as D
from heronry.streaming import messages as M

IDS = ["run_id", "model"]
SCHEMA = "delivery_id bigint, received_at timestamp, run_id string, model string, payload string, _other int"


def rows(n, seed):
    rng = random.Random(seed)
    t0 = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        run = rng.choice([None, "", "R1", " r1\t", "r2", "hot", "HOT ", "hot"])
        out.append((i, rng.choice([None, t0 + datetime.timedelta(seconds=rng.randrange(20))]), run, rng.choice([None, "m", " M"]), "x" * rng.randrange(3), i))
    rng.shuffle(out)
    return out


def norm(x):
    return None if x is None else x.strip().lower()


def expected(data):
    best = {}
    for r in data:
        k, v = (norm(r[2]), norm(r[3])), (r[1] is None, r[1] or datetime.datetime.min, r[0])
        best[k] = min(best.get(k, v), v)
    return {v[2] for v in best.values()}


def test_repeats(spark):
    data = rows(400, 1)
    df = spark.createDataFrame(data, SCHEMA)
    keep = expected(data)
    assert {r[0] for r in D.repeated(df, IDS, "received_at", "delivery_id").collect()} == {r[0] for r in data} - keep
    kept = D.kept(df, IDS, "received_at", "delivery_id").collect()
    assert {r.delivery_id for r in kept} == keep and len(kept) == len(keep) and kept[0]._other is not None


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert D.repeated(df, IDS, "received_at", "delivery_id").collect() == []


def test_batches_add_each_message_once(spark):
    data = rows(120, 2)
    store = spark.createDataFrame([], SCHEMA)
    for a in (0, 40, 80, 80):  # the last batch comes twice
        batch = spark.createDataFrame(data[a : a + 40], SCHEMA)
        store = spark.createDataFrame(store.unionByName(D.admit(batch, store.select(*D.identity(store, IDS)), IDS, "received_at", "delivery_id")).collect(), SCHEMA)
    got = [(norm(r.run_id), norm(r.model)) for r in store.collect()]
    assert len(got) == len(set(got)) and set(got) == {(norm(r[2]), norm(r[3])) for r in data}


def test_streams(spark, tmp_path):
    data = [r for r in rows(90, 3) if r[1] is not None]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.admit_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), IDS, "received_at", "delivery_id")
    q.awaitTermination(120)
    got = [(norm(r.run_id), norm(r.model)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {(norm(r[2]), norm(r[3])) for r in data}
    assert len(got) == len(set(got)) and set(got) == want
    q = M.drop_repeats(stream, IDS, "received_at").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(norm(r.run_id), norm(r.model)) for r in spark.sql("select * from once").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    q = M.windowed_counts(stream, "received_at", "model").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.sql("select * from counted").collect()) == len(data)
