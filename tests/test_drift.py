import datetime
import json

from heronry.operators import drift as X

T0 = datetime.datetime(2024, 1, 1)


def run(spark, files):
    """files: list of (stream, order, {key: body})"""
    fs = [(i, s, T0 + datetime.timedelta(days=o)) for i, (s, o, _) in enumerate(files)]
    rs = [(f"{i}", i, k, b if isinstance(b, (str, type(None))) else json.dumps(b)) for i, (_, _, recs) in enumerate(files) for k, b in recs.items()]
    records = spark.createDataFrame([(int(a) * 100 + n, f, k, b) for n, (a, f, k, b) in enumerate(rs)], "rec_id bigint, file_id bigint, rec_key string, body string")
    table = spark.createDataFrame(fs, "file_id bigint, stream_name string, written_at timestamp")
    return records, table, sorted(map(tuple, X.changes(records, table).collect()))


def test_kinds(spark):
    _, _, got = run(spark, [
        ("s", 2, {"1": {"a": 1, "c": "x", "calls": [{"t": 1}, {"t": None}, {"t": 3}]}, "3": {"a": 2}}),  # file 0 comes second
        ("s", 1, {"1": {"b": 1.0, "c": "x", "calls": [{"u": 1}, {}, {"u": 3}]}, "2": {"b": 5}}),
        ("s", 3, {"1": {"a": "1", "d": True, "calls": []}, "9": {"c": None}}),
        ("t", 1, {"1": {"z": 1}}),
    ])
    assert got == sorted([
        (0, "renamed", "b", "a"), (0, "renamed", "calls.u", "calls.t"),
        (2, "retyped", "a", "a"), (2, "removed", "c", ""), (2, "removed", "calls.t", ""), (2, "added", "", "d"),
    ])


def test_no_rename_without_equal_restated_values(spark):
    _, _, got = run(spark, [("s", 1, {"1": {"a": 1}, "2": {"a": 2}}), ("s", 2, {"1": {"b": 1}, "2": {"b": 3}})])
    assert got == [(1, "added", "", "b"), (1, "removed", "a", "")]
    _, _, got = run(spark, [("s", 1, {"1": {"a": 1}}), ("s", 2, {"2": {"b": 1}})])
    assert got == [(1, "added", "", "b"), (1, "removed", "a", "")]
    _, _, got = run(spark, [("s", 1, {"1": {"a": 1}}), ("s", 2, {"1": {"b": "1"}})])
    assert got == [(1, "added", "", "b"), (1, "removed", "a", "")]


def test_equal_values_are_paired_one_to_one(spark):
    _, _, got = run(spark, [("s", 1, {"1": {"a": 1, "b": 1}}), ("s", 2, {"1": {"x": 1, "y": 1}})])
    assert got == [(1, "renamed", "a", "x"), (1, "renamed", "b", "y")]


def test_bad_bodies_repeats_and_empty_tables(spark):
    records, files, got = run(spark, [("s", 1, {"1": {"a": 1}, "2": None, "3": "{bad", "4": "[1]"}), ("s", 2, {"1": {"a": 1, "t": "x" * 50_000}})])
    assert got == [(1, "added", "", "t")]
    assert sorted(map(tuple, X.changes(records.unionAll(records), files).collect())) == got
    assert X.changes(records.limit(0), files).collect() == [] and X.changes(records, files.limit(0)).collect() == []


def test_unified(spark):
    records, files, _ = run(spark, [("s", 1, {"1": {"a": 1, "n": 2, "c": [{"k": "x"}]}, "2": {"a": 3}}), ("s", 2, {"1": {"b": 1, "n": "2", "c": [{"k": "x"}]}, "5": None})])
    t = X.unified(records, files, X.changes(records, files))
    rows = {(r.file_id, r.rec_key): r for r in t.collect()}
    assert set(t.columns) == {"rec_id", "stream_name", "file_id", "rec_key", "conflicts", "a", "n", "c__k"}
    assert rows[1, "1"].a == 1.0 and rows[1, "1"].n == "2" and rows[0, "1"].n == "2" and rows[0, "1"].c__k == '["x"]'
    assert rows[1, "5"].a is None and rows[0, "2"].n is None


def test_no_value_is_lost_where_a_record_has_two_fields_of_one_name(spark):
    records, files, got = run(spark, [
        ("a", 1, {"1": {"p_adj": 0.1}}), ("a", 2, {"1": {"p_holm": 0.1}}), ("a", 3, {"2": {"p_adj": 0.2, "p_holm": 0.3}}),
        ("b", 1, {"1": {"p_adj": 0.5, "p_holm": 0.7}}), ("b", 2, {"1": {"p_adj": 0.5, "p_holm": 0.7}}),
    ])
    assert (1, "renamed", "p_adj", "p_holm") in got
    rows = {(r.file_id, r.rec_key): r for r in X.unified(records, files, X.changes(records, files)).collect()}
    assert (rows[3, "1"].p_adj, rows[3, "1"].p_holm, rows[3, "1"].conflicts) == (0.5, 0.7, [])  # no renames in this stream
    kept = rows[2, "2"]
    assert {kept.p_adj, kept.p_holm} == {0.2, 0.3} and kept.conflicts in (["p_adj"], ["p_holm"])
    one = "p_holm" if kept.conflicts == ["p_adj"] else "p_adj"
    assert rows[0, "1"][one] == rows[1, "1"][one] == 0.1 and kept[one] == {"p_holm": 0.3, "p_adj": 0.2}[one]


def test_more_fields_than_columns(spark, monkeypatch):
    records, files, _ = run(spark, [("s", 1, {"1": {f"f{i}": i for i in range(30)}}), ("s", 2, {"1": {"g0": 0} | {f"f{i}": i for i in range(1, 30)}})])
    monkeypatch.setattr(X, "MAX_FIELDS", 10)
    rows = {r.file_id: r for r in X.unified(records, files, X.changes(records, files)).collect()}
    assert rows[0].fields == {f"f{i}": str(i) for i in range(30)} == rows[1].fields


def test_kinds_are_those_of_the_leaves():
    for body in ('{"a": [{"b": 1}, 2, null], "c": {"d": [], "e": {}}, "f": [{"b": "x"}, {"b": true}], "g": null, "h": [null], "i": [[1]]}', "[1]", "null", "{bad", None):
        found = {}
        if X._parsed(body) is not None:
            X._kinds(X._parsed(body), "", found)
        assert found == {k: v[0] for k, v in X._record(body).items()}


def test_islands(spark):
    records, files, _ = run(spark, [("s", 1, {"1": {"a": 1}}), ("s", 2, {"1": {"b": 1}}), ("s", 3, {"1": {"a": 1}})])
    spans = X.islands(X.catalogue(X.footers(records), X.file_order(files)))
    assert sorted((r.path, r.first_seq, r.last_seq) for r in spans.collect()) == [("a", 1, 1), ("a", 3, 3), ("b", 2, 2)]
