import json

from heronry.operators import flatten as X

BODIES = [
    {"tool_calls": [{"tool": "search", "arguments": {"query": "a \"b\" é"}, "returned_ids": ["1", "2v1", "1"]}, {"tool": "open", "arguments": None, "returned_ids": None}]},
    {"tool_calls": [{"tool": "search", "arguments": json.dumps({"query": "q", "top": [1, {"x": 2}]}), "returned_ids": [{"id": "7", "rank": 1}, {"rank": 2}, None, "8"]}], "valid": True},
    {"turns": [{"turn": 1, "tool_calls": [{"tool": "a", "returned_ids": []}]}, {"tool_calls": None}, {}, {"tool_calls": [{"tool": None, "arguments": {"query": None}, "returned_ids": ["9"]}]}, None]},
    {"tool_calls": None}, {"tool_calls": []}, {"turns": []}, {}, [], "text", 5, None,
]
EXTRA = [None, "", "  ", "{", '{"tool_calls": [{"tool": "x"', '{"tool_calls": []} tail', json.dumps(BODIES[0]) + " x"]


def expected(key, body):
    try:
        o = json.loads(body)
    except (TypeError, ValueError):
        return []
    if not isinstance(o, dict):
        return []
    calls = list(o.get("tool_calls") or []) + [c for t in o.get("turns") or [] for c in ((t or {}).get("tool_calls") or [])]
    out = []
    for n, c in enumerate(calls, 1):
        a = c.get("arguments")
        a = json.loads(a) if isinstance(a, str) else a or {}
        ids = [x.get("id", "") if isinstance(x, dict) else x for x in c.get("returned_ids") or [] if x is not None]
        for j, x in enumerate(ids or [""], 1):
            out.append((key, n, j if ids else 0, c.get("tool") or "", a.get("query") or "", x))
    return out


def test_rows(spark):
    bodies = [json.dumps(b, ensure_ascii=False) for b in BODIES] + EXTRA
    bodies.append(json.dumps({"tool_calls": [{"tool": "t", "returned_ids": [str(i) for i in range(3000)]}], "pad": "x" * 200_000}))
    data = [(i, b, "clash", 1) for i, b in enumerate(bodies)] * 2
    df = spark.createDataFrame(data, "delivery_id bigint, body string, tool string, ids int")
    got = sorted(map(tuple, X.ids_table(df.drop("tool"), ["delivery_id"]).collect()))
    want = sorted(r for i, b in enumerate(bodies) for r in expected(i, b) * 2)
    assert got == want
    calls = X.calls_table(df, ["delivery_id"]).collect()
    assert len(calls) == len({(r[0], r[1]) for r in want}) * 2
    assert {(r.delivery_id, r.paper_id) for r in X.returned_ids(df, ["delivery_id"]).collect()} == {(r[0], r[5]) for r in want if r[2]}


def test_empty(spark):
    df = spark.createDataFrame([], "delivery_id bigint, body string")
    assert X.ids_table(df, ["delivery_id"]).collect() == []
