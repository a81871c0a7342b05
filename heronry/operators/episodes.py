"""Episode rows of tool-using agents: read, assemble, summarise, audit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY = "struct<seed:bigint,n_tool_calls:int,ranked:array<string>,valid:boolean,latency_ms:bigint,anytime:map<string,struct<top5:array<string>,gold_observed:boolean,metrics:map<string,double>>>>"


def read_episodes(episodes: DataFrame) -> DataFrame:
    """Episode columns of valid bodies beside the message's own; invalid bodies are left out."""
    e = episodes.withColumn("e", F.from_json("body", BODY)).filter("e.n_tool_calls is not null")
    return e.select("delivery_id", F.lower(F.trim("run_id")).alias("run_id"), F.lower(F.trim("model")).alias("model"), "condition", "instance_id", "e.*")


def anytime(rows: DataFrame) -> DataFrame:
    """(delivery_id, model, condition, milestone, gold_observed, mrr, top1): the snapshots that were made, none imputed."""
    s = rows.select("delivery_id", "model", "condition", F.explode("anytime").alias("milestone", "s"))
    return s.select("delivery_id", "model", "condition", F.col("milestone").cast("int").alias("milestone"), "s.gold_observed", F.element_at("s.metrics", "mrr").alias("mrr"), F.element_at("s.metrics", "top1").alias("top1"))


def steps(calls: DataFrame) -> DataFrame:
    """Counters of each episode from its call rows: calls, per-tool uptake, first retrieval, ids shown."""
    return calls.groupBy("delivery_id").agg(
        F.count("*").alias("n_calls"), F.sum("n_ids").alias("ids_shown"), F.count_if(F.col("n_ids") == 0).alias("empty_calls"),
        F.min(F.when(F.col("n_ids") > 0, F.col("call_no"))).alias("first_hit_call"), F.count_distinct("tool").alias("tools_used"),
    )


def failure(valid: Column, shown: Column, ranked: Column, errors: Column) -> Column:
    """Category of an episode; the first that applies counts."""
    return F.when(errors > 0, "tool_error").when(~valid, "invalid_answer").when(shown == 0, "nothing_observed").when(F.size(ranked) == 0, "empty_answer").otherwise("answered")


def parse_action(text: Column, verbs: list[str]) -> Column:
    """struct(kind, verb, argument): a final answer, a known verb, or malformed."""
    obj = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    verb = F.get_json_object(obj, "$.action")
    kind = F.when(F.try_parse_json(F.nullif(obj, F.lit(""))).isNull() | verb.isNull(), "malformed").when(verb == "finalize", "final").when(verb.isin(*verbs), "call").otherwise("unknown_verb")
    return F.struct(kind.alias("kind"), F.coalesce(verb, F.lit("")).alias("verb"), F.coalesce(F.get_json_object(obj, "$.query"), F.lit("")).alias("argument"))


def validate_call(args: Column, most: int = 20, hops: int = 4) -> Column:
    """Arguments in bounds: k at most ``most``, max_hops at most ``hops``."""
    return F.struct(F.least(F.coalesce(args["k"], F.lit(10)), F.lit(most)).alias("k"), F.least(F.coalesce(args["max_hops"], F.lit(2)), F.lit(hops)).alias("max_hops"))


def validate_answer(ranked: Column, observed: Column, n: int) -> Column:
    """Problem of an answer: must be ``n`` distinct ids, all of them observed; '' if it is fine."""
    return (
        F.when(F.size(ranked) != F.size(F.array_distinct(ranked)), "repeated").when(F.size(ranked) < n, "short_answer")
        .when(F.size(F.array_except(ranked, observed)) > 0, "unobserved").otherwise("")
    )


def scored_list(ranked: Column, adds: Column, observed: Column, k: int) -> Column:
    """What is scored: the ranking, then what was added to the review, then what was observed, to k."""
    return F.slice(F.array_distinct(F.concat(ranked, adds, observed)), 1, k)


class MockPolicy:
    """Answers by a fixed script of actions."""

    def __init__(self, script: list[dict]) -> None:
        self.script, self.at = script, 0

    def act(self, observation: list[str]) -> dict:
        self.at += 1
        return self.script[self.at - 1] if self.at <= len(self.script) else {"action": "finalize", "ranked": observation[:5]}


class ReplayPolicy(MockPolicy):
    """Answers as a recorded episode did."""

    def __init__(self, calls: list[dict], ranked: list[str]) -> None:
        super().__init__([*calls, {"action": "finalize", "ranked": ranked}])


def run_loop(policy: MockPolicy, tools: dict[str, Callable[[dict], list[str]]], max_turns: int = 16, max_calls: int = 8, budget: int = 6000) -> dict:
    """One bounded episode: calls are dispatched until an answer, the call limit or the turn limit.

    A call the condition does not offer is blocked, and counts as a call; an observation that exceeds the token budget
    is skipped, not the end; after the last call an answer is forced from what was observed.
    """
    observed: list[str] = []
    log, used, calls = [], 0, 0
    for _ in range(max_turns):
        action = policy.act(observed)
        if action.get("action") == "finalize":
            ranked = [x for x in dict.fromkeys(action.get("ranked", [])) if x in observed]
            return {"ranked": ranked, "calls": calls, "observed": observed, "log": log, "forced": False}
        if calls >= max_calls:
            break
        calls += 1
        tool = tools.get(action.get("action", ""))
        ids = tool(action) if tool else []
        cost = max(1, sum(len(x) for x in ids) // 4)
        accepted = tool is not None and used + cost <= budget
        if accepted:
            used += cost
            observed += [x for x in ids if x not in observed]
        log.append({"tool": action.get("action", ""), "n": len(ids) if accepted else 0, "blocked": tool is None})
    return {"ranked": observed[:5], "calls": calls, "observed": observed, "log": log, "forced": True}


def replay_episodes(calls: DataFrame, ranked: DataFrame, **limits: int) -> DataFrame:
    """Runs the loop over recorded episodes: (delivery_id, calls, n_observed, n_ranked, forced).

    ``limits`` are those of ``run_loop``. ``calls`` has (delivery_id, call_no, tool, paper_ids); an episode's calls, bounded by its turn limit, are gathered
    in one row before the loop, so that no group is handed to a task.
    """
    rows = calls.groupBy("delivery_id").agg(F.array_sort(F.collect_list(F.struct("call_no", "tool", "paper_ids"))).alias("calls")).join(ranked, "delivery_id")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for i, cs, r in zip(b["delivery_id"], b["calls"], b["ranked"], strict=True):
                held = [list(c["paper_ids"]) for c in cs]
                script = [{"action": c["tool"], "n": n} for n, c in enumerate(cs)]
                e = run_loop(ReplayPolicy(script, list(r) if r is not None else []), {c["tool"]: lambda a, held=held: held[a["n"]] for c in cs}, **limits)
                out.append((i, e["calls"], len(e["observed"]), len(e["ranked"]), e["forced"]))
            yield pd.DataFrame(out, columns=["delivery_id", "calls", "n_observed", "n_ranked", "forced"])

    return rows.mapInPandas(run, "delivery_id bigint, calls int, n_observed int, n_ranked int, forced boolean")
