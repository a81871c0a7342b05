"""Answers of a chat model as a source: only what is not stored is asked, in batches, by a client that can be replaced."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


def offline(prompt: str) -> str:
    """A stand-in where there is no network: a valid, empty answer that depends on the prompt only."""
    return json.dumps({"action": "finalize", "ranked": [], "echo": hashlib.sha256(prompt.encode()).hexdigest()[:8]})


def request_key(model: str, version: str):  # noqa: ANN201
    """Key of a request: hash of model, prompt version and prompt."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(version), "prompt"), 256)


def ask(prompts: DataFrame, stored: DataFrame, model: str, version: str, client: Client = offline, repairs: int = 1) -> DataFrame:
    """(key, prompt, response) of every prompt: stored ones from ``stored`` (key, response), others from the client.

    An answer that is no JSON is asked for again ``repairs`` times; what is still none comes out as it is. Append the
    rows that are not stored yet, so that a lost job asks nothing twice.
    """
    keyed = prompts.select("prompt").distinct().withColumn("key", request_key(model, version))
    held = keyed.join(stored.select("key", "response"), "key")
    missing = keyed.join(stored.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                r = client(p)
                for _ in range(repairs):
                    try:
                        json.loads(r)
                        break
                    except ValueError:
                        r = client(p + "\nAnswer with JSON only.")
                out.append(r)
            yield b.assign(response=out)[["key", "prompt", "response"]]

    return held.select("key", "prompt", "response").unionByName(missing.select("key", "prompt").mapInPandas(run, "key string, prompt string, response string"))


def append_missing(prompts: DataFrame, path: str, model: str, version: str, client: Client = offline) -> None:
    """Asks what the store at ``path`` (key, response) has no answer to and appends the answers; nothing is asked twice."""
    spark = prompts.sparkSession
    stored = spark.read.parquet(path)
    keyed = prompts.select("prompt").distinct().withColumn("key", request_key(model, version))
    missing = keyed.join(stored.select("key"), "key", "left_anti").select("prompt")
    ask(missing, stored.limit(0), model, version, client).select("key", "response").write.mode("append").parquet(path)
