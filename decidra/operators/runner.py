"""Resumable prediction runs: the last record of an id counts, and what has no success is still to do."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: its last in `order`. A max over structs, so sums are partial and no key is sorted."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, "_last.*")


def todo(items: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a prediction, or with an error only."""
    return items.join(predictions.filter(F.col("error").isNull()).select(*keys).distinct(), keys, "left_anti")


def run_predictions(items: DataFrame, predict: Callable[[dict], dict], schema: str, id_col: str = "item_id") -> DataFrame:
    """Rows of `predict` over items, in Arrow batches; an exception becomes the row's `error`."""
    names = [f.split()[0] for f in schema.split(",")]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item in batch.to_dict("records"):
                try:
                    row = {**predict(item), "error": None}
                except Exception as error:  # a failing item must not end the run
                    row = {"error": f"{type(error).__name__}: {error}"}
                rows.append({id_col: item[id_col], **row})
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)  # a batch of errors only has no answers

    return items.mapInPandas(per_batch, schema)


def http_predictor(url: str, model: str, api_key: str | None = None, usd_per_mtok: float = 0.042, timeout_s: float = 120.0) -> Callable[[dict], dict]:
    """A `predict` for run_predictions that asks a server: state and questions (JSON) go out, answers come back with the time and the cost by input tokens."""

    def predict(item: dict) -> dict:
        body = {"model": model, "state": json.loads(item["state"]), "questions": json.loads(item["questions"])}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        begun = time.perf_counter()
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout_s) as reply:
            said = json.loads(reply.read())
        took, used = time.perf_counter() - begun, said.get("usage") or {}
        return {"answers": json.dumps(said["answers"], ensure_ascii=False), "latency_s": took, "cost_usd": used.get("input_tokens", 0) * usd_per_mtok / 1e6 if used else None}

    return predict


HTTP = "item_id string, answers string, latency_s double, cost_usd double, error string"


def scored_prompts(prompts: DataFrame, score: Callable[[list[str], list[list[str]]], list[list[float]]], prompt: str = "prompt", labels: str = "labels") -> DataFrame:
    """prompts with logits: a backend's scores of each prompt's answer labels, asked for in batches."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.astype(object).assign(logits=[list(map(float, x)) for x in score(batch[prompt].tolist(), [list(x) for x in batch[labels]])])

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", logits array<double>"
    return prompts.mapInPandas(per_batch, schema)
