"""Calling a model for the rows no memo answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    """What a provider must offer; made inside the worker by a factory."""

    def available(self) -> bool: ...

    def chat_json(self, prompt: str) -> str: ...


class StubClient:
    """Answers from the prompt alone, so that everything runs offline."""

    def available(self) -> bool:
        return True

    def chat_json(self, prompt: str) -> str:
        words = [w for w in prompt.split() if w.isalpha()][-3:]
        import json

        return json.dumps({"title": " ".join(words), "category": words[0] if words else "none", "tags": words})


def is_local(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST")).rlike(r"^(localhost|127(\.\d+){3}|\[?::1\]?)$")


def ask(rows: DataFrame, make_client: Callable[[], Client], prompt: str = "prompt", timed: bool = False) -> DataFrame:
    """``rows`` with ``response`` and ``error``; a failed call is a row. If asked, also when each call ``began`` and its ``seconds``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            answers, errors, times = [], [], []
            for p in pdf[prompt]:
                began = time.time()
                try:
                    answers.append(client.chat_json(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e)[:500])
                times.append((began, time.time() - began))
            clock = {"began": [t[0] for t in times], "seconds": [t[1] for t in times]} if timed else {}
            yield pdf.assign(response=answers, error=errors, **clock)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string, error string"
    return rows.mapInPandas(run, schema + ", began double, seconds double" * timed)


def progress(answered: DataFrame) -> DataFrame:
    """One row about timed calls: how many, how many failed, the work, the time it took and how many ran at once on average."""
    elapsed = F.max(F.col("began") + F.col("seconds")) - F.min("began")
    return answered.agg(
        F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("seconds").alias("work"), elapsed.alias("elapsed"),
        F.try_divide(F.sum("seconds"), elapsed).alias("at_once"),
    )
