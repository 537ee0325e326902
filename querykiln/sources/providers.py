"""Providers stand where a language model or a remote service would be called."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TableProvider:
    """Answers from a table (prompt_hash, attempt, raw); prompt_hash is sha2-256 of the prompt."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answer(self, prompts: DataFrame, attempt: int = 0) -> DataFrame:
        """(prompt, raw); raw is null where the table has no answer."""
        own = self.table.where(F.col("attempt") == attempt).select("prompt_hash", "raw")
        return prompts.select("prompt", F.sha2("prompt", 256).alias("prompt_hash")).join(own, "prompt_hash", "left").select("prompt", "raw")


class FunctionProvider:
    """Answers from ``make()``'s function over a list of prompts, one per partition, ``batch`` prompts a call."""

    def __init__(self, make: Callable[[], Callable[[list[str], int], list[str]]], batch: int = 256):
        self.make, self.batch = make, batch

    def answer(self, prompts: DataFrame, attempt: int = 0) -> DataFrame:
        make, batch = self.make, self.batch

        def run(frames: Iterator):
            call = make()
            for pdf in frames:
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch][["prompt"]]
                    yield part.assign(raw=call(part["prompt"].tolist(), attempt))

        return prompts.select("prompt").mapInPandas(run, "prompt string, raw string")


RETRIED = (429, 500, 502, 503, 504)


def with_retries(call: Callable[[], tuple[int, object]], retries: int = 5, first: float = 0.5, most: float = 16.0, sleep=time.sleep):
    """The body of the first answer that isn't a passing failure; waits double up to ``most`` seconds.

    Other failures raise at once, as do exceptions of the call itself.
    """
    wait = first
    for left in range(retries, -1, -1):
        status, body = call()
        if status < 400:
            return body
        if status not in RETRIED or not left:
            raise RuntimeError(f"status {status}")
        sleep(wait)
        wait = min(most, 2 * wait)
