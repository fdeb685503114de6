"""Calls to model servers, made on the executors in Arrow batches by clients that the caller brings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.paged import redacted

#: Takes the prompts of a call, and a key if its provider has keys, and gives one answer each, or null; must be picklable.
Client = Callable[..., Sequence[Any]]


@dataclass
class Provider:
    """A client and how it is called: prompts a call, calls a second in each task (0: no limit), seconds that a call may take (0: any),
    and keys, which the calls of a task take in turn."""

    name: str
    client: Client
    batch: int = 32
    per_second: float = 0
    timeout: float = 0
    keys: Sequence[str] = ()


class _Caller:
    """One provider within one task."""

    def __init__(self, provider: Provider, task: int):
        self.provider, self.ordinal = provider, task  # tasks begin with different keys
        self.tokens, self.at, self.pool = 1.0, time.monotonic(), None

    def _wait(self) -> None:
        """A token bucket that holds one call: pauses are not saved up."""
        rate = self.provider.per_second
        if not rate:
            return
        now = time.monotonic()
        self.tokens, self.at = min(1.0, self.tokens + (now - self.at) * rate), now
        if self.tokens < 1:
            time.sleep((1 - self.tokens) / rate)
            self.tokens, self.at = 1.0, time.monotonic()
        self.tokens -= 1

    def __call__(self, prompts: list[str]) -> Sequence[Any]:
        self._wait()
        p = self.provider
        key = [p.keys[self.ordinal % len(p.keys)]] if p.keys else []
        self.ordinal += 1
        if not p.timeout:
            return p.client(prompts, *key)
        self.pool = self.pool or ThreadPoolExecutor(1)
        try:
            return self.pool.submit(p.client, prompts, *key).result(p.timeout)
        except TimeoutError:
            # The call is left to itself; the next one gets a thread of its own.
            self.pool.shutdown(wait=False)
            self.pool = None
            raise TimeoutError(f"no answer in {p.timeout} seconds") from None


def ask_chain(rows: DataFrame, prompt: str, providers: Sequence[Provider], answer: str = "response", kind: str = "string", valid: Callable[[Any], bool] | None = None) -> DataFrame:
    """rows with the first valid answer to the prompt column, of the type `kind` (array<float> for embeddings), and: provider, who
    gave it; error, why the last one asked failed, without URLs' queries; asked, who was asked, in turn.

    A provider is asked only for the rows for which all before it failed. A call that raises, takes too long or gives answers of the
    wrong number fails for all its prompts; an answer that is null or not valid fails for its own. Null prompts are not asked. A job
    never fails for a call. A task that is run again asks again.
    """
    schema = rows.select("*", F.lit(None).cast(kind).alias(answer), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("asked")).schema
    type_ = to_arrow_type(schema[answer].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        callers = [_Caller(p, TaskContext.get().partitionId()) for p in providers]
        for batch in batches:
            prompts = batch.column(prompt).to_pylist()
            answers: list[Any] = [None] * len(prompts)
            names: list[str | None] = [None] * len(prompts)
            errors: list[str | None] = [None] * len(prompts)
            asked: list[list[str]] = [[] for _ in prompts]
            open_ = [k for k, x in enumerate(prompts) if x is not None]
            for caller in callers:
                name, size = caller.provider.name, caller.provider.batch
                for at in range(0, len(open_), size):
                    part = open_[at : at + size]
                    for k in part:
                        asked[k].append(name)
                    try:
                        for k, x in zip(part, list(caller([prompts[k] for k in part])), strict=True):
                            if x is None or (valid and not valid(x)):
                                errors[k] = f"{name}: no valid answer"
                            else:
                                answers[k], names[k], errors[k] = x, name, None
                    except Exception as e:  # noqa: BLE001 - whatever a client raises
                        for k in part:
                            answers[k], names[k], errors[k] = None, None, redacted(f"{name}: {type(e).__name__}: {e}")
                open_ = [k for k in open_ if names[k] is None]
            more = [pa.array(answers, type_), pa.array(names, pa.string()), pa.array(errors, pa.string()), pa.array(asked, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def ask(rows: DataFrame, prompt: str, client: Client, answer: str = "response", batch: int = 32, kind: str = "string") -> DataFrame:
    """rows with one client's answers, and `error`; see ask_chain."""
    return ask_chain(rows, prompt, [Provider("client", client, batch)], answer, kind).drop("provider", "asked")


def embed(rows: DataFrame, text: str, provider: Provider, vector: str = "embedding") -> DataFrame:
    """rows with the vector that a provider gives for the text column, and `error`."""
    return ask_chain(rows, text, [provider], vector, "array<float>", valid=len).drop("provider", "asked")
