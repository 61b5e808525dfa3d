"""Models behind guards (E1-E4, X5): embedders and language models as vectorised functions.

A model is a Python object that is shipped to the workers and used batch by batch; retries happen inside the function, never
by Spark's task retry.  A circuit breaker is per worker process.  Effects are at least once: write a stage's result before
the next reads it.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ModelError

# Retries, first wait in seconds, least length of a response; failures and seconds of the breaker.
RETRIES, BACKOFF, LEAST = 2, 1.0, 10
FAILURES, TIMEOUT = 5, 60.0
#: Limits of a call.
MAX_TOKENS, TEMPERATURE, CALL_SECONDS = 2048, 0.1, 30


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def call(self, messages: list[dict[str, str]], max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE) -> str: ...


@dataclass
class HashingEmbedder:
    """Works offline: signed counts of hashed terms, of unit length; a text without terms is all zero."""

    dims: int = 256

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for term in re.findall(r"[^\W_]+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1 if h >> 63 else -1
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


@dataclass
class EchoModel:
    """Works offline: answers with the last message, cut to the limit."""

    prefix: str = ""

    def call(self, messages: list[dict[str, str]], max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE) -> str:
        return self.prefix + messages[-1]["content"][: max_tokens * 4]


#: Providers by name; those that need a network are registered by their users.
PROVIDERS: dict[str, Callable[..., LanguageModel]] = {"echo": EchoModel}


#: Embedders by name; others are registered by their users.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


def language_model(provider: str, **options) -> LanguageModel:
    if provider not in PROVIDERS:
        raise ModelError(f"unknown provider: {provider}")
    return PROVIDERS[provider](**options)


def validated(response: str | None, least: int = LEAST) -> str:
    """The stripped response; ``ModelError`` if there is none, it is short, or it reports an error."""
    from tessera.functions.text import ERROR_PREFIXES

    if response is None:
        raise ModelError("no response")
    text = str(response).strip()
    if len(text) < least:
        raise ModelError("response too short")
    if text.lower().startswith(ERROR_PREFIXES):
        raise ModelError(f"error response: {text[:100]}")
    return text


def with_retries(call: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF, least: int = LEAST, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first result of at least ``least`` characters; waits double between attempts."""
    last: Exception | None = None
    for attempt in range(retries + 1):
        try:
            result = call()
            if result is not None and len(str(result).strip()) >= least:
                return result
            last = ModelError("response too short")
        except Exception as e:  # every failure of a provider counts
            last = e
        if attempt < retries:
            sleep(backoff * 2**attempt)
    raise ModelError(f"failed after {retries + 1} attempts: {last}")


@dataclass
class CircuitBreaker:
    """Closed until ``threshold`` failures; open for ``timeout`` seconds after the last; then trials, until one succeeds."""

    threshold: int = FAILURES
    timeout: float = TIMEOUT
    clock: Callable[[], float] = time.time
    failures: int = 0
    opened: bool = False
    last: float | None = None

    def allow(self) -> bool:
        return not self.opened or self.last is not None and self.clock() - self.last >= self.timeout

    def success(self) -> None:
        self.failures, self.opened, self.last = 0, False, None

    def failure(self) -> None:
        self.failures += 1
        if self.failures >= self.threshold:
            self.opened, self.last = True, self.clock()


@dataclass
class GuardedModel:
    """A model behind its breaker, validated and retried; refused calls don't count as failures."""

    model: LanguageModel
    retries: int = RETRIES
    backoff: float = BACKOFF
    least: int = LEAST
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)

    def call(self, messages: list[dict[str, str]], max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE, stream: bool = False) -> str:
        if stream:
            raise NotImplementedError("streaming responses")
        if not self.breaker.allow():
            raise ModelError("circuit open")

        def once() -> str:
            try:
                text = validated(self.model.call(messages, max_tokens, temperature), self.least)
            except Exception:
                self.breaker.failure()
                raise
            self.breaker.success()
            return text

        return with_retries(once, self.retries, self.backoff, self.least)


def embed(text: Column, embedder: Embedder) -> Column:
    """Embeddings of a text column, batch by batch; the embedder is unpickled once a worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder.embed(texts.fillna("").tolist()))

    return run(text)


@dataclass
class TimedModel:
    """A model with limits of its own for every call: tokens, temperature, and seconds, after which the call has failed.

    A call that is late is left running in its thread; its answer is dropped.
    """

    model: LanguageModel
    max_tokens: int = MAX_TOKENS
    temperature: float = TEMPERATURE
    seconds: float = CALL_SECONDS

    def call(self, messages: list[dict[str, str]], max_tokens: int | None = None, temperature: float | None = None) -> str:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.model.call, messages, self.max_tokens, self.temperature).result(self.seconds)
        except FutureTimeout as e:
            raise ModelError(f"no answer within {self.seconds} seconds") from e
        finally:
            pool.shutdown(wait=False)


def ask(prompt: Column, model: LanguageModel, system: str | None = None) -> Column:
    """struct(ok, text, error): a model's answers to a prompt column (E2); null prompts aren't asked."""

    @F.pandas_udf("ok boolean, text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for p in prompts:
                if p is None:
                    rows.append((False, None, "no prompt"))
                    continue
                try:
                    rows.append((True, model.call([*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": p}]), None))
                except Exception as e:
                    rows.append((False, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["ok", "text", "error"])

    return run(prompt)


def breaker_decisions(events: DataFrame, key: str, order: list[str], at: str, outcome: str, threshold: int = FAILURES, timeout: float = TIMEOUT) -> DataFrame:
    """See ``operators.breaker.decisions``."""
    from tessera.operators.breaker import decisions

    return decisions(events, key, order, at, outcome, threshold, timeout)
