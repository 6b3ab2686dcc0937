"""Deterministic offline stand-ins for models, and the calling of models: batches, threads, retries.

The stand-ins fix the interface a real model would have to meet; they are no models.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIED = frozenset({408, 429, 502, 503, 504})


def hashed_embedding(texts: list[str | None], dims: int = 64) -> np.ndarray:
    """Signed hashed bag of words, unit length; zero for an empty text."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
            out[i, int(h[:4], 16) % dims] += 1.0 if h[4] >= "8" else -1.0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def in_order(part: list, reply: list) -> list:
    """A reply of (index, vector) pairs in any order, or of vectors, brought into the order of the texts; another length raises."""
    if len(reply) != len(part):
        raise ValueError("as many vectors as texts are needed")
    if len(reply) and isinstance(reply[0], tuple):
        reply = [v for _, v in sorted(reply, key=lambda x: x[0])]
    return [np.asarray(v, np.float64).tolist() for v in reply]


def embed(df: DataFrame, key: str, text: str, provider: Callable[[list], object] = hashed_embedding, batch: int = 64, tries: int = 5, wait: float = 2.0) -> DataFrame:
    """(key, v): the provider is called with at most ``batch`` texts, again after an error with waits that grow by ``wait`` seconds."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vs = []
            for i in range(0, len(f), batch):
                part = f["t"].iloc[i : i + batch].tolist()
                vs += with_attempts(lambda part=part: in_order(part, list(provider(part))), tries, lambda n: wait * (n + 1))
            yield pd.DataFrame({key: f[key], "v": vs})

    return df.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, v array<double>")


def with_attempts(call: Callable[[], object], tries: int, wait: Callable[[int], float], sleep: Callable[[float], None] = time.sleep) -> object:
    """Call until it does not raise; the last error goes on."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n + 1 == tries:
                raise
            sleep(wait(n))
    raise ValueError("at least one try is needed")


def score_pairs(df: DataFrame, key: list[str], query: str, text: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32) -> DataFrame:
    """(key, score) by a pair scorer; ``load`` makes it once a worker, as a model would be loaded."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for f in frames:
            pairs, out = list(zip(f["q"], f["t"], strict=True)), []
            for i in range(0, len(pairs), batch):
                out += [float(x) for x in score(pairs[i : i + batch])]
            yield pd.DataFrame({**{k: f[k] for k in key}, "score": out})

    return df.select(*key, F.col(query).alias("q"), F.col(text).alias("t")).mapInPandas(run, f"{kinds}, score double")


def ask(df: DataFrame, key: str, prompt: list[str], call: Callable[..., str | None], *, threads: int = 20, tries: int = 3, wait: Callable[[int], float] = lambda n: 2.0 * 2**n) -> DataFrame:
    """(key, value): a model's reply to each row, ``threads`` calls at a time in a task; null after the last failure."""
    kind = df.schema[key].dataType.simpleString()

    def one(args: tuple) -> str | None:
        try:
            return with_attempts(lambda: call(*args), tries, wait)
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                yield pd.DataFrame({key: f[key], "value": list(pool.map(one, f[prompt].itertuples(index=False, name=None)))})

    return df.select(key, *prompt).mapInPandas(run, f"{key} {kind}, value string")


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda x: x != ""))
    t = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def judge_reply(query: str | None, text: str | None) -> str:
    """A judge's reply in words, of the overlap of query and text; the interface of a relevance judge."""
    q, t = ({w for w in (x or "").lower().split()} for x in (query, text))
    share = len(q & t) / len(q) if q else 0.0
    return f"score: {3 if share >= 0.5 else 2 if share >= 0.2 else 1}"


def retry_wait(attempt: int, base: float, most: float, retry_after: float | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what the server asked for, else a doubling wait times 0.5 to 1.5; never over ``most``."""
    wait = retry_after if retry_after is not None and retry_after >= 0 else base * 2**attempt * (0.5 + jitter())
    return min(most, max(0.0, wait))


def with_retries(call: Callable[[], tuple], tries: int = 5, base: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> object:
    """Call until the status is not one to retry.

    ``call`` gives (status, reply) or (status, reply, seconds the server asked
    to wait), which counts for status 429, or raises TimeoutError or
    ConnectionError.  Other statuses of 400 and more raise at once.
    """
    error: Exception | None = None
    for i in range(tries):
        asked = None
        try:
            status, reply, *more = call()
            if status not in RETRIED:
                if status >= 400:
                    raise RuntimeError(f"status {status}")
                return reply
            error = RuntimeError(f"status {status} after {tries} tries")
            asked = more[0] if more and status == 429 else None
        except (TimeoutError, ConnectionError) as e:
            error = e
        if i + 1 < tries:
            sleep(retry_wait(i, base, most, asked, jitter))
    raise error or ValueError("at least one try is needed")
