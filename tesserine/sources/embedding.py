"""Embedding a backlog through any embedder: bounded requests, classified retries, a poison list.

An embedder is a callable that takes a list of texts and returns a list of vectors, or of (index, vector) pairs in any
order, on an executor. `HttpEmbedder` is one for servers of the common `/embeddings` form.
"""

from __future__ import annotations

import json
import math
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS, MAX_BYTES = 32, 256 * 1024
RETRY_AFTER_CAP = 60.0
#: How long a text is left alone after its first failure, and after its second; how many are remembered.
STRIKE_SECONDS, ABANDON_SECONDS, POISON_CAP = 60, 720, 10_000
Embedder = Callable[[list[str]], list]


class RequestError(Exception):
    """What a server answered: status and body, and how long it asks to wait."""

    def __init__(self, status: int, body: str = "", retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.body, self.retry_after = status, body, retry_after


@dataclass(frozen=True)
class HttpEmbedder:
    """POST {base}/embeddings with a model and a list of inputs; the answer's `data` holds an index and an embedding per
    input. Travels to executors as it is; the key is read there, from the environment variable it is kept in."""

    base: str
    model: str
    key_variable: str | None = None
    dims: int | None = None
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        body = {"model": self.model, "input": texts} | ({"dimensions": self.dims} if self.dims else {})
        headers = {"Content-Type": "application/json"}
        if self.key_variable and (key := os.environ.get(self.key_variable)):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.base.rstrip('/')}/embeddings", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                rows = json.load(answer)["data"]
        except urllib.error.HTTPError as e:
            raise RequestError(e.code, e.read(4096).decode(errors="replace"), wait_seconds(e.headers.get("Retry-After"))) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise RequestError(503, str(e)) from e
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"not an answer with embeddings: {e}") from e
        pairs = [(r["index"], [float(x) for x in r["embedding"]]) for r in rows]
        if self.dims is not None and any(len(v) != self.dims for _, v in pairs):
            raise ValueError("a vector of another width")
        return pairs


def wait_seconds(header: str | None, now: float | None = None) -> float | None:
    """What a Retry-After header asks for: seconds, or the time until a date; None if it says neither."""
    if header is None:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except (ValueError, TypeError):
        return None


#: What a gateway writes about a connection that it could not make.
_TRANSPORT = ("dial", "connectex", "bind", "timeout")


def retryable(error: RequestError) -> bool:
    """Timeouts, throttling and server errors pass; another refusal stays one, unless its body tells of a connection that a
    gateway could not make."""
    if error.status in (408, 429) or error.status >= 500:
        return True
    return any(w in error.body.lower() for w in _TRANSPORT)


def backoff(attempt: int, rng: random.Random, base: float = 0.5, cap: float = 30.0) -> float:
    """Seconds before attempt number `attempt` (0 first): doubling with jitter."""
    return min(cap, base * 2**attempt) * (0.5 + rng.random() / 2)


def batches(texts: list[str], max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> Iterator[slice]:
    """Slices within both limits; a text that is too large by itself goes alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t.encode("utf-8", "surrogatepass"))
        if i > begin and (i - begin >= max_items or size + n > max_bytes):
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def ordered_answer(rows: list[tuple[int, list[float]]], n: int, dims: int | None = None) -> list[list[float]]:
    """The vectors of an answer (index, vector) in the order of the request. ValueError if one is missing, given twice,
    empty or of another width."""
    out: list[list[float] | None] = [None] * n
    for i, v in rows:
        if not 0 <= i < n or out[i] is not None:
            raise ValueError(f"index {i} is out of range or given twice")
        if not v or (dims is not None and len(v) != dims):
            raise ValueError(f"vector {i} has width {len(v)}")
        out[i] = v
    if any(v is None for v in out):
        raise ValueError("a vector is missing")
    return out  # type: ignore[return-value]


def call(embedder: Embedder, texts: list[str], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request with retries."""
    rng = random.Random(len(texts))
    for attempt in range(attempts):
        try:
            answer = embedder(texts)
            return ordered_answer(answer if answer and isinstance(answer[0], tuple) else list(enumerate(answer)), len(texts))
        except RequestError as e:
            if not retryable(e) or attempt == attempts - 1:
                raise
            sleep(min(e.retry_after, RETRY_AFTER_CAP) if e.retry_after is not None else backoff(attempt, rng))
    raise AssertionError


def sound(v: list[float]) -> bool:
    return bool(v) and all(map(math.isfinite, v)) and math.sqrt(math.fsum(x * x for x in v)) > 1.1920929e-7


def embed(backlog: DataFrame, embedder: Embedder, partitions: int = 8) -> DataFrame:
    """(chunk_rowid, project_id, dims, vector, failed) of a backlog (id, project_id, text).

    `partitions` requests are in flight at a time. A failing batch is tried text by text, so that one bad text costs only
    itself; an unusable vector counts as a failure. failed is null for a vector of unit length, else the reason."""

    def run(batches_in):
        for b in batches_in:
            ids, projects, texts = (c.to_pylist() for c in b.columns)
            rows = []
            for part in batches(texts):
                try:
                    answers: list = call(embedder, texts[part])
                except (RequestError, ValueError):
                    answers = []
                    for t in texts[part]:
                        try:
                            answers.append(call(embedder, [t])[0])
                        except (RequestError, ValueError) as e:
                            answers.append(str(e))
                for i, p, v in zip(ids[part], projects[part], answers):
                    if isinstance(v, list) and sound(v):
                        length = math.sqrt(math.fsum(x * x for x in v))
                        rows.append((i, p, len(v), [x / length for x in v], None))
                    else:
                        rows.append((i, p, None, None, v if isinstance(v, str) else "unusable vector"))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["chunk_rowid", "project_id", "dims", "vector", "failed"])

    rows = backlog.select("id", "project_id", "text").repartition(partitions, "id")
    return rows.mapInArrow(run, "chunk_rowid long, project_id long, dims int, vector array<float>, failed string")


def poison(known: DataFrame, failures: DataFrame, now: int) -> DataFrame:
    """(chunk_rowid, strikes, retry_at) after some failures (chunk_rowid, failed): one strike waits a minute, two or an
    unusable vector count as given up for twelve minutes; the longest waiting beyond POISON_CAP are forgotten."""
    hit = failures.select("chunk_rowid", F.when(F.col("failed") == "unusable vector", 2).otherwise(1).alias("more"))
    rows = known.join(hit, "chunk_rowid", "full").select(
        "chunk_rowid", (F.coalesce("strikes", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("strikes"), "more", "retry_at")
    wait = F.when(F.col("strikes") >= 2, ABANDON_SECONDS).otherwise(STRIKE_SECONDS)
    rows = rows.select("chunk_rowid", "strikes", F.when(F.col("more").isNotNull(), F.lit(now) + wait).otherwise(F.col("retry_at")).cast("long").alias("retry_at"))
    return rows.orderBy(F.desc("retry_at"), "chunk_rowid").limit(POISON_CAP)


def due(backlog: DataFrame, poisoned: DataFrame, now: int) -> DataFrame:
    """The backlog without texts that are to be left alone for now."""
    waiting = poisoned.where(F.col("retry_at") > now).select(F.col("chunk_rowid").alias("id"))
    return backlog.join(waiting, "id", "left_anti")


def latest_health(observations: DataFrame) -> DataFrame:
    """(label, status): the observation with the highest ticket per label; late ones with a lower ticket are dropped."""
    return observations.groupBy("label").agg(F.max_by("status", "ticket").alias("status"), F.max("ticket").alias("ticket"))
