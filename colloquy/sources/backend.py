"""Text models as a map stage. A backend is any function of a list of chat messages; the default is a deterministic stub."""

from __future__ import annotations

import hashlib
import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

Backend = Callable[[list[dict]], str]


def stub(messages: list[dict]) -> str:
    """A short answer that depends on the messages only."""
    return "ok " + hashlib.sha256(json.dumps(messages, sort_keys=True).encode()).hexdigest()[:8]


@dataclass(frozen=True)
class HttpBackend:
    """A chat-completions endpoint with linear back-off on the statuses that may pass, refused or broken connections and timeouts."""

    url: str
    model: str
    key: str = ""
    timeout: float = 300.0
    retries: int = 2
    backoff: float = 1.0
    temperature: float = 0.8

    def __call__(self, messages: list[dict]) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(1, self.retries + 2):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if attempt > self.retries or not (e.code in (408, 409, 425, 429) or e.code >= 500):
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException):
                if attempt > self.retries:
                    raise
            time.sleep(min(10.0, self.backoff * attempt))
        raise AssertionError


def endpoint(base: str, path: str = "chat/completions") -> str:
    """The endpoint's address for a base with or without version and path."""
    base = base.strip().rstrip("/")
    return base if base.endswith("/" + path) else f"{base}/{path}" if base.rsplit("/", 1)[-1].startswith("v") else f"{base}/v1/{path}"


def stop_list(stops: Column, first: tuple[str, ...] = (), limit: int = 4) -> Column:
    """The distinct non-empty stop strings in their order; of more than `limit` those in `first` are kept before others."""
    own = F.array_distinct(F.filter(F.coalesce(stops, F.array().cast("array<string>")), lambda s: s != ""))
    liked = F.array(*[F.lit(s) for s in first]).cast("array<string>")
    ranked = F.concat(F.array_intersect(liked, own), F.array_except(own, liked))
    return F.when(F.size(own) <= limit, own).otherwise(F.slice(ranked, 1, max(limit, 0)))


def _nullable(rows: DataFrame) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in rows.schema.fields]


def complete(rows: DataFrame, messages: str, backend: Backend = stub, *, name: str = "answer", error: str | None = None, at_once: int = 8) -> DataFrame:
    """rows with the backend's answer to each one's messages, `at_once` requests in flight in every task; null where it fails.

    With `error` a column of that name says why a request failed, and is null where it did not.
    """
    added = [name] if error is None else [name, error]

    def ask(own: list[dict] | None) -> tuple[str | None, str | None]:
        try:
            return backend(own or []), None
        except Exception as e:  # noqa: BLE001  one failed request must not lose the others
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                got = list(pool.map(ask, batch.column(messages).to_pylist()))
                new = [pa.array([g[i] for g in got], pa.string()) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    return rows.mapInArrow(run, StructType([*_nullable(rows), *[StructField(n, StringType()) for n in added]]))


def generate(specs: DataFrame, source: Backend = stub, simulator: Backend = stub, *, spec_col: str = "spec", max_turns: int = 20) -> DataFrame:
    """specs with `messages`: user and assistant in turns, each seeing the dialogue so far. Conversations run in parallel."""
    sent = specs.withColumn("turns", F.col("turns").cast("int"))
    said_type = ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())]))

    def talk(spec: str | None, turns: int) -> list[dict]:
        said: list[dict] = []
        for _ in range(max(2, min(max_turns, turns))):
            said.append({"role": "user", "content": simulator([{"role": "system", "content": spec or ""}, *said])})
            said.append({"role": "assistant", "content": source(list(said))})
        return said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
        for batch in batches:
            got = [talk(s, t or 8) for s, t in zip(batch.column(spec_col).to_pylist(), batch.column("turns").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], [*batch.schema.names, "messages"])

    return sent.mapInArrow(run, StructType([*_nullable(sent), StructField("messages", said_type)]))
