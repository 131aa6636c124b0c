"""Model and embedding endpoints over HTTP, called from executors in batches.

A task may run twice, so replies belong into a keyed table and callers ask only
for what that table lacks (as the embedding cache does).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tarnfold.operators.embedding import BATCH

MAX_BODY = 64 << 20
MAX_ATTEMPTS = 5
MAX_WAIT = 30.0
REPLY = "query_id string, raw string, stop_reason string, input_tokens bigint, output_tokens bigint, err string"


class Transient(Exception):
    def __init__(self, message: str, retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


def retry_after_seconds(header: str | None) -> float:
    """Positive whole seconds; a date is ignored."""
    try:
        return float(max(0, int(header or "")))
    except ValueError:
        return 0.0


def delay(attempt: int, base: float, asked: float) -> float:
    return min(MAX_WAIT, max(min(MAX_WAIT, base * 2.0 ** min(attempt, 60)), asked))


def short_body(body: bytes) -> str:
    text = body.decode("utf-8", "replace").strip()
    return text[:300] + "…" if len(text.encode()) > 300 else text or "(empty body)"


def post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    """One JSON request; network faults, 429 and 5xx are transient."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read(MAX_BODY))
    except urllib.error.HTTPError as e:
        text = f"status {e.code}: {short_body(e.read(4096))}"
        if e.code == 429 or e.code >= 500:
            raise Transient(text, retry_after_seconds(e.headers.get("Retry-After"))) from e
        raise RuntimeError(text) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Transient(f"network: {e}") from e


def with_retries(call: Callable[[], dict], attempts: int, base: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Call again after transient errors only."""
    for attempt in range(attempts):
        try:
            return call()
        except Transient as e:
            if attempt + 1 == attempts:
                raise RuntimeError(str(e)) from e
            sleep(delay(attempt, base, e.retry_after))
    raise RuntimeError("no attempts")


@dataclass(frozen=True)
class Endpoint:
    """A chat endpoint. ``style`` is ``messages`` (system apart, retried) or ``completions`` (system as a message, once)."""

    url: str
    model: str
    style: str = "messages"
    headers: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 4096
    temperature: float = 0.0
    timeout: float = 120.0
    attempts: int = MAX_ATTEMPTS
    backoff: float = 0.5
    options: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.model

    def generate(self, system: str, user: str) -> tuple[str, str, int, int]:
        """``(text, stop reason, input tokens, output tokens)``."""
        if self.style == "messages":
            body = {"model": self.model, "max_tokens": self.max_tokens or 4096, "system": system, "messages": [{"role": "user", "content": user}]}
            reply = with_retries(lambda: post(self.url, body, self.headers, self.timeout), self.attempts, self.backoff)
            text = "".join(part.get("text", "") for part in reply.get("content", []))
            usage = reply.get("usage", {})
            return text, reply.get("stop_reason") or "", usage.get("input_tokens", 0), usage.get("output_tokens", 0)
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_tokens": self.max_tokens, "temperature": max(0.0, self.temperature), "stream": False, **({"options": self.options} if self.options else {})}
        reply = with_retries(lambda: post(self.url, body, self.headers, self.timeout), 1, self.backoff)
        if not reply.get("choices"):
            raise RuntimeError("no choices in reply")
        choice, usage = reply["choices"][0], reply.get("usage", {})
        reason = choice.get("finish_reason") or ""
        return choice["message"]["content"], "max_tokens" if reason == "length" else reason, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)


def generate(prompts: DataFrame, endpoint: Endpoint) -> DataFrame:
    """Replies of ``prompts(query_id, system, message)``; a failed call is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    rows.append((row.query_id, *endpoint.generate(row.system, row.message), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((row.query_id, None, None, None, None, f"generate: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return prompts.select("query_id", "system", "message").mapInPandas(run, REPLY)


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding endpoint: ``BATCH`` texts per request, replies put in order by their index, unit length."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0

    @property
    def name(self) -> str:
        return self.model

    def vectors(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), BATCH):
            part = texts[lo : lo + BATCH]
            data = sorted(post(self.url, {"model": self.model, "input": part}, self.headers, self.timeout).get("data", []), key=lambda x: x["index"])
            if len(data) != len(part) or any(not x["embedding"] for x in data):
                raise RuntimeError(f"{len(data)} vectors for {len(part)} texts")
            for x in data:
                size = sum(v * v for v in x["embedding"]) ** 0.5
                out.append([v / size for v in x["embedding"]] if size else x["embedding"])
        return out

    def embed(self, texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(vec=self.vectors(batch.text.tolist()))

        from pyspark.sql.types import ArrayType, FloatType, StructType

        return texts.mapInPandas(run, StructType([*texts.schema.fields]).add("vec", ArrayType(FloatType())))
