"""Embedder and model provider as the environment names them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnfold.operators.embedding import embed_cached
from tarnfold.plans.predict import Provider, mock_provider
from tarnfold.session import cut
from tarnfold.sources.endpoints import Endpoint, HttpEmbedder, generate
from tarnfold.sources.files import env_int, load_cache, save_cache

#: The variables' defaults.
EMBED_URL = "https://api.openai.com/v1"
EMBED_MODEL = "text-embedding-3-small"
EMBED_CACHE = ".embed-cache"
LOCAL_URL = "http://localhost:11434/v1"
MESSAGES_URL = "https://api.anthropic.com/v1/messages"
MESSAGES_MODEL = "claude-haiku-4-5"
CANNED: dict[str, str] = {}


def _bearer(key: str) -> dict[str, str]:
    return {"authorization": f"Bearer {key}"} if key else {}


@dataclass(frozen=True)
class CachedEmbedder:
    """An embedder behind a cache in a shared folder; what was missing is appended as soon as it is made."""

    spark: SparkSession
    inner: HttpEmbedder
    cache: str

    @property
    def name(self) -> str:
        return self.inner.name

    def embed(self, texts: DataFrame) -> DataFrame:
        out, fresh = embed_cached(texts, load_cache(self.spark, self.cache), self.inner)
        save_cache(cut(fresh), self.cache)
        return embed_cached(texts, load_cache(self.spark, self.cache), self.inner)[0]


def embedder(spark: SparkSession, env: Mapping[str, str] = os.environ) -> CachedEmbedder:
    """EMBED_API_KEY (or OPENAI_API_KEY), EMBED_BASE_URL, EMBED_MODEL, EMBED_CACHE."""
    key = env.get("EMBED_API_KEY") or env.get("OPENAI_API_KEY") or ""
    url = (env.get("EMBED_BASE_URL") or EMBED_URL).rstrip("/") + "/embeddings"
    return CachedEmbedder(spark, HttpEmbedder(url, env.get("EMBED_MODEL") or EMBED_MODEL, _bearer(key)), env.get("EMBED_CACHE") or EMBED_CACHE)


def _required(env: Mapping[str, str], name: str, kind: str) -> str:
    if not env.get(name):
        raise ValueError(f"LLM_PROVIDER={kind} requires {name} to be set")
    return env[name]


def provider(env: Mapping[str, str] = os.environ, max_tokens: int = 4096, temperature: float = 0.0) -> tuple[Provider, str]:
    """``(provider, model name)`` of LLM_PROVIDER (mock, anthropic, openai, ollama), LLM_MODEL, LLM_TIMEOUT and the keys."""
    kind = (env.get("LLM_PROVIDER") or "mock").strip().lower() or "mock"
    model, common = env.get("LLM_MODEL") or "", {"max_tokens": max_tokens, "temperature": temperature}
    if kind == "mock":
        return mock_provider(CANNED), "mock"
    if kind == "anthropic":
        headers = {"x-api-key": _required(env, "ANTHROPIC_API_KEY", kind), "anthropic-version": "2023-06-01"}
        end = Endpoint(MESSAGES_URL, model or MESSAGES_MODEL, "messages", headers, **common)
    elif kind == "openai":
        key = _required(env, "OPENAI_API_KEY", kind)
        url = (env.get("OPENAI_BASE_URL") or EMBED_URL).rstrip("/") + "/chat/completions"
        end = Endpoint(url, model or "gpt-4o", "completions", _bearer(key), timeout=env_int("LLM_TIMEOUT", 120, env), **common)
    elif kind == "ollama":
        url = (env.get("OLLAMA_BASE_URL") or LOCAL_URL).rstrip("/") + "/chat/completions"
        options = {"num_ctx": env_int("OLLAMA_NUM_CTX", 8192, env)}
        end = Endpoint(url, model or "llama3", "completions", {}, timeout=env_int("LLM_TIMEOUT", 300, env), options=options, **common)
    else:
        raise ValueError(f"unknown LLM_PROVIDER {kind!r}; one of mock, anthropic, openai, ollama")
    return (lambda prompts: generate(prompts, end)), end.name
