"""Extraction by a language model behind a provider: calls inside the tasks, retries, errors as rows, and what the calls used.

A provider is a function of system and user text that returns a Reply; `chat_provider` and `messages_provider` make two over HTTP.
Each executor's tasks call it once a message and `attempts` times at most: a reply that was cut off or isn't the asked JSON
is asked for again, a refusal isn't, AccessDenied ends the job, and any other error leaves a null answer with the error's text.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import DEFAULT, Config
from . import extraction

COUNTS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")


class AccessDenied(RuntimeError):
    """The provider doesn't accept the key: no call will succeed."""


@dataclass(frozen=True)
class Reply:
    text: str
    cut_off: bool = False
    refused: bool = False
    input_tokens: int = 0
    output_tokens: int = 0
    cache_write_tokens: int = 0
    cache_read_tokens: int = 0


@dataclass(frozen=True)
class Prices:
    """US dollars for a million tokens."""

    input_tokens: float = 2.0
    output_tokens: float = 10.0
    cache_write_tokens: float = 2.5
    cache_read_tokens: float = 0.2


Provider = Callable[[str, str], Reply]


def _posted(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise AccessDenied(f"{url}: {e.code}") from e
        raise


def chat_provider(url: str, model: str, key: str, max_tokens: int = 2000, timeout: float = 120) -> Provider:
    """A service of chat completions that answers with a JSON object."""

    def call(system: str, user: str) -> Reply:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        got = _posted(url, {"authorization": f"Bearer {key}"}, {"model": model, "max_tokens": max_tokens, "messages": messages, "response_format": {"type": "json_object"}}, timeout)
        choice, used = got["choices"][0], got.get("usage") or {}
        cached = (used.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
        return Reply(choice["message"].get("content") or "", choice.get("finish_reason") == "length", choice.get("finish_reason") == "content_filter", (used.get("prompt_tokens") or 0) - cached, used.get("completion_tokens") or 0, 0, cached)

    return call


def messages_provider(url: str, model: str, key: str, version: str, max_tokens: int = 2000, timeout: float = 120) -> Provider:
    """A service of messages with a system text that it caches."""

    def call(system: str, user: str) -> Reply:
        told = [{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}]
        got = _posted(url, {"x-api-key": key, "anthropic-version": version}, {"model": model, "max_tokens": max_tokens, "system": told, "messages": [{"role": "user", "content": user}]}, timeout)
        used = got.get("usage") or {}
        text = "".join(part.get("text", "") for part in got.get("content") or [])
        return Reply(text, got.get("stop_reason") == "max_tokens", got.get("stop_reason") == "refusal", used.get("input_tokens") or 0, used.get("output_tokens") or 0, used.get("cache_creation_input_tokens") or 0, used.get("cache_read_input_tokens") or 0)

    return call


def _fault(reply: Reply) -> str | None:
    """What is wrong with a reply: nothing, or why it can't be used."""
    if reply.refused:
        return "refused"
    if reply.cut_off:
        return "cut off before the JSON's end"
    try:
        found = json.loads(reply.text)
    except ValueError:
        return "not JSON"
    return None if isinstance(found, dict) and all(isinstance(found.get(k), list) for k in ("aspects", "triplets")) else "not of the asked form"


def asked(messages: DataFrame, provider: Provider, system: str, attempts: int = 2, key: str = "review_id", config: Config = DEFAULT) -> DataFrame:
    """One row per row of messages (key, message): key, extraction (null after an error), error, calls, and the tokens of all its calls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for id_, message in zip(frame[key], frame["message"], strict=True):
                raw, error, replies = None, None, []
                try:
                    while raw is None and len(replies) < attempts and error != "refused":
                        replies.append(provider(system, message or ""))
                        error = _fault(replies[-1])
                        raw = None if error else replies[-1].text
                except AccessDenied:
                    raise
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((id_, raw, error, len(replies), *(sum(getattr(r, c) for r in replies) for c in COUNTS)))
            yield pd.DataFrame(rows, columns=[key, "raw", "error", "calls", *COUNTS])

    kind = messages.schema[key].dataType.simpleString()
    answers = messages.select(key, "message").mapInPandas(run, f"{key} {kind}, raw string, error string, calls long, " + ", ".join(f"{c} long" for c in COUNTS))
    return answers.select(key, extraction.capped(extraction.parsed(F.col("raw")), config).alias("extraction"), "error", "calls", *COUNTS)


def usage(answers: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """One row: calls, tokens of each kind, and their cost in dollars."""
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("calls", *COUNTS)))
    cost = sum((F.col(c) * F.lit(getattr(prices, c)) for c in COUNTS), F.lit(0.0)) / 1e6
    return sums.withColumn("cost_usd", F.round(cost, 6))
