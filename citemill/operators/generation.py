"""Answer generation. A generator turns question, sources and prompt columns
into one struct column of the ``GENERATION`` schema."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.config import ABSTENTION, Settings
from citemill.functions.binding import let
from citemill.functions.text import keywords, sentences
from citemill.operators.prompting import SYSTEM_PROMPT
from citemill.operators.ledger import Ledger
from citemill.schemas import GENERATION

# US dollars per million input and output tokens.
PRICES = {"claude-sonnet-4-6": (3.0, 15.0), "gpt-4o": (2.5, 10.0)}
# Parts of the names of errors worth another attempt.
RETRYABLE = (
    "RateLimit", "APIStatus", "APIConnection", "Overloaded", "Timeout", "InternalServer",
)
MAX_ATTEMPTS = 4
FIRST_WAIT_SEC = 1.0
STOP = "\n\nQUESTION:"


class OfflineError(RuntimeError):
    """A remote generator was chosen while offline."""


class Generator(Protocol):
    def __call__(self, question: Column, sources: Column, prompt: Column) -> Column: ...


def generation_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost in US dollars; a model without a price costs nothing."""
    price_in = price_out = F.lit(0.0)
    for name, (cost_in, cost_out) in PRICES.items():
        price_in = F.when(model == name, cost_in).otherwise(price_in)
        price_out = F.when(model == name, cost_out).otherwise(price_out)
    return input_tokens / F.lit(1e6) * price_in + output_tokens / F.lit(1e6) * price_out


def best_sentence(question_words: Column, text: Column) -> Column:
    """Struct of the text's sentence that shares most keywords with the question
    (the first of equals) and the number of words shared."""
    scored = F.transform(
        sentences(text),
        lambda s, i: F.struct(
            F.size(F.array_intersect(question_words, keywords(s))).alias("shared"),
            (-i).alias("earliness"), s.alias("sentence"),
        ),
    )
    return F.array_max(scored)


def extractive_answer(question: Column, sources: Column) -> Column:
    """The best sentence of every source that shares a keyword with the question,
    each followed by its marker; the abstention phrase when there is none."""
    def answer(asked: Column) -> Column:
        lines = F.transform(
            sources,
            lambda c: F.struct(best_sentence(asked, c.text).alias("best"), c.rank.alias("rank")),
        )
        useful = F.filter(lines, lambda x: x.best.shared > 0)
        cited = F.transform(
            useful,
            lambda x: F.concat(x.best.sentence, F.lit(" ["), x.rank.cast("string"), F.lit("]")),
        )
        return let(cited, lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")).otherwise(ABSTENTION))

    return let(F.array_distinct(keywords(question)), answer)


def extractive_generator(question: Column, sources: Column, prompt: Column) -> Column:
    """Generator that needs no model: quotes its sources."""
    return F.struct(
        extractive_answer(question, sources).alias("text"),
        F.lit(False).alias("truncated"),
        F.lit(0).cast("bigint").alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit(None).cast("string").alias("error"),
    )


def result(text: str, error: str | None = None, **fields: Any) -> dict:
    base = {"truncated": False, "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0}
    return {**base, **fields, "text": text, "error": error}


def with_retry(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep) -> dict:
    """Result of ``call``; transient errors are tried again after growing waits,
    and the last error becomes an error result."""
    for attempt in range(1, MAX_ATTEMPTS + 1):
        try:
            return call()
        except Exception as error:
            name = type(error).__name__
            if attempt == MAX_ATTEMPTS or not any(part in name for part in RETRYABLE):
                return result(ABSTENTION, f"{name}: {error}")
        sleep(FIRST_WAIT_SEC * 2 ** (attempt - 1))
    raise AssertionError("unreachable")


def post_json(url: str, headers: dict[str, str], body: dict) -> dict:
    request = urllib.request.Request(
        url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}
    )
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.load(reply)


def _messages(prompt: str) -> list[dict]:
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": prompt}]


def _ask_anthropic(prompt: str, settings: Settings, post: Callable) -> dict:
    # This service takes temperature or top_p, not both.
    reply = post(
        "https://api.anthropic.com/v1/messages",
        {"x-api-key": os.environ.get("ANTHROPIC_API_KEY", ""), "anthropic-version": "2023-06-01"},
        {
            "model": settings.model, "max_tokens": settings.max_output_tokens,
            "temperature": settings.temperature, "system": SYSTEM_PROMPT,
            "messages": [{"role": "user", "content": prompt}], "stop_sequences": [STOP],
        },
    )
    text = "".join(part["text"] for part in reply["content"] if part.get("type") == "text")
    usage = reply["usage"]
    return {
        "text": text, "truncated": reply.get("stop_reason") == "max_tokens",
        "input_tokens": usage["input_tokens"], "output_tokens": usage["output_tokens"],
    }


def _ask_openai(prompt: str, settings: Settings, post: Callable) -> dict:
    reply = post(
        "https://api.openai.com/v1/chat/completions",
        {"Authorization": f"Bearer {os.environ.get('OPENAI_API_KEY', '')}"},
        {
            "model": settings.model, "max_tokens": settings.max_output_tokens,
            "temperature": settings.temperature, "top_p": settings.top_p,
            "messages": _messages(prompt), "stop": [STOP],
        },
    )
    choice, usage = reply["choices"][0], reply["usage"]
    return {
        "text": choice["message"].get("content") or "",
        "truncated": choice.get("finish_reason") == "length",
        "input_tokens": usage["prompt_tokens"], "output_tokens": usage["completion_tokens"],
    }


def _ask_ollama(prompt: str, settings: Settings, post: Callable) -> dict:
    reply = post(
        f"{settings.chat_host}/api/chat", {},
        {
            "model": settings.model, "messages": _messages(prompt), "stream": False,
            "options": {
                "temperature": settings.temperature, "top_p": settings.top_p,
                "num_predict": settings.max_output_tokens,
            },
        },
    )
    return {
        "text": reply.get("message", {}).get("content") or "",
        "truncated": reply.get("done_reason") == "length",
    }


BACKENDS = {"anthropic": _ask_anthropic, "openai": _ask_openai, "ollama": _ask_ollama}


def chat_answer(prompt: str, settings: Settings, post: Callable = post_json) -> dict:
    """One answer of the chosen chat service, as a result dict."""

    def call() -> dict:
        reply = BACKENDS[settings.backend](prompt, settings, post)
        text = reply.pop("text").strip()
        if not text:
            return result(ABSTENTION, "empty_response")
        price_in, price_out = PRICES.get(settings.model, (0.0, 0.0))
        tokens_in, tokens_out = reply.get("input_tokens", 0), reply.get("output_tokens", 0)
        cost = tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
        return result(text, cost_usd=cost, **reply)

    return with_retry(call)


def prompt_key(prompt: str, settings: Settings) -> str:
    """Names the answer to a prompt: whatever changes the request changes the key."""
    asked = [
        settings.backend, settings.model, settings.temperature, settings.top_p, settings.max_output_tokens, SYSTEM_PROMPT, STOP, prompt,
    ]
    return hashlib.sha256(json.dumps(asked).encode()).hexdigest()


def chat_generator(settings: Settings, post: Callable = post_json) -> Generator:
    """Generator that sends each prompt to a chat service from the executors.

    With ``ledger_path`` each answer is kept as soon as it is there, and a prompt
    with a kept answer is not sent: a task that is tried again, or a second run
    after a failed one, asks and pays only for what is missing.
    """

    @F.pandas_udf(GENERATION)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ledger = Ledger(settings.ledger_path) if settings.ledger_path else None
        for prompts in batches:
            rows = [
                ledger.once(prompt_key(text, settings), lambda: chat_answer(text, settings, post))
                if ledger else chat_answer(text, settings, post)
                for text in prompts
            ]
            yield pd.DataFrame(rows, columns=GENERATION.names)

    return lambda question, sources, prompt: answer(prompt)


def choose_generator(settings: Settings) -> Generator:
    """Generator for the configured backend."""
    if settings.backend == "extractive":
        return extractive_generator
    if settings.backend not in BACKENDS:
        raise ValueError(f"unknown generator backend {settings.backend}")
    if settings.offline and settings.backend != "ollama":
        raise OfflineError(f"backend {settings.backend} needs a network")
    return chat_generator(settings)
