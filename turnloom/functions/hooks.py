"""Where outside models plug in: a function over batches, built once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from turnloom.operators import cache


def with_model(rows: DataFrame, build: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batches through a model: ``build`` makes it once per task, then it maps each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for pdf in batches:
            yield model(pdf)

    return rows.mapInPandas(run, schema)


def with_cached_model(rows: DataFrame, kept: DataFrame, key: str, build: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Results for all keys of ``rows``: kept ones as they are, the model run on the others only."""
    schema = kept.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    new = with_model(cache.misses(rows, kept, key), build, schema)
    return cache.hits(kept, rows, key).unionByName(new)


class Refused(Exception):
    """An answer of a remote side that isn't a success, with its ``status``."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status} {text}".strip())
        self.status = status


def may_pass(error: Exception) -> bool:
    """Is it worth trying again? Connection and time-out errors are, and refusals with 429 or 5xx."""
    return error.status == 429 or error.status >= 500 if isinstance(error, Refused) else isinstance(error, OSError | TimeoutError)


def retried(call: Callable[[str], str], tries: int = 5, pause: Callable[[float], None] = lambda s: None, longest: float = 8.0, again: Callable[[Exception], bool] | None = None) -> Callable[[str], tuple[str | None, str | None]]:
    """``call`` with retries and doubling pauses; gives ``(answer, None)`` or ``(None, last error)``.

    ``again`` tells which errors are tried again (by default all): :func:`may_pass`
    is the rule for a remote side.
    """

    def run(request: str) -> tuple[str | None, str | None]:
        error = None
        for k in range(tries):
            try:
                return call(request), None
            except Exception as e:  # noqa: BLE001 - whatever the transport raises
                error = f"{type(e).__name__}: {e}"
                if again and not again(e):
                    break
                if k + 1 < tries:
                    pause(min(longest, 2.0**k))
        return None, error

    return run


def corrected(call: Callable[[str], str], faults: Callable[[str], list[str]], attempts: int = 3) -> Callable[[str], tuple[str | None, int, list[str]]]:
    """``call`` until its answer has no faults: ``(answer, attempts made, faults of the last)``.

    What was wrong is put under the request that is sent next.
    """

    def run(request: str) -> tuple[str | None, int, list[str]]:
        asked, wrong = request, []
        for k in range(1, attempts + 1):
            answer = call(asked)
            wrong = faults(answer)
            if not wrong:
                return answer, k, []
            asked = "\n".join([request, "The last answer was not valid:", *wrong])
        return None, attempts, wrong

    return run


def with_fallback(model: Callable[[object], str]) -> Callable[[object], tuple[str, str | None]]:
    """``(text, diagnostic)`` of a recogniser: an empty text and what went wrong where it fails or gives none."""

    def run(sample: object) -> tuple[str, str | None]:
        try:
            text = model(sample)
        except Exception as e:  # noqa: BLE001 - whatever the model raises
            return "", f"{type(e).__name__}: {e}"
        return (text, None) if text else ("", "no text")

    return run


class Remembered:
    """A recogniser that hears each content once and keeps the log of its calls in order.

    ``calls`` holds ``(number, key, hit)``. A log that is to be fresh must not exist.
    """

    def __init__(self, model: Callable[[bytes], str], identity: str = ""):
        self.model, self.identity, self.texts, self.calls = model, identity, {}, []

    def __call__(self, content: bytes) -> str:
        key = hashlib.sha256(self.identity.encode() + b"\n" + content).hexdigest()
        hit = key in self.texts
        if not hit:
            self.texts[key] = self.model(content)
        self.calls.append((len(self.calls), key, hit))
        return self.texts[key]
