"""Answers from outside (language models, web services): the interface, its mock, rate limits and the self-correction loop.

Nothing here opens a connection; a provider is given by the caller and runs in tasks through answered().
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quirework.functions.answers import coerced, read


class Provider(Protocol):
    def ask(self, prompt: str, model: str) -> str: ...


@dataclass
class Mock:
    """Answers in order, the last one again and again; exceptions are raised."""

    answers: list
    asked: list = field(default_factory=list)

    def ask(self, prompt: str, model: str) -> str:
        self.asked.append((model, prompt))
        a = self.answers[min(len(self.asked), len(self.answers)) - 1]
        if isinstance(a, Exception):
            raise a
        return a


def limited(error: str) -> tuple[bool, float | None]:
    """Is an error a rate limit, and how many seconds does it ask to wait?"""
    if not re.search(r"\b429\b|rate.?limit|too many requests", error, re.I):
        return False, None
    m = re.search(r"retry[- ]after(-ms)?\W+(\d+(?:\.\d+)?)", error, re.I)
    return True, (float(m[2]) / 1000 if m[1] else float(m[2])) if m else None


@dataclass
class Bucket:
    """A leaky bucket: `capacity` at once, then one each `interval` seconds. now and sleep are given, so tests need no clock."""

    interval: float
    capacity: int = 1
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    level: float | None = None
    at: float = 0.0

    def take(self) -> float:
        """Waits until a call is admitted; the seconds waited."""
        t = self.now()
        if self.level is None:
            self.level, self.at = float(self.capacity), t
        self.level, self.at = min(self.capacity, self.level + (t - self.at) / self.interval), t
        wait = max(0.0, (1 - self.level) * self.interval)
        self.level -= 1
        if wait > 1e-12:
            self.sleep(wait)
        return wait


@dataclass
class Cooldown:
    """A pause shared by all calls: base * 2^(n - 1) after n refusals in a row, the server's wish if longer, capped."""

    base: float = 5.0
    cap: float = 60.0
    failures: int = 0
    until: float = 0.0

    def refused(self, now: float, asked: float | None = None) -> float:
        self.failures += 1
        pause = min(self.cap, max(self.base * 2 ** (self.failures - 1), asked or 0))
        self.until = max(self.until, now + pause)
        return pause

    def succeeded(self) -> None:
        self.failures = 0


def prompt_for(evidence: dict, feedback: str | None = None, chars: int = 2000) -> str:
    """What is known of a record, the beginning of its text, and why an earlier answer failed."""
    parts = [f"{k}: {v}" for k, v in evidence.items() if k != "text" and v]
    parts.append("text:\n" + (evidence.get("text") or "")[:chars])
    if feedback:
        parts.append("The last answer was wrong: " + feedback)
    return "\n".join(parts)


def useful(answer: dict) -> bool:
    return bool(answer["title"] or answer["isbn"] or answer["authors"])


def loop(evidence: dict, provider: Provider, verify: Callable[[dict], str | None], cheap: str = "flash", strong: str = "high", tries: int = 2) -> tuple[dict | None, str | None]:
    """(answer, label): up to `tries` cheap attempts with feedback from `verify` (null: good), then one strong attempt.

    Labels: llm:flash for the first attempt, llm:loop for a corrected one, llm:high or llm:low for the strong one by its check."""
    feedback = None
    for i in range(tries):
        try:
            answer = coerced(read(provider.ask(prompt_for(evidence, feedback), cheap)))
        except Exception as e:  # noqa: BLE001  a failing call is an unusable answer
            feedback = str(e)
            continue
        if not useful(answer):
            feedback = "no usable fields"
            continue
        feedback = verify(answer)
        if feedback is None:
            return answer, "llm:flash" if i == 0 else "llm:loop"
    try:
        answer = coerced(read(provider.ask(prompt_for(evidence, feedback), strong)))
    except Exception:  # noqa: BLE001
        return None, None
    if not useful(answer):
        return None, None
    return answer, "llm:high" if verify(answer) is None else "llm:low"


def answered(rows: DataFrame, make: Callable[[], Provider], verify: Callable[[dict, dict], str | None], interval: float = 0.0) -> DataFrame:
    """(id, title, authors, isbn, year, label) for rows of id and evidence columns; a provider and a limiter for each task, errors are rows without
    an answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, bucket = make(), Bucket(interval) if interval else None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if bucket:
                    bucket.take()
                answer, label = loop({k: v for k, v in r.items() if k != "id"}, provider, lambda a, r=r: verify(r, a))
                a = answer or {"title": None, "authors": [], "isbn": None, "year": None}
                out.append({"id": r["id"], **a, "label": label})
            yield pd.DataFrame(out, columns=["id", "title", "authors", "isbn", "year", "label"]).astype({"year": "Int32"})

    return rows.mapInPandas(run, "id long, title string, authors array<string>, isbn string, year int, label string")
