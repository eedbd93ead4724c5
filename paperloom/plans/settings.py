"""Profiles and review settings: configuration of the driver, not data."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any, Protocol

PROFILES = ("standard", "scanned", "visual")


@dataclass(frozen=True)
class Profile:
    """What a converter should do for a kind of document."""

    name: str
    do_ocr: bool = True
    force_full_page_ocr: bool = False
    table_structure: bool = True
    picture_classification: bool = False
    chart_extraction: bool = False
    page_images: bool = False
    picture_images: bool = True
    max_pages: int = 500
    max_bytes: int = 100 * 1024 * 1024

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile: {name}")
    return Profile(name, force_full_page_ocr=name == "scanned", picture_classification=name == "visual", chart_extraction=name == "visual")


def env_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    return env[name].strip().lower() in ("1", "true", "yes", "on") if name in env else default


def env_number(env: Mapping[str, str], name: str, default: float, low: float, high: float) -> float:
    """A number within bounds; the default where it can't be read."""
    try:
        value = type(default)(env.get(name, default))
    except ValueError:
        return default
    return min(high, max(low, value))


@dataclass(frozen=True)
class ReviewSettings:
    """Limits of a review run."""

    enabled: bool = False
    api_key: str | None = None
    max_candidates: int = 5
    max_requests: int = 7
    max_verifications: int = 2
    max_total_tokens: int = 60_000
    max_runtime_seconds: float = 300.0
    request_timeout_seconds: float = 45.0
    budget: float = 100.0
    request_reserve: float = 5.0
    price_in: float = 1.5
    price_out: float = 9.0
    exchange_rate: float = 100.0

    @property
    def usable(self) -> bool:
        return bool(self.api_key) and self.enabled

    def public(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k != "api_key"} | {"configured": self.usable}


def review_settings(enabled: bool | None = None, env: Mapping[str, str] | None = None, prefix: str = "PAPERLOOM_REVIEW_") -> ReviewSettings:
    env = os.environ if env is None else env
    n = lambda k, d, a, z: env_number(env, prefix + k, d, a, z)
    return ReviewSettings(
        enabled=env_bool(env, prefix + "ENABLED", False) if enabled is None else enabled,
        api_key=env.get(prefix + "KEY") or None,
        max_candidates=n("CANDIDATES", 5, 1, 100),
        max_requests=n("REQUESTS", 7, 1, 500),
        max_verifications=n("VERIFICATIONS", 2, 0, 100),
        max_total_tokens=n("TOKENS", 60_000, 1_000, 10_000_000),
        max_runtime_seconds=n("SECONDS", 300.0, 1.0, 86_400.0),
        budget=n("BUDGET", 100.0, 0.0, 1e9),
    )


#: A response and what it used: input_tokens, output_tokens, thought_tokens.
Answer = tuple[dict[str, Any], dict[str, int]]


class Reviewer(Protocol):
    """The model call, given from outside: two passes over one candidate, each giving a dict and a usage count."""

    def extract(self, candidate: dict[str, Any]) -> Answer: ...

    def verify(self, candidate: dict[str, Any], extraction: dict[str, Any]) -> Answer: ...


class Converter(Protocol):
    """What turns a PDF or an image into a document graph (JSON text), given from outside."""

    def convert(self, content: bytes, options: dict[str, Any]) -> str: ...
