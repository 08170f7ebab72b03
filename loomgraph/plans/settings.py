"""Limits from the environment or the session, with defaults.

A name such as ``max_files`` is read from ``LOOMGRAPH_MAX_FILES``, then from the
session's ``loomgraph.max_files``; what is absent, no number, or not above 0
leaves the default.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

TRUE = ("1", "true", "yes", "on")
#: Names that have to be set where LOOMGRAPH_ENV is production.
REQUIRED = ("LOOMGRAPH_MODEL_KEY",)


class StartupError(RuntimeError):
    """The process must not start like this."""


@dataclass(frozen=True)
class Limits:
    """Bounds of a scan."""

    max_file_bytes: int = 1 << 20
    max_files: int = 5000
    max_depth: int = 25
    max_wall_seconds: float = 120.0
    max_total_bytes: int = 256 << 20


def number(raw: str | None, default: Any) -> Any:
    """``raw`` in the type of ``default``, or the default."""
    try:
        value = type(default)((raw or "").strip())
    except ValueError:
        return default
    return value if value > 0 else default


def truth(raw: str | None, default: bool = False) -> bool:
    return default if raw is None else raw.strip().lower() in TRUE


def lookup(spark: SparkSession | None = None, env: Mapping[str, str] | None = None) -> Callable[[str], str | None]:
    env = os.environ if env is None else env

    def find(name: str) -> str | None:
        found = env.get(f"LOOMGRAPH_{name.upper()}")
        return found if found is not None or spark is None else spark.conf.get(f"loomgraph.{name}", None)

    return find


def of(cls: type, spark: SparkSession | None = None, env: Mapping[str, str] | None = None, prefix: str = "") -> Any:
    """A dataclass of numbers, each field looked up (as ``prefix`` and its name)."""
    find = lookup(spark, env)
    return cls(**{f.name: number(find(prefix + f.name), f.default) for f in fields(cls)})


def check_start(env: Mapping[str, str] | None = None) -> None:
    """Refuses to run in production without what is required there."""
    env = os.environ if env is None else env
    missing = [n for n in REQUIRED if not env.get(n, "").strip()]
    if env.get("LOOMGRAPH_ENV", "").strip().lower() == "production" and missing:
        raise StartupError(f"in production, set {', '.join(missing)}")
