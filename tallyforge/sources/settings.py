"""Settings from the environment or a .env file, by prefix. Names and defaults."""

from __future__ import annotations

import os
import types
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, Self, Union, get_args, get_origin, get_type_hints


def parsed(text: str, kind: Any) -> Any:
    if get_origin(kind) in (Union, types.UnionType):
        return None if text.strip().lower() in ("", "none", "null") else parsed(text, get_args(kind)[0])
    if kind is bool:
        known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        if text.strip().lower() not in known:
            raise ValueError(f"{text!r} is neither true nor false")
        return known[text.strip().lower()]
    return kind(text)


def env_file(path: str | Path) -> dict[str, str]:
    """Names and values of a .env file: comments and blank lines apart, quotes taken off."""
    lines = Path(path).read_text().splitlines() if Path(path).exists() else []
    pairs = (line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, value in pairs}


class FromEnv:
    PREFIX = ""

    @classmethod
    def load(cls, file: str | Path = ".env") -> Self:
        """The environment goes before the file, and the file before the defaults; names are in any case."""
        known = {k.upper(): v for k, v in (env_file(file) | dict(os.environ)).items()}
        kinds = get_type_hints(cls)
        given = {f.name: known[name] for f in fields(cls) if (name := f"{cls.PREFIX}{f.name}".upper()) in known}
        return cls(**{name: parsed(text, kinds[name]) for name, text in given.items()})


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


@dataclass
class Bench(FromEnv):
    PREFIX = "BENCH_"
    endpoint: str = "http://localhost:11434/v1"
    model: str = "qwen3:8b"
    concurrency: int = 2
    timeout: float = 60.0
    connect_timeout: float = 10.0
    min_generation_tok_s: float = 20.0
    prefill_allowance: float = 120.0
    max_attempts: int = 3
    retry_backoff: float = 1.0
    output_dir: str = "./results"
    api_key: str = ""
    max_tokens: int = 8192
    temperature: float | None = None
    thinking: bool | None = None
    trials: int = 1
    seed: int = 0
    sandbox_memory_mb: int = 256
    allow_unsandboxed: bool = False
    code_timeout: float = 5.0
    sanity_check_after: int = 3


@dataclass
class Probe(FromEnv):
    PREFIX = "PROBE_"
    models: str = "qwen3.5-4b,gemma-4-12b,qwen3.6-27b"
    dir: str = ".scratch/probe"
    trials: int = 3
    max_cycles: int = 3
    cycle_timeout: float = 600.0
    fleet_order: str = ""

    def cohort(self) -> list[str]:
        """Models in declared order, weakest first; it is never sorted again."""
        return listed(self.models)

    def fleet(self) -> list[str]:
        return listed(self.fleet_order)


@dataclass
class Judge(FromEnv):
    PREFIX = "JUDGE_"
    endpoint: str = "https://generativelanguage.googleapis.com/v1beta/openai"
    model: str = "gemini-2.5-flash"
    api_key: str = ""
    concurrency: int = 4
    timeout: float = 120.0
    max_tokens: int = 32768
    temperature: float = 0.0
    max_attempts: int = 6
    retry_backoff: float = 4.0
