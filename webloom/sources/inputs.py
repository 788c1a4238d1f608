"""Inputs of a job: url lists in any form, and configuration over defaults."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import utrim

#: The built-in configuration.
DEFAULTS = {
    "backend": "brave", "searxng_url": "http://localhost:8081", "brave_api_key": "", "limit": 5, "cache_ttl": "72h", "browser": "", "code_backend": "sourcegraph",
    "docs_backend": "context7", "context7_api_key": "", "sourcegraph_url": "https://sourcegraph.com", "github_token": "",
}
BACKENDS = {"web": ("brave", "ddg", "searxng"), "code": ("sourcegraph", "github"), "docs": ("context7", "local")}
SECRETS = ("brave_api_key", "context7_api_key", "github_token")


def line_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(url)``: trimmed lines without blanks and ``#`` comments; repeats stay."""
    return lines.select(utrim(F.col(col)).alias("url")).where("url <> '' and not startswith(url, '#')")


def resolve_inputs(spark: SparkSession, args: Sequence[str], stdin: Sequence[str] | None = None) -> DataFrame:
    """``(idx, url)``: several arguments, a JSON array, a file of lines, or one url; without arguments, piped lines."""
    rows = lambda urls: spark.createDataFrame(list(enumerate(urls)), "idx int, url string")
    clean = lambda ls: [x for x in map(str.strip, ls) if x and not x.startswith("#")]
    if len(args) > 1:
        return rows(args)
    if not args:
        if stdin is None:
            raise ValueError("no urls given")
        return rows(clean(stdin))
    one = args[0]
    if one.startswith("["):
        try:
            urls = json.loads(one)
        except ValueError as e:
            raise ValueError(f"invalid JSON array: {e}") from e
        if not urls or not all(isinstance(u, str) for u in urls):
            raise ValueError("an empty or invalid JSON array of urls")
        return rows(urls)
    if os.path.isfile(one):
        with open(one, encoding="utf-8") as f:
            return rows(clean(f))
    return rows([one])


def ordered(results: DataFrame) -> DataFrame:
    """Results in the order of their inputs, whatever ran first."""
    return results.orderBy("idx")


def merge_config(user: DataFrame, default: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Users' values over the defaults, field by field; the defaults have one row, ``also`` are columns that tell users apart."""
    u = user.select(*also, *[F.col(k).alias(f"u_{k}") for k in keys], F.lit(1).alias("__one"))
    d = default.select(*[F.col(k).alias(f"d_{k}") for k in keys], F.lit(1).alias("__one"))
    return d.join(u, "__one", "left").select(*also, *[F.coalesce(f"u_{k}", f"d_{k}").alias(k) for k in keys])


def load_config(path: str) -> dict:
    """JSON over the defaults; an unreadable or invalid file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return DEFAULTS | {k: v for k, v in given.items() if k in DEFAULTS}
    except (OSError, ValueError, AttributeError):
        return dict(DEFAULTS)


def save_config(path: str, config: dict) -> None:
    """Writes beside and renames, so that a reader never sees half a file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({k: v for k, v in config.items() if v not in ("", None) or k in ("backend", "searxng_url", "limit", "cache_ttl")}, f, indent=2)
    os.replace(f"{path}.tmp", path)


def set_config(config: dict, key: str, value: str) -> dict:
    """A checked copy with ``key`` set."""
    if key not in DEFAULTS:
        raise ValueError(f"unknown key {key!r}")
    kind = {"backend": "web", "code_backend": "code", "docs_backend": "docs"}.get(key)
    if kind and value not in BACKENDS[kind]:
        raise ValueError(f"unknown {kind} backend {value!r}")
    if key == "cache_ttl" and duration_seconds(value, None) is None:
        raise ValueError(f"invalid duration {value!r}")
    return config | {key: int(value) if key == "limit" else value}


def duration_seconds(text: str, fallback: float | None = 3600.0) -> float | None:
    """``72h``, ``1h30m``, ``250ms``; what can't be read is the fallback."""
    units = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|ms|s|m|h)", text or "")
    if "".join(a + b for a, b in parts) != (text or "").lstrip("+-") or not parts:
        return 0.0 if text == "0" else fallback
    total = sum(float(a) * units[b] for a, b in parts)
    return -total if text.startswith("-") else total


def resolve_token(config: dict, environ: dict | None = None) -> tuple[str, str]:
    """(token, source): configuration, then the environment; the source is config, env or none."""
    env = os.environ if environ is None else environ
    if config.get("github_token"):
        return config["github_token"], "config"
    for k in ("GITHUB_TOKEN", "GH_TOKEN"):
        if env.get(k):
            return env[k], "env"
    return "", "none"


def discover(config: dict, environ: dict | None = None) -> dict:
    """The configuration without secrets, where its token comes from, and the backends there are."""
    shown = {k: v for k, v in config.items() if k not in SECRETS}
    return shown | {"github_token_source": resolve_token(config, environ)[1]} | {f"{k}_backends": list(v) for k, v in BACKENDS.items()}
