"""Two-level configuration: files, environment, retention rules."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Environment variable, section, key, and how its text is read.
ENVIRONMENT = (
    ("AC_LOG_LEVEL", "output", "log_level", {}),
    ("AC_KEEP_INTERMEDIATES", "output", "keep_intermediates", {"1": True}),
    ("AC_KEEP_CORRECTION_ARTIFACTS", "output", "keep_correction_artifacts", {"1": True, "0": False}),
    ("AC_INTERACTIVE", "interactive", "enabled", {"1": True}),
    ("AC_SEGMENT_SIZE", "audio", "segment_size_sec", int),
)


def overlay(config: Mapping[str, Any], environment: Mapping[str, str]) -> dict[str, Any]:
    """config with what the environment sets: environment before file before default."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    for name, section, key, rule in ENVIRONMENT:
        raw = environment.get(name, "")
        if raw and (rule == {} or rule is int or raw in rule):
            value = int(raw) if rule is int else rule.get(raw, raw)
            out.setdefault(section, {})[key] = value
    return out


def load(path: str | Path, environment: Mapping[str, str]) -> dict[str, Any]:
    """A JSON or YAML file, empty if absent, under the environment."""
    path, config = Path(path), {}
    if path.exists():
        text = path.read_text()
        if path.suffix == ".json":
            config = json.loads(text or "{}")
        else:
            try:
                import yaml
            except ImportError:
                config = {}
            else:
                config = yaml.safe_load(text) or {}
    return overlay(config, environment)


def get(config: Any, *keys: str, default: Any = None) -> Any:
    """The nested value; default where a step is absent or null."""
    for key in keys:
        config = config.get(key) if isinstance(config, Mapping) else None
    return default if config is None else config


def setting(environment: Column, file: Column, default: Column) -> Column:
    """The same precedence for columns of text; null counts as absent."""
    return F.coalesce(environment, file, default)


def keeps(keep_intermediates: Column, keep_corrections: Column, is_correction: Column) -> Column:
    """Whether an intermediate file stays: always with keep_intermediates, and files for corrections by default."""
    return F.coalesce(keep_intermediates, F.lit(False)) | (is_correction & F.coalesce(keep_corrections, F.lit(True)))
