"""Settings of a store, from defaults, a TOML file and the environment."""

from __future__ import annotations

import dataclasses
import logging
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

log = logging.getLogger(__name__)
#: Settings that Spark's own replace: its task slots, its file caches, and that there is no socket to listen on.
WITHOUT_EFFECT = {
    "net": ("host", "port"),
    "storage": ("concurrency", "readers_cache_size"),
}
#: Environment variables begin so; the parts of a setting's name are joined by two underscores.
PREFIX = "LOGLOOM"
MIB = 1024 * 1024


class ConfigError(ValueError):
    """A setting that is unknown, incomplete or out of range."""


# The defaults of all settings below.
@dataclass(frozen=True)
class Net:
    host: str = "0.0.0.0"
    port: int = 6379
    min_backoff_ms: int = 500
    max_backoff_ms: int = 64000
    max_connections: int = 128


@dataclass(frozen=True)
class Triggers:
    """A merge starts if any file is above one of these."""

    fragmentation: float = 0.6
    dead_bytes: int = 512 * MIB


@dataclass(frozen=True)
class Thresholds:
    """A merge takes in files above one of the first two, or smaller than the last."""

    fragmentation: float = 0.4
    dead_bytes: int = 128 * MIB
    small_file: int = 10 * MIB


@dataclass(frozen=True)
class Merge:
    """``policy``: always, never, or the hours ``(start, end)``, both included, between which to merge."""

    policy: str | tuple[int, int] = "always"
    check_interval_ms: int = 18000
    check_jitter: float = 0.3
    triggers: Triggers = field(default_factory=Triggers)
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        if isinstance(self.policy, tuple):
            if len(self.policy) != 2 or not all(0 <= h < 24 for h in self.policy):
                raise ConfigError("the hours of a merge window run from 0 to 23")
        elif self.policy not in ("always", "never"):
            raise ConfigError(f"no such merge policy: {self.policy!r}")


@dataclass(frozen=True)
class Storage:
    path: str = "."
    concurrency: int = field(default_factory=lambda: os.cpu_count() or 1)
    readers_cache_size: int = 256
    max_file_size: int = 2048 * MIB
    sync: str | int = "none"
    merge: Merge = field(default_factory=Merge)

    def __post_init__(self):
        if self.max_file_size <= 0:
            raise ConfigError("max_file_size must be positive")
        if not (self.sync in ("none", "always") or isinstance(self.sync, int)):
            raise ConfigError(f"no such sync strategy: {self.sync!r}")


@dataclass(frozen=True)
class Config:
    net: Net = field(default_factory=Net)
    storage: Storage = field(default_factory=Storage)


_WHOLE = (Triggers, Thresholds)
_NESTED = {"net": Net, "storage": Storage, "merge": Merge, "triggers": Triggers, "thresholds": Thresholds}


def _overlay(tree: dict, environ: Mapping[str, str]) -> dict:
    for name in sorted(environ):
        parts = name.split("__")
        if parts[0].upper() != PREFIX or len(parts) < 2:
            continue
        at = tree
        for part in parts[1:-1]:
            at = at.setdefault(part.lower(), {})
            if not isinstance(at, dict):
                raise ConfigError(f"{name} goes below a setting that has no parts")
        at[parts[-1].lower()] = environ[name]
    return tree


def _build(kind: type, tree: dict, where: str):
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(tree) - set(fields):
        raise ConfigError(f"unknown settings in {where}: {', '.join(sorted(unknown))}")
    if kind in _WHOLE and set(tree) != set(fields):
        raise ConfigError(f"{where} must be given as a whole")
    values = {}
    for name, value in tree.items():
        here = f"{where}.{name}"
        if name in _NESTED:
            values[name] = _build(_NESTED[name], value, here)
        elif name == "policy" and isinstance(value, dict):
            window = value.get("window", {})
            if set(value) != {"window"} or set(window) != {"start", "end"}:
                raise ConfigError(f"{here} must be always, never or a window with start and end")
            values[name] = (int(window["start"]), int(window["end"]))
        elif name == "sync" and isinstance(value, dict):
            if set(value) != {"interval_ms"}:
                raise ConfigError(f"{here} must be none, always or have interval_ms")
            values[name] = int(value["interval_ms"])
        else:
            kinds = {"int": int, "float": float}
            cast = kinds.get(str(fields[name].type), str)
            try:
                values[name] = cast(value)
            except (TypeError, ValueError) as e:
                raise ConfigError(f"{here}: {e}") from e
    return kind(**values)


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """The settings of a file, overridden by the environment; what neither names has its default.

    Without a file the two top-level tables may be missing; a file must have both.
    """
    tree: dict = {}
    if path:
        with open(path, "rb") as f:
            tree = tomllib.load(f)
    tree = _overlay(tree, os.environ if environ is None else environ)
    if path and not {"net", "storage"} <= set(tree):
        raise ConfigError("net and storage are required")
    for part, names in WITHOUT_EFFECT.items():
        for name in names:
            if name in tree.get(part, {}):
                log.warning("%s.%s has no effect: Spark's own settings take its place", part, name)
    return _build(Config, tree, "config")
