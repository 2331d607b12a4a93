"""Configuration: defaults, layers of TOML over them, and what they must satisfy. Driver-side."""

from __future__ import annotations

import copy
import tomllib
from typing import Any

# The defaults.
DEFAULTS: dict[str, Any] = {
    "schema_version": 1,
    "project": {"roots": ["."]},
    "indexing": {"exclude_paths": [], "exclude_extensions": [], "max_file_size_bytes": 2 << 20, "respect_gitignore": True, "index_docs": True, "index_config": True},
    "retrieval": {"default_mode": "hybrid", "default_limit": 50, "centrality_boost": 0.15, "regex_size_limit_bytes": 10 << 20},
    "context": {"default_token_budget": 8192, "padding_lines": 2, "include_blast_radius": True, "include_verbatim_source": True},
    "daemon": {"watch_debounce_ms": 150, "idle_timeout_secs": 600},
    "intelligence": {
        "providers": {},
        "embedding": {"provider": "none", "dimension": 256},
        "rerank": {"provider": "none", "top_n": 50, "deadline_ms": 100, "agent_cmd": ""},
    },
}
MODES = ("hybrid", "graph", "direct", "regex")
UNITED = {("indexing", "exclude_paths"), ("indexing", "exclude_extensions")}


class ConfigError(ValueError):
    pass


def merged(base: dict, over: dict, path: tuple[str, ...] = ()) -> dict:
    """`over` on `base`: scalars replace, exclusion lists unite (in order, once each), tables merge."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        here = (*path, k)
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v, here)
        elif here in UNITED:
            out[k] = list(dict.fromkeys([*out.get(k, []), *v]))
        else:
            out[k] = copy.deepcopy(v)
    return out


def load(*layers: str, project: str | None = None) -> dict:
    """Defaults, then layers of TOML text (system, user), then the project's, which may carry no credentials; validated."""
    out = DEFAULTS
    for text in [*layers, *([project] if project is not None else [])]:
        try:
            layer = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e
        if text is project:
            without_credentials(layer)
        out = merged(out, layer)
    return validated(out)


def without_credentials(layer: dict) -> None:
    held = layer.get("intelligence", {})
    if held.get("providers"):
        raise ConfigError("providers belong to the user's configuration, not the project's")
    for name, part in held.items():
        if isinstance(part, dict) and part.get("api_key_env") is not None:
            raise ConfigError(f"credentials ({name}) belong to the user's configuration, not the project's")


def validated(config: dict) -> dict:
    if config["schema_version"] != 1:
        raise ConfigError(f"schema version {config['schema_version']} is not 1")
    roots = config["project"]["roots"]
    if not roots:
        raise ConfigError("there are no project roots")
    for root in roots:
        if root.startswith("../") or "/../" in root:
            raise ConfigError(f"root {root} leads out of the project")
    for section, key in (("retrieval", "regex_size_limit_bytes"), ("indexing", "max_file_size_bytes")):
        if config[section][key] <= 0:
            raise ConfigError(f"{section}.{key} must be greater than 0")
    if config["retrieval"]["default_mode"] not in MODES:
        raise ConfigError(f"mode {config['retrieval']['default_mode']} is none of {', '.join(MODES)}")
    return config
