"""The policy of a run: thresholds and switches, resolved from defaults, a JSON object and explicit values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from .profiles import Profile, get_profile


@dataclass(frozen=True)
class Policy:
    profile: str = "generic"
    min_characters: int = 5
    max_characters: int = 100_000
    min_script_ratio: float | None = None
    low_script_action: str = "flag"
    max_unexpected_script_ratio: float = 0.10
    max_symbol_ratio: float = 0.40
    max_url_ratio: float = 0.30
    repeated_character_run: int = 15
    consecutive_word_run: int = 5
    max_repeated_word_ratio: float = 0.70
    min_unique_trigram_ratio: float = 0.35
    exact_dedup: bool = True
    near_dedup: bool = False
    near_duplicate_threshold: float = 0.85
    shingle_size: int = 3
    lsh_bands: int = 8
    lsh_rows: int = 4
    max_lsh_candidates: int = 1_000
    mask_pii: bool = True
    sample_limit: int = 5

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


KINDS = {f.name: str(f.type) for f in fields(Policy)}


def checked(policy: Policy) -> Policy:
    """The policy itself, or ValueError if a value is of the wrong type or out of range."""
    for name, kind in KINDS.items():
        value = getattr(policy, name)
        if kind == "int" and (isinstance(value, bool) or not isinstance(value, int)):
            raise ValueError(f"{name} must be an integer")
        if kind == "bool" and not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false")
        if kind.startswith("float") and not (value is None and "None" in kind):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{name} must be a number")
            if not 0 <= value <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
    if not 0 <= policy.min_characters <= policy.max_characters:
        raise ValueError("min_characters must be at least 0 and at most max_characters")
    if policy.low_script_action not in ("flag", "reject"):
        raise ValueError("low_script_action must be flag or reject")
    if policy.sample_limit < 0:
        raise ValueError("sample_limit must not be negative")
    if min(policy.repeated_character_run, policy.consecutive_word_run) < 2:
        raise ValueError("runs must be at least 2")
    if min(policy.shingle_size, policy.lsh_bands, policy.lsh_rows, policy.max_lsh_candidates) < 1:
        raise ValueError("sizes of near deduplication must be at least 1")
    if policy.near_duplicate_threshold <= 0:
        raise ValueError("near_duplicate_threshold must be above 0")
    return policy


def resolved(config: Mapping[str, Any] | None = None, **explicit: Any) -> tuple[Policy, Profile]:
    """Defaults, overridden by ``config``, overridden by explicit values that aren't None.

    The profile's own least script ratio holds unless ``config`` has the key, even with null.
    """
    config = dict(config or {})
    if unknown := sorted(set(config) - set(KINDS)):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
    given = {name: value for name, value in explicit.items() if value is not None}
    profile = get_profile(given.pop("profile", None) or config.pop("profile", "generic"))
    config.pop("profile", None)
    config.setdefault("min_script_ratio", profile.min_script_ratio)
    return checked(Policy(**(config | given | {"profile": profile.key}))), profile


def loaded(path: str | Path | None) -> dict[str, Any]:
    """A policy file: one JSON object."""
    if path is None:
        return {}
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise ValueError(f"cannot load the configuration {path}: {error}") from error
    if not isinstance(value, dict):
        raise ValueError("the configuration must be a JSON object")
    return value
