"""Configurations with typed keys and defaults."""

from __future__ import annotations

from typing import Any


class ConfigError(ValueError):
    pass


_KINDS = {"integer": int, "float": float, "string": str, "boolean": lambda x: {"true": True, "false": False, "1": True, "0": False}[str(x).strip().lower()]}


def validated(given: dict[str, Any], spec: dict[str, tuple]) -> dict[str, Any]:
    """spec: key -> (kind,) for a key that must be given, or (kind, default). Unknown keys and values that
    are not of their kind are errors; all errors are told at once."""
    errors = [f"unknown key {k}" for k in given if k not in spec]
    out = {}
    for key, (kind, *default) in spec.items():
        if key not in given:
            if not default:
                errors.append(f"{key} is missing")
            else:
                out[key] = default[0]
            continue
        try:
            out[key] = _KINDS[kind](given[key])
        except (ValueError, KeyError, TypeError):
            errors.append(f"{key} is not of kind {kind}: {given[key]!r}")
    if errors:
        raise ConfigError("; ".join(errors))
    return out
