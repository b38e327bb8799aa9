"""Configuration: compression settings and naming rules, validated field by field."""

from __future__ import annotations

import json
import os
import re

from ..operators.layers import NAMING_RULES

FOLDER, NAME = ".braidgraph", "config.json"
DEFAULTS = {"compression": {"enabled": True, "jsDocMaxLength": 100}}


class ConfigError(Exception):
    code = "E_INVALID_CONFIG"


def config_errors(given) -> list[str]:
    if not isinstance(given, dict):
        return ["Config must be an object"]
    out, c = [], given.get("compression")
    if c is None:
        return out
    if not isinstance(c, dict):
        return ["compression must be an object"]
    if "enabled" in c and not isinstance(c["enabled"], bool):
        out.append("compression.enabled must be a boolean")
    n = c.get("jsDocMaxLength")
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n <= 0):
        out.append("compression.jsDocMaxLength must be a positive integer")
    return out


def rule_errors(rule) -> list[str]:
    if not isinstance(rule, dict):
        return ["rule must be an object"]
    out = []
    pattern = rule.get("pattern")
    if not isinstance(pattern, str) or not pattern.strip():
        out.append("pattern must be a non-empty string")
    else:
        try:
            re.compile(pattern)
        except re.error as e:
            out.append(f"pattern is not a regular expression: {e}")
    if not isinstance(rule.get("role"), str) or not rule["role"].strip():
        out.append("role must be a non-empty string")
    p = rule.get("priority")
    if isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 100:
        out.append("priority must be a number from 0 to 100")
    return out


def naming_rules(given) -> tuple[list[tuple], list[str]]:
    """(default rules followed by the valid given ones, warnings about the others)."""
    if given is None:
        return list(NAMING_RULES), []
    if not isinstance(given, list):
        return list(NAMING_RULES), ["layerNaming.rules must be an array"]
    good, warnings = [], []
    for i, rule in enumerate(given):
        errors = rule_errors(rule)
        if errors:
            warnings.append(f"rule {i}: {'; '.join(errors)}")
        else:
            good.append((rule["pattern"], rule["role"], int(rule["priority"])))
    return [*NAMING_RULES, *good], warnings


def load(root: str) -> dict:
    """compression, rules and warnings of a project; a missing file means the defaults."""
    path = os.path.join(root, FOLDER, NAME)
    if not os.path.exists(path):
        return {"compression": dict(DEFAULTS["compression"]), "rules": list(NAMING_RULES), "warnings": []}
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except ValueError as e:
        raise ConfigError(f"{path} is not JSON: {e}") from e
    errors = config_errors(given)
    if errors:
        raise ConfigError("; ".join(errors))
    rules, warnings = naming_rules((given.get("layerNaming") or {}).get("rules") if isinstance(given.get("layerNaming"), dict) else given.get("namingRules"))
    return {"compression": DEFAULTS["compression"] | (given.get("compression") or {}), "rules": rules, "warnings": warnings}
