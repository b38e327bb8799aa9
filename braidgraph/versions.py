"""Schema versions, compatibility, migrations and what to do when a stored graph can't be used."""

from __future__ import annotations

import time
import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

#: Fixed value: the version that compatibility is judged against.
CURRENT = (1, 0, 0)

FAILURES = {"file_not_found": "rebuild", "parse_error": "fail", "invalid_structure": "strict_fail", "corrupted_data": "rebuild", "schema_incompatible": "forced_action", "permission_error": "fail"}


class IncompatibleBaseline(Exception):
    pass


@dataclass(frozen=True, order=True)
class Version:
    major: int
    minor: int
    patch: int

    def __post_init__(self):
        for n in (self.major, self.minor, self.patch):
            if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                raise ValueError(f"version parts must be non-negative integers: {self.major}.{self.minor}.{self.patch}")

    @classmethod
    def parse(cls, text: str) -> Version:
        if not re.fullmatch(r"\d+\.\d+\.\d+", text or ""):
            raise ValueError(f"Invalid version: {text!r}")
        return cls(*map(int, text.split(".")))

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"

    def compatible_with(self, other: Version) -> bool:
        return self.major == other.major

    def fits(self, pattern: str) -> bool:
        """Whether a pattern such as ``1.x.x`` or ``legacy`` (0.0.0) names this version."""
        if pattern == "legacy":
            return (self.major, self.minor, self.patch) == (0, 0, 0)
        parts = pattern.split(".")
        return len(parts) <= 3 and all(p in ("x", "*") or p == str(n) for p, n in zip(parts, (self.major, self.minor, self.patch), strict=False))


def version_errors(given) -> list[str]:
    if not isinstance(given, dict):
        return ["schemaVersion must be an object"]
    out = []
    for k in ("major", "minor", "patch"):
        n = given.get(k)
        if not isinstance(n, (int, float)) or isinstance(n, bool):
            out.append(f"schemaVersion.{k} must be a number")
        elif n < 0:
            out.append(f"schemaVersion.{k} must be non-negative")
    return out


def compatibility(given: dict | None, current: tuple = CURRENT) -> dict:
    """compatible, reason and action for a stored version."""
    if not given:
        return {"compatible": False, "reason": "legacy_baseline", "action": "rebuild"}
    own, now = Version(given["major"], given["minor"], given["patch"]), Version(*current)
    if own.major != now.major:
        return {"compatible": False, "reason": "major_version_mismatch", "action": "error" if own > now else "migrate"}
    if own.minor < now.minor:
        return {"compatible": True, "reason": "minor_version_old", "action": "migrate"}
    if own.patch < now.patch:
        return {"compatible": True, "reason": "patch_version_old", "action": "proceed"}
    return {"compatible": True, "reason": "version_match", "action": "proceed"}


def action(result: dict, force: str | None = None, auto_migrate: bool = False) -> str:
    if force:
        return force
    return {
        "legacy_baseline": "rebuild",
        "major_version_mismatch": result["action"],
        "minor_version_old": "migrate" if auto_migrate else "proceed",
        "patch_version_old": "proceed",
        "version_match": "proceed",
    }.get(result["reason"], "error")


@dataclass(frozen=True)
class Migration:
    source: str
    target: Version
    run: Callable[[dict], dict]
    name: str = ""


@dataclass
class Migrations:
    """Registered steps between versions; a step with the same ends replaces the earlier one."""

    steps: list[Migration] = field(default_factory=list)

    def register(self, step: Migration) -> None:
        self.steps = [s for s in self.steps if (s.source, s.target) != (step.source, step.target)] + [step]

    def clear(self) -> None:
        self.steps = []

    def path(self, start: Version, goal: Version) -> list[Migration] | None:
        """A shortest chain of steps; None if there is none or nothing to do."""
        if start == goal:
            return None
        queue, seen = deque([(start, [])]), {start}
        while queue:
            at, way = queue.popleft()
            for s in self.steps:
                if at.fits(s.source) and s.target not in seen:
                    if s.target == goal:
                        return [*way, s]
                    seen.add(s.target)
                    queue.append((s.target, [*way, s]))
        return None

    def migrate(self, data: dict, goal: Version | None = None) -> dict:
        """data brought to a version, with a record of every step."""
        goal = goal or Version(*CURRENT)
        v = data.get("schemaVersion")
        start = Version(v["major"], v["minor"], v["patch"]) if v else Version(0, 0, 0)
        if start == goal:
            return data
        way = self.path(start, goal)
        if way is None:
            raise IncompatibleBaseline(f"No migration path from {start} to {goal}")
        for s in way:
            before = str(start)
            data = s.run(dict(data))
            data["schemaVersion"] = {"major": s.target.major, "minor": s.target.minor, "patch": s.target.patch}
            data["migrationHistory"] = [*data.get("migrationHistory", []), {"fromVersion": before, "toVersion": str(s.target), "migratedAt": int(time.time() * 1000), "strategy": "migrate"}]
            start = s.target
        return data

    def migrate_or_rebuild(self, data: dict, rebuild: Callable[[], dict] | None = None, goal: Version | None = None) -> dict:
        try:
            return self.migrate(data, goal)
        except Exception:
            if rebuild is None:
                raise
            return rebuild()


def on_failure(reason: str, rebuild: Callable | None = None, strict: bool = False, force: str | None = None, handler: Callable | None = None, details=None) -> dict:
    """What a failed load comes to: {"success", "graph"?, "action"?, "failure"?}."""
    if handler:
        return handler(reason, details)
    failed = {"success": False, "failure": {"reason": reason, "details": details}}
    plan = FAILURES.get(reason, "fail")
    if plan == "fail" or (plan == "strict_fail" and strict) or (plan == "forced_action" and force != "rebuild"):
        return failed
    if rebuild is None:
        return {"success": False, "failure": {"reason": reason, "details": "Rebuild handler not provided"}}
    try:
        return {"success": True, "graph": rebuild(), "action": "rebuild", "migrated": False}
    except Exception as e:
        return {"success": False, "failure": {"reason": reason, "details": e}}
