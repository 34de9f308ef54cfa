"""A project's own rules in one JSON file: conventions with denials, layers, taint sources, sinks and sanitizers.

The file is small and read by the driver alone; its rules become expressions or literals of the operators.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

NAME = ".tessera-rules.json"
KINDS = {"source": "sources", "sink": "sinks", "sanitizer": "sanitizers"}


def load(root: str | Path) -> dict:
    """The rules below ``root``; empty where there is no file or no JSON object in it."""
    try:
        found = json.loads((Path(root) / NAME).read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(root: str | Path, rules: dict) -> Path:
    """Writes all rules at once: readers see the old file or the new one."""
    path = Path(root) / NAME
    handle, name = tempfile.mkstemp(dir=root, prefix=NAME)
    with os.fdopen(handle, "w") as f:
        json.dump({"version": 1} | rules, f, indent=2, ensure_ascii=False)
    os.replace(name, path)
    return path


def _list(rules: dict, *keys: str) -> list:
    at = rules
    for key in keys[:-1]:
        at = at.setdefault(key, {})
    return at.setdefault(keys[-1], [])


def _add(root: str | Path, keys: tuple[str, ...], by: str, entry: dict) -> dict:
    rules = load(root)
    items = _list(rules, *keys)
    if any(x.get(by) == entry[by] for x in items):
        return {"status": "already_exists", by: entry[by]}
    items.append(entry)
    return {"status": "added", by: entry[by], "path": str(save(root, rules))}


def _remove(root: str | Path, keys: tuple[str, ...], by: str, value: str) -> dict:
    rules = load(root)
    items = _list(rules, *keys)
    left = [x for x in items if x.get(by) != value]
    if len(left) == len(items):
        return {"status": "not_found", by: value}
    items[:] = left
    return {"status": "removed", by: value, "path": str(save(root, rules))}


def add_rule(root, category: str, rule: str, glob_deny: list[str] | None = None, grep_deny: list[dict] | None = None, **said) -> dict:
    return _add(root, ("rules", category), "rule", {"rule": rule} | {k: v for k, v in {"glob_deny": glob_deny, "grep_deny": grep_deny, **said}.items() if v})


def remove_rule(root, category: str, rule: str) -> dict:
    return _remove(root, ("rules", category), "rule", rule)


def add_layer(root, name: str, globs: list[str], can_import: list[str] | None = None, cannot_import: list[str] | None = None) -> dict:
    return _add(root, ("layers",), "name", {"name": name, "globs": globs, "can_import": can_import or [], "cannot_import": cannot_import or []})


def remove_layer(root, name: str) -> dict:
    return _remove(root, ("layers",), "name", name)


def add_taint_source(root, pattern: str, language: str = "python") -> dict:
    return _add(root, ("taint", "sources"), "pattern", {"pattern": pattern, "language": language})


def add_taint_sink(root, pattern: str, category: str = "custom", severity: str = "high") -> dict:
    return _add(root, ("taint", "sinks"), "pattern", {"pattern": pattern, "category": category, "severity": severity})


def add_taint_sanitizer(root, pattern: str, cleanses: list[str] | None = None) -> dict:
    return _add(root, ("taint", "sanitizers"), "pattern", {"pattern": pattern, "cleanses": cleanses or ["*"]})


def remove_taint_rule(root, kind: str, pattern: str) -> dict:
    if kind not in KINDS:
        return {"error": f"Unknown kind: {kind}"}
    return _remove(root, ("taint", KINDS[kind]), "pattern", pattern)


def list_taint_rules(root) -> dict:
    taint = load(root).get("taint", {})
    return {k: list(taint.get(k, [])) for k in KINDS.values()} | {"overrides": dict(taint.get("overrides", {}))}


def denials(rules: dict) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """Globs that no file may fit and patterns that no line may hold, by rule, as ``operators.rules`` takes them."""
    files, lines = {}, {}
    for entries in rules.get("rules", {}).values():
        for e in entries:
            for k, g in enumerate(e.get("glob_deny", [])):
                files[f"{e['rule']} [{k}]" if k else e["rule"]] = g
            for k, g in enumerate(e.get("grep_deny", [])):
                g = {"pattern": g} if isinstance(g, str) else g
                lines[f"{e['rule']} [{k}]" if k else e["rule"]] = (g["pattern"], g.get("glob", "**"))
    return files, lines


def layers(rules: dict) -> tuple[dict, dict, dict]:
    """Globs, permissions and denials by layer, as ``operators.rules.layer_breaches`` takes them."""
    all_ = rules.get("layers", [])
    return tuple({x["name"]: x.get(k, []) for x in all_} for k in ("globs", "can_import", "cannot_import"))


@dataclass
class Taint:
    """Sources by language, sinks (pattern, severity) by category, sanitizers (call, categories): the built-in ones and a project's."""

    sources: dict[str, list[str]] = field(default_factory=dict)
    sinks: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    sanitizers: list[tuple[str, list[str]]] = field(default_factory=list)

    @classmethod
    def of(cls, sources: dict, sinks: dict, sanitizers: list, own: dict | None = None) -> Taint:
        own = own or {}
        gone = own.get("overrides", {})
        kept = lambda items, k: [x for x in items if (x if isinstance(x, str) else x[0]) not in set(gone.get(k, []))]
        out = cls({k: list(v) for k, v in sources.items()}, {k: list(v) for k, v in sinks.items()}, list(sanitizers))
        for x in own.get("sources", []):
            out.sources.setdefault(x.get("language", "python"), []).append(x["pattern"])
        for x in own.get("sinks", []):
            out.sinks.setdefault(x.get("category", "custom"), []).append((x["pattern"], x.get("severity", "high")))
        out.sanitizers += [(x["pattern"], x.get("cleanses", ["*"])) for x in own.get("sanitizers", [])]
        out.sources = {k: kept(v, "remove_sources") for k, v in out.sources.items()}
        out.sinks = {k: kept(v, "remove_sinks") for k, v in out.sinks.items()}
        return out
