"""Configuration files: contracts, excludes, roles and coupling; policy rules; skeletons; catalogues.

YAML is read where the yaml package is installed; JSON, which is YAML too, always. Unknown fields of
a configuration are errors, a missing file is an empty configuration.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from loomgraph.operators.patterns import Skeleton
from loomgraph.operators.service import coupling_rules

CONFIG_NAME = ".archmotif.yaml"


def parse(text: str) -> Any:
    try:
        return json.loads(text) if text.strip() else {}
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("this file is not JSON, and no YAML reader is installed") from e
        return yaml.safe_load(text) or {}


def _known(doc: dict, names: set[str], where: str) -> dict:
    if not isinstance(doc, dict):
        raise ValueError(f"{where} must be a mapping")
    if odd := sorted(set(doc) - names):
        raise ValueError(f"unknown field {odd[0]!r} in {where}")
    return doc


@dataclass(frozen=True)
class Config:
    contracts: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    exclude_packages: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # (glob, role), the first that fits wins
    forbidden: tuple[tuple[str, str, str], ...] = ()  # (from, to, reason)


def load_config(folder: str) -> Config:
    path = os.path.join(folder, CONFIG_NAME)
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        doc = _known(parse(f.read()), {"contracts", "exclude", "roles", "coupling"}, "the configuration")
    exclude = _known(doc.get("exclude") or {}, {"dirs", "packages"}, "exclude")
    coupling = _known(doc.get("coupling") or {}, {"forbidden"}, "coupling")
    contracts = tuple(doc.get("contracts") or ())
    for c in contracts:
        if not isinstance(c, str) or "." not in c:
            raise ValueError(f"a contract is package.Name; {c!r} isn't")
    roles = tuple((r["glob"], r["role"]) for r in (_known(x, {"glob", "role"}, "roles") for x in doc.get("roles") or ()))
    rules = [(r.get("from", ""), r.get("to", ""), r.get("reason", "")) for r in (_known(x, {"from", "to", "reason"}, "coupling.forbidden") for x in coupling.get("forbidden") or ())]
    return Config(contracts, tuple(exclude.get("dirs") or ()), tuple(exclude.get("packages") or ()), roles, tuple(coupling_rules(rules)))


@dataclass(frozen=True)
class Policy:
    partition: str
    allow: tuple[tuple[str, str], ...] = ()
    sink: tuple[str, ...] = field(default=())


def parse_policy(text: str) -> Policy:
    doc = _known(parse(text), {"partition", "allow", "sink"}, "the policy")
    if not doc.get("partition"):
        raise ValueError("a policy needs a partition")
    return Policy(doc["partition"], tuple((r["from"], r["to"]) for r in doc.get("allow") or ()), tuple(doc.get("sink") or ()))


def parse_skeleton(text: str) -> Skeleton:
    return Skeleton.parse(parse(text))


CATALOG_VERSION = 1


def load_catalog(path: str) -> list[dict]:
    """The snapshots of a catalogue file, by label; a missing file has none, another version is an error."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        doc = parse(f.read())
    if doc.get("version", CATALOG_VERSION) != CATALOG_VERSION:
        raise ValueError(f"unknown catalogue version {doc['version']}")
    return sorted(doc.get("snapshots") or [], key=lambda s: s["label"])


def save_catalog(path: str, snapshots: list[dict]) -> None:
    """Write a catalogue whole and then put it in its place; a snapshot replaces an earlier one of its label."""
    by_label = {s["label"]: s for s in snapshots}
    text = json.dumps({"version": CATALOG_VERSION, "snapshots": [by_label[k] for k in sorted(by_label)]}, indent=2)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    os.replace(part, path)


# Folders that hold no packages of a source tree.
SKIPPED_DIRS = ("vendor", "testdata", "node_modules")


def _excluded(path: str, rules: tuple[str, ...]) -> bool:
    """A rule with a slash fits exactly or as a prefix, one without fits any segment."""
    return any(path == r or path.startswith(r.rstrip("/") + "/") if "/" in r else r in path.split("/") for r in rules)


def package_dirs(root: str, patterns: tuple[str, ...] = ("./...",), excludes: tuple[str, ...] = (), suffix: str = ".go", tests: bool = False) -> list[str]:
    """The folders below ``root`` that patterns name and that hold sources: ``x`` is one folder, ``x/...`` all below it."""
    out = set()
    for pattern in patterns:
        base, deep = (pattern[: -len("...")].rstrip("/"), True) if pattern.endswith("...") else (pattern, False)
        base = os.path.normpath(base or ".")
        for folder, dirs, files in os.walk(os.path.join(root, base)):
            path = os.path.relpath(folder, root).replace(os.sep, "/")
            dirs[:] = sorted(d for d in dirs if deep and d not in SKIPPED_DIRS and d[0] not in "._" and not _excluded(d if path == "." else f"{path}/{d}", excludes))
            if any(f.endswith(suffix) and (tests or not f.endswith("_test" + suffix)) for f in files):
                out.add(path)
    return sorted(out)
