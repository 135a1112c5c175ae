"""Run settings from layers of YAML, and registries of readers and filters by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

import yaml

_NUMBER = re.compile(r"^-?\d+(\.\d*)?[eE]-?\d+$")
# Texts that stand for truth values.
_TRUE, _FALSE = {"y", "yes", "on", "t", "true", ".true."}, {"n", "no", "off", "f", "false", ".false."}


def convert(value: Any) -> Any:
    """Texts in scientific notation, infinities and truth values as what they mean; lists and maps throughout."""
    if isinstance(value, Mapping):
        return {k: convert(v) for k, v in value.items()}
    if isinstance(value, list):
        return [convert(v) for v in value]
    if not isinstance(value, str):
        return value
    low = value.strip().lower()
    if _NUMBER.match(value) or low in ("inf", "-inf"):
        return float(low)
    return True if low in _TRUE else False if low in _FALSE else value


def load(*files: str, args: list[str] | None = None, **settings: Any) -> dict[str, Any]:
    """Settings of the files in order, then of keywords, then of ``--key value`` arguments; later ones win."""
    out: dict[str, Any] = {}
    for name in files:
        with open(name) as text:
            out |= yaml.safe_load(text) or {}
    out |= settings
    args = list(args or [])
    while args:
        key = args.pop(0)
        if not key.startswith("--"):
            raise ValueError(f"unexpected argument {key!r}")
        out[key[2:]] = yaml.safe_load(args.pop(0)) if args and not args[0].startswith("--") else True
    return convert(out)


class Registry:
    """Functions by lower-case name; a name that isn't there is an error."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self._known[name.lower()] = f
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        if name.lower() not in self._known:
            raise NotImplementedError(f"{self.kind} {name!r}")
        return self._known[name.lower()]

    def __iter__(self):
        return iter(sorted(self._known))
