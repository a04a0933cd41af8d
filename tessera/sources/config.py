"""Router settings from a YAML file: a flat mapping of names to numbers, words, true or false, null, and lists."""

from __future__ import annotations

import dataclasses
from pathlib import Path

from tessera.operators.router import RouterConfig


def _value(text: str):
    text = text.strip().strip("\"'")
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_flat_yaml(text: str) -> dict:
    """Enough of YAML for settings; comments and blank lines are skipped, and lists may stand in brackets or on lines of their own."""
    out: dict = {}
    name = None
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        if line.lstrip().startswith("- ") and name is not None:
            out[name] = [*(out[name] or []), _value(line.lstrip()[2:])]
        elif ":" in line and not line[0].isspace():
            name, _, value = line.partition(":")
            name = name.strip()
            out[name] = _value(value)
        else:
            raise ValueError(f"line {number} is not a flat setting")
    return out


def load_config(path: str) -> RouterConfig:
    """Unknown names are an error; missing ones keep their defaults."""
    found = parse_flat_yaml(Path(path).read_text(encoding="utf-8"))
    known = {f.name for f in dataclasses.fields(RouterConfig)}
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return RouterConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
