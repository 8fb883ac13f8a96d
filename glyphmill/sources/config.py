"""Configurations, numbers in them, and where files are (S16, S19, Z1-Z6, Z8, Z19, Z20). All of it runs on the driver."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable
from pathlib import Path

NOTHING = ("", "null", "none", "~")


def scalar(text: str):
    """Null, a boolean, a quoted text, a whole number, a number, or the text."""
    low = text.lower()
    if low in NOTHING:
        return None
    if low in ("true", "false"):
        return low == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def flat_yaml(text: str) -> dict:
    """Lines of key, colon and scalar; blank lines, comments and lines without a colon are skipped."""
    lines = (line.strip() for line in text.splitlines())
    pairs = (line.partition(":") for line in lines if line and not line.startswith("#") and ":" in line)
    return {k.strip(): scalar(v.strip()) for k, _, v in pairs}


def load_config(path: str | Path | None) -> dict:
    """YAML, JSON or TOML by suffix; an empty one without a path. YAML is read flat where no YAML library is installed."""
    if not path:
        return {}
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    text, kind = path.read_text(encoding="utf-8"), path.suffix.lower()
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            return flat_yaml(text)
        return yaml.safe_load(text) or {}
    if kind == ".json":
        return json.loads(text)
    if kind == ".toml":
        return tomllib.loads(text)
    raise ValueError(f"a configuration is YAML, JSON or TOML, not {kind}")


def optional_number(value, kind=float):
    """Null for null and blank; int means int(float(..)); anything else must be a number."""
    text = "" if value is None else str(value).strip()
    if not text:
        return None
    return int(float(text)) if kind is int else float(text)


def number(value, default, kind=float):
    """The value as it is or as kind reads it, else the default; '3.0' is no int."""
    try:
        return kind(value)
    except (TypeError, ValueError):
        return default


def first_number(values: Iterable, default, kind=int):
    """The first of the values that is a number."""
    for v in values:
        try:
            return kind(float(v))
        except (TypeError, ValueError):
            continue
    return default


def frequency_limit(value) -> int | float:
    """A share if it is written with a dot, else a count."""
    return float(value) if isinstance(value, float) or "." in str(value) else int(value)


def gram_range(value) -> tuple[int, int]:
    """Z6: 'low,high', or two numbers."""
    low, high = value.split(",") if isinstance(value, str) else value
    return int(low), int(high)


def comma_list(value) -> list[str]:
    """Z20."""
    return [p.strip() for p in str(value or "").split(",") if p.strip()]


def ratio_map(value: str) -> dict[str, float]:
    """V3: 'T1=.08,T2=.1'; parts that are no name and number are left out."""
    out = {}
    for k, _, v in (p.partition("=") for p in comma_list(value)):
        if (ratio := number(v.strip(), None)) is not None:
            out[k.strip()] = ratio
    return out


def pick(columns: list[str], wanted: Iterable[str], default: str | None = None) -> str | None:
    """The first of the wanted columns that there is."""
    return next((c for c in wanted if c and c in columns), default)


def root(start: str | Path | None = None) -> Path:
    """The nearest folder at or above start that has data or docs; start where there is none."""
    here = Path(start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / "data").exists() or (p / "docs").exists()), here)


def folder(kind: str, config: dict, given: str | None = None, start: str | Path | None = None) -> Path:
    """The data or artifacts folder: the given one, the configured one (`<kind>_dir`), else that of the root."""
    return Path(given or config.get(f"{kind}_dir") or root(start) / kind)


def resolved(path: str, *folders: str | Path) -> Path:
    """The path as it is, else under the first folder that has it, or that has a file of its name; itself if none does."""
    path = Path(path)
    places = [path, *(f / path for f in map(Path, folders)), *(f / path.name for f in map(Path, folders))]
    return next((p for p in places if p.exists()), path)
