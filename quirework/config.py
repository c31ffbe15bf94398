"""Settings by precedence: given values, the environment, the nearest .env file, defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

LEVELS = 20


@dataclass(frozen=True)
class Config:
    library: str = "."
    path_pattern: str = "{author}/{title} ({id})"
    needfix_dir: str = "needfix"
    workers: int = 10
    negative_ttl_days: int = 7
    dry_run: bool = False


def parse_env(text: str, known: Mapping[str, str] | None = None) -> dict[str, str]:
    """Lines of NAME=value: `export`, quotes and $NAME (outside single quotes) are understood, comments and other lines passed over."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if not m:
            continue
        value, quote = m[2], m[2][:1]
        if quote in ("'", '"') and value.endswith(quote) and len(value) > 1:
            value = value[1:-1]
        else:
            value, quote = re.sub(r"\s+#.*$", "", value), ""
        if quote != "'":
            value = re.sub(r"\$\{?(\w+)\}?", lambda v: {**(known or {}), **out}.get(v[1], ""), value)
        out[m[1]] = value
    return out


def nearest_env(start: Path) -> Path | None:
    folder = start.resolve()
    for f in [folder, *folder.parents][:LEVELS]:
        if (f / ".env").is_file():
            return f / ".env"
    return None


def load(given: dict | None = None, environ: Mapping[str, str] | None = None, start: str = ".", prefix: str = "QUIREWORK_") -> Config:
    environ = os.environ if environ is None else environ
    path = nearest_env(Path(start))
    both = {**(parse_env(path.read_text(), environ) if path else {}), **environ}
    out = {}
    for f in fields(Config):
        raw = (given or {}).get(f.name)
        raw = both.get(prefix + f.name.upper()) if raw is None else raw
        if raw is not None:
            kind = type(f.default)
            out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool and isinstance(raw, str) else kind(raw)
    return Config(**out)
