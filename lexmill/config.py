"""Settings: environment before file before defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Region and collection settings; the region is always the first local prefix."""

    region: str = ""
    local_prefix: tuple[str, ...] = ()
    max_age_days: int | None = None
    deep: bool = False


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """LEXMILL_* variables win over the JSON file, which wins over defaults; a bad file counts as none."""
    env = os.environ if env is None else env
    try:
        stored = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        stored = stored if isinstance(stored, dict) else {}
    except (OSError, ValueError):
        stored = {}
    known = {f.name for f in fields(Config)}
    given = {k: v for k, v in stored.items() if k in known}
    for name in known:
        text = env.get(f"LEXMILL_{name.upper()}")
        if text is not None:
            given[name] = {"local_prefix": lambda t: t.split(","), "max_age_days": lambda t: int(t) if t else None, "deep": lambda t: t not in ("", "0", "false")}.get(name, str)(text)
    config = replace(Config(), **given)
    prefixes = [p.strip() for p in config.local_prefix if p.strip()]
    first = [config.region] if config.region else []
    return replace(config, local_prefix=tuple(dict.fromkeys(first + prefixes)))
