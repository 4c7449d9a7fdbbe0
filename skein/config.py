"""Settings in sections, read from TOML and changed one validated key at a time."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from skein.sources.globs import EXCLUDE, INCLUDE


@dataclass(frozen=True)
class Indexing:
    max_file_size: int = 1 << 20
    include_patterns: list = field(default_factory=lambda: list(INCLUDE))
    exclude_patterns: list = field(default_factory=lambda: list(EXCLUDE))


@dataclass(frozen=True)
class ContextSettings:
    max_nodes: int = 20
    max_code_blocks: int = 5
    max_code_block_size: int = 1500
    traversal_depth: int = 1


@dataclass(frozen=True)
class Sync:
    auto_sync_interval_secs: int = 120
    git_hooks_enabled: bool = True


@dataclass(frozen=True)
class Vectors:
    enabled: bool = False
    model: str = "hashed-trigrams"
    dimension: int = 256


@dataclass(frozen=True)
class Security:
    enabled: bool = False
    enforce: bool = False
    max_output_chars: int = 50_000
    max_tool_calls_per_session: int = 500
    max_guardrail_hits_per_session: int = 100
    max_blocked_calls_per_session: int = 25
    max_read_then_write_events_per_session: int = 10
    audit_log: bool = False


SECTIONS = {"indexing": Indexing, "context": ContextSettings, "sync": Sync, "vectors": Vectors, "security": Security}


class Config:
    """The settings of a project; a file that is not there gives the defaults."""

    def __init__(self, path: str):
        self.path = Path(path)
        found = tomllib.loads(self.path.read_text()) if self.path.exists() else {}
        self.sections = {}
        for name, kind in SECTIONS.items():
            known = {f.name for f in fields(kind)}
            self.sections[name] = kind(**{k: v for k, v in found.get(name, {}).items() if k in known})

    def __getattr__(self, name: str):
        if name in SECTIONS:
            return self.sections[name]
        raise AttributeError(name)

    def show(self, section: str | None = None) -> dict:
        if section and section not in SECTIONS:
            raise KeyError(f"no section {section}")
        every = {n: asdict(s) for n, s in self.sections.items()}
        return {section: every[section]} if section else every

    def update(self, section: str, key: str, value) -> None:
        """Sets a key that is there to a value of its type, and writes the file."""
        now = self.sections.get(section)
        if now is None or key not in asdict(now):
            raise KeyError(f"no setting {section}.{key}")
        old = getattr(now, key)
        if type(value) is not type(old):
            raise TypeError(f"{section}.{key} takes {type(old).__name__}")
        self.sections[section] = replace(now, **{key: value})
        lines = []
        for name, s in self.sections.items():
            lines += [f"[{name}]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in asdict(s).items()), ""]
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text("\n".join(lines))
