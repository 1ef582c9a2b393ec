"""Settings of a project, from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.provenance import Source

KINDS = ("lake", "local", "git", "core")


@dataclass(frozen=True)
class SourceConfig:
    """A corpus: its kind, and where its rows or texts are. elaborated and importable follow the kind unless they are given."""

    name: str
    kind: str
    path: str | None = None
    root: str | None = None
    modules: tuple[str, ...] = ()
    url: str | None = None
    rev: str | None = None
    sparse: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    license: str | None = None
    attribution: str | None = None
    elaborated: bool | None = None
    importable: bool | None = None
    workspace: str | None = None

    def source(self) -> Source:
        return Source(self.name, self.kind, self.elaborated, self.importable, self.license, self.attribution)


@dataclass(frozen=True)
class Project:
    namespace: str
    imports: str
    vendor: str
    root: str = "."
    src: str = "."


@dataclass(frozen=True)
class Index:
    path: str = ".index"
    raw: str = ".index/raw"
    refresh_on_miss: bool = False


@dataclass(frozen=True)
class Config:
    project: Project
    index: Index = Index()
    sources: tuple[SourceConfig, ...] = ()
    base: str = field(default=".", compare=False)

    def at(self, path: str) -> str:
        """A path of the settings, seen from their file."""
        return str(Path(self.base) / path)


def _made(kind: type, table: dict, where: str):
    known = {f.name for f in fields(kind)}
    if odd := sorted(set(table) - known):
        raise ValueError(f"{where}: unknown {', '.join(odd)}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in table.items()})
    except TypeError as e:
        raise ValueError(f"{where}: {str(e).split('__init__() ')[-1]}") from None


def parse(text: str, base: str = ".") -> Config:
    """Settings; unknown keys, missing ones, odd kinds and names given twice are errors."""
    table = tomllib.loads(text)
    if odd := sorted(set(table) - {"project", "index", "source"}):
        raise ValueError(f"unknown {', '.join(odd)}")
    if "project" not in table:
        raise ValueError("[project] is missing")
    sources = tuple(_made(SourceConfig, s, f"source {s.get('name', '?')}") for s in table.get("source", []))
    for s in sources:
        if s.kind not in KINDS:
            raise ValueError(f"source {s.name}: the kind {s.kind} is none of {', '.join(KINDS)}")
        if s.kind == "git" and not s.url and not s.path:
            raise ValueError(f"source {s.name}: a git source needs a url or a path")
        if s.kind in ("lake", "local") and not s.modules and not s.root:
            raise ValueError(f"source {s.name}: a {s.kind} source needs modules or a root")
    names = [s.name for s in sources]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"given twice: {', '.join(twice)}")
    return Config(_made(Project, table["project"], "project"), _made(Index, table.get("index", {}), "index"), sources, base)


def load(path: str) -> Config:
    return parse(Path(path).read_text(), str(Path(path).parent))


#: What `init` writes.
TEMPLATE = '''[project]
namespace = "MyProject"
imports = "MyProject/Imports.lean"
vendor = "MyProject/Vendor"

[index]
path = ".index"

[[source]]
name = "project"
kind = "local"
modules = ["MyProject"]
'''
