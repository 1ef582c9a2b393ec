"""Copies of declarations as files of a project: what to write, and the writing of it on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Row

from .operators.provenance import Source


@dataclass
class VendorFile:
    """One file for each module that declarations are copied from."""

    path: str
    source: str
    module: str
    header: str
    names: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)

    @property
    def lines(self) -> int:
        return sum(b - a + 1 for a, b in self.spans)


def plan(frontier: Sequence[Row], folder: str, sources: dict[str, Source], order: Sequence[str] = ()) -> list[VendorFile]:
    """Files for the rows of Engine.frontier that are to be copied, in order of source and module; declarations in `order` (dependencies first), else by their lines."""
    rank = {n: i for i, n in enumerate(order)}
    files: dict[tuple[str, str], VendorFile] = {}
    rows = [r for r in frontier if r["role"] == "materialize" and r["source"] is not None and r["line_start"] is not None]
    for r in sorted(rows, key=lambda r: (r["source"], r["module"], rank.get(r["name"], 0), r["line_start"], r["name"])):
        key = (r["source"], r["module"])
        if key not in files:
            s = sources.get(r["source"])
            said = [f"Copied from {r['source']}, module {r['module']}.", *(f"{k}: {v}" for k, v in (("License", s and s.license), ("Attribution", s and s.attribution)) if v)]
            name = r["source"].capitalize() + "/" + r["module"].replace(".", "/") + ".lean"
            files[key] = VendorFile(f"{folder}/{name}", *key, "/- " + "\n   ".join(said) + " -/")
        files[key].names.append(r["name"])
        files[key].spans.append((r["line_start"], r["line_end"]))
    return list(files.values())


def text_of(file: VendorFile, imports: Sequence[str], read_module: Callable[[str, str], str | None]) -> str:
    """A file's text; lines that several declarations share are written once. A module without text, or lines that aren't there, are an error."""
    text = read_module(file.source, file.module)
    if text is None:
        raise FileNotFoundError(f"there is no text of {file.module}")
    lines = text.split("\n")
    out = [file.header, ""] + [f"import {m}" for m in imports] + ([""] if imports else [])
    for a, b in dict.fromkeys(file.spans):
        if a > len(lines):
            raise ValueError(f"lines {a}-{b} of {file.module} are not there; load the source again")
        out += [*lines[a - 1 : b], ""]
    return "\n".join(out) + "\n"


def write(files: Sequence[VendorFile], imports: Sequence[str], read_module: Callable[[str, str], str | None], root: str, force: bool = False) -> list[str]:
    """Writes all files, or none if one is there already (unless force)."""
    texts = {f.path: text_of(f, imports, read_module) for f in files}
    there = [p for p in texts if (Path(root) / p).exists()]
    if there and not force:
        raise FileExistsError(f"{', '.join(there)}: there already; force overwrites")
    for path, text in texts.items():
        at = Path(root) / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return list(texts)


def add_imports(path: str, modules: Sequence[str]) -> list[str]:
    """Adds import lines to a file after its last one; those that are there are left. Returns what was added."""
    at = Path(path)
    lines = at.read_text().split("\n") if at.exists() else []
    have = {x.split()[-1] for x in lines if x.split()[:1] == ["import"] or x.split()[:2] == ["public", "import"]}
    new = [m for m in dict.fromkeys(modules) if m not in have]
    last = max((i for i, x in enumerate(lines) if "import" in x.split()[:2]), default=-1)
    if new:
        lines[last + 1 : last + 1] = [f"import {m}" for m in new]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("\n".join(lines) + ("" if lines and not lines[-1] else "\n"))
    return new
