"""What an index was loaded from, and whether that has moved since."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from . import joins
from . import predicates as P
from .store import ROW_FORMAT

#: Kinds of sources of which rows are compiled, and which a project can import.
COMPILED, IMPORTABLE = ("lake", "local", "core"), ("lake", "local", "core")


@dataclass(frozen=True)
class Source:
    """A source of declarations. elaborated and importable follow its kind unless they are given."""

    id: str
    kind: str
    elaborated: bool | None = None
    importable: bool | None = None
    license: str | None = None
    attribution: str | None = None

    @property
    def is_compiled(self) -> bool:
        return self.kind in COMPILED if self.elaborated is None else self.elaborated

    @property
    def can_import(self) -> bool:
        return self.kind in IMPORTABLE if self.importable is None else self.importable


def with_flags(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """rows (source) with importable and elaborated of their sources, a small table; false for a source that isn't known."""
    known = rows.sparkSession.createDataFrame([(s.id, s.can_import, s.is_compiled) for s in sources], "source string, _i boolean, _e boolean")
    out = rows.join(F.broadcast(known), "source", "left")
    return out.withColumn("importable", F.coalesce("_i", F.lit(False))).withColumn("elaborated", F.coalesce("_e", F.lit(False))).drop("_i", "_e")


def stale_among(provenance: DataFrame, now: DataFrame) -> DataFrame:
    """source, why (moved before outdated), was, revision of the sources that are behind; both have source and revision. What isn't known is not stale."""
    met = provenance.withColumnRenamed("revision", "was").join(now, "source", "left")
    moved = F.col("was").isNotNull() & F.col("revision").isNotNull() & (F.col("was") != F.col("revision"))
    why = F.when(moved, "moved").when(F.coalesce("row_format", F.lit(0)) < ROW_FORMAT, "outdated")
    return met.withColumn("why", why).where("why is not null").select("source", "why", "was", "revision")


def current(provenance: DataFrame, now: DataFrame) -> DataFrame:
    """source, current: false if stale, true if both revisions are known and equal, null otherwise."""
    met = provenance.join(now.withColumnRenamed("revision", "is"), "source", "full")
    moved = F.col("revision").isNotNull() & F.col("is").isNotNull() & (F.col("revision") != F.col("is"))
    old = F.coalesce("row_format", F.lit(0)) < ROW_FORMAT
    return met.select("source", F.when(moved | old, F.lit(False)).when(F.col("revision").isNotNull() & F.col("is").isNotNull(), F.lit(True)).alias("current"))


def up_to_date(row, stamp: str | None, held: int) -> bool:
    """Whether a load can be skipped: the same stamp, the present format, and all rows that were recorded are there."""
    return row is not None and stamp is not None and row["stamp"] == stamp and (row["row_format"] or 0) >= ROW_FORMAT and row["decls"] == held


def file_stamp(path: str) -> str | None:
    """Length and time of a file."""
    if not os.path.isfile(path):
        return None
    s = os.stat(path)
    return f"{s.st_size}:{int(s.st_mtime)}"


def tree_stamp(root: str, suffix: str = ".olean") -> str | None:
    """FNV-1a over paths, lengths and times of a folder's files, in order; None without any. A driver-side walk of a local build."""
    found = []
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(suffix):
                path = os.path.join(folder, name)
                s = os.stat(path)
                found.append((os.path.relpath(path, root), s.st_size, int(s.st_mtime)))
    if not found:
        return None
    h = 0xCBF29CE484222325
    for path, size, time in sorted(found):
        for byte in path.encode() + size.to_bytes(8, "little") + time.to_bytes(8, "little"):
            h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"


def behind(declared: DataFrame, indexed: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """source, module, name, why: what a build has and the index has not (new), or has elsewhere (moved), or otherwise (restated). imported (module): only these modules count."""
    keys = ["source", "module", "name"]
    changed = joins.restated(declared, indexed, ["line_start", "line_end", "type"]).select(*keys, F.lit("restated").alias("why"))
    new = joins.undeclared(declared, indexed).select(*keys)
    moved = joins.relocated(declared, indexed).select(*keys).distinct().withColumn("was", F.lit(True))
    new = new.join(moved, keys, "left").select(*keys, F.when(F.col("was"), F.lit("moved")).otherwise(F.lit("new")).alias("why"))
    out = changed.unionByName(new)
    return out if imported is None else out.join(imported.select("module").distinct(), "module", "left_semi").select(*keys, "why")


def ahead(declared: DataFrame, indexed: DataFrame) -> DataFrame:
    """source, files, declaring: modules with something new or changed, and how many declarations."""
    return behind(declared, indexed).groupBy("source").agg(F.countDistinct("module").alias("files"), F.count("*").alias("declaring"))


def declared_matching(declared: DataFrame, name: str | None = None, module: str | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """Of what files declare (name, module, statement), what a search by name, module and words could mean."""
    tests = F.lit(True)
    if name:
        tests = tests & P.name_is(F.col("name"), name)
    if module:
        tests = tests & P.under(F.col("module"), module)
    for t in text:
        tests = tests & has_text([F.col("name"), F.col("statement")], t)
    return declared.where(tests)


def unclaimed(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """Packages (name, path) of which no source has the path."""
    plain = F.regexp_replace(F.regexp_replace("path", r"(?:^|/)\.(?=/)", ""), "/+$", "")
    return packages.withColumn("at", plain).join(sources.select(plain.alias("at")).distinct(), "at", "left_anti").select("name", "path")


def age(seconds: int) -> str:
    """How long ago, for people."""
    if seconds < 90:
        return "just now"
    for limit, unit, sign in ((5400, 60, "m"), (172_800, 3600, "h")):
        if seconds < limit:
            return f"{seconds // unit}{sign} ago"
    return f"{seconds // 86_400}d ago"
