"""Commands over a written index: python -m lemmata.cli find 'Real.exp _ ≤ _'."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import config, render, vendor
from .engine import Engine, NotFound
from .operators import graph, store
from .sources import jsonl, scanner


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lemmata")
    p.add_argument("--config", default="lemmata.toml")
    commands = p.add_subparsers(dest="command", required=True)

    def command(label: str, /, *positional: tuple, **flags) -> None:
        c = commands.add_parser(label)
        for args, more in positional:
            c.add_argument(*args, **more)
        for flag, more in flags.items():
            c.add_argument("--" + flag, **more)

    text, many, yes = {}, {"action": "append", "default": []}, {"action": "store_true"}
    command(
        "find", (("pattern",), {"nargs": "?"}), name=text, concl=text, uses=many, source=text, kind=many, text=many, elaborated=yes, **{"no-sorry": yes, "in": {"dest": "module"}},
        generated=yes, limit={"type": int, "default": 10}, long=yes,
    )
    command("show", (("names",), {"nargs": "+"}), source=text, **{"import": {"action": "store_true", "dest": "import_only"}})
    command("deps", (("name",), {}), source=text, depth={"default": "1"})
    command("rdeps", (("name",), {}), source=text, generated=yes, limit={"type": int, "default": 100}, **{"in": {"dest": "module"}})
    command("add", (("name",), {}), source=text, write=yes, force=yes)
    command("dup", (("folder",), {}), source={"default": "project"}, threshold={"type": float, "default": 0.6})
    for name in ("index", "scan", "refresh"):
        command(name, (("source",), {"nargs": "?"}))
    command("status")
    command("init")
    return p


def with_negation(words: list[str]) -> list[str]:
    """A pattern that begins with a minus is no flag."""
    if words[:1] == ["find"]:
        at = next((i for i, w in enumerate(words) if w.startswith("-") and not w.startswith("--") and len(w) > 1), None)
        if at is not None:
            return [*words[:at], *words[at + 1 :], "--", words[at]]
    return words


def find_flags(a: argparse.Namespace) -> dict:
    """Flags of find as fields of a query. A kind may be a list with commas."""
    kinds = tuple(k for some in a.kind for k in some.split(","))
    flags = dict(name=a.name, concl=a.concl, uses=tuple(a.uses), text=tuple(a.text), module=a.module, source=a.source, kinds=kinds, elaborated=a.elaborated, no_sorry=a.no_sorry, generated=a.generated, limit=a.limit)
    return {k: v for k, v in flags.items() if v}


def read_source(spark: SparkSession, c: config.Config, s: config.SourceConfig):
    """Rows of a source: compiled ones from JSON lines in the raw folder, others from its texts."""
    if s.source().is_compiled:
        return jsonl.read(spark, c.at(f"{c.index.raw}/{s.name}.jsonl"))
    from pyspark.sql import functions as F

    from .schema import DECL

    rows = scanner.declarations(scanner.read(spark, c.at(s.path or s.name), s.name, s.exclude))
    rows = scanner.resolve(rows, rows.select("name").distinct()).withColumn("id", F.monotonically_increasing_id())
    have = set(rows.columns)
    columns = [d.split() for d in DECL.split(", ")]
    empty = {"array<string>": "array()", "string": "null"}
    return rows.selectExpr(*(n if n in have else f"cast({empty.get(t, 'null') if n == 'concl_args' else 'null'} as {t}) as {n}" for n, t in columns))


def module_reader(c: config.Config):
    """Text of a source's module from its folder, if it is there."""
    folders = {s.name: c.at(s.path or ".") for s in c.sources}

    def read(source: str, module: str) -> str | None:
        path = Path(folders.get(source, c.base)) / (module.replace(".", "/") + ".lean")
        return path.read_text() if path.is_file() else None

    return read


def run(words: list[str], spark: SparkSession) -> str:
    """What a command prints."""
    a = arguments().parse_args(with_negation(words))
    if a.command == "init":
        at = Path(a.config)
        if at.exists():
            raise SystemExit(f"{at} is there already")
        at.write_text(config.TEMPLATE)
        return f"{at}\n"
    c = config.load(a.config)
    path, sources = c.at(c.index.path), {s.name: s for s in c.sources}
    if a.command in ("index", "scan", "refresh"):
        chosen = [sources[a.source]] if a.source else [s for s in c.sources if a.command != "scan" or not s.source().is_compiled]
        out = ""
        for s in chosen:
            try:
                handed, kept = store.load(read_source(spark, c, s), path, s.name)
                out += f"{s.name}: {kept} of {handed} rows\n"
            except Exception as e:
                out += f"{s.name}: {e}\n"
        return out
    engine = Engine.open(spark, path, sources=[s.source() for s in c.sources], namespace=c.project.namespace, read_module=module_reader(c))
    source = getattr(a, "source", None)
    if source and a.command != "dup" and source not in sources:
        raise SystemExit(f"{source} is no source")
    try:
        if a.command == "find":
            found = engine.find(a.pattern, **find_flags(a))
            return "".join(x + "\n" for x in render.read_as(found)) + render.hits(found, a.long)
        if a.command == "show":
            return render.shown_many(engine.show_many(a.names), a.import_only)
        if a.command == "deps":
            if a.depth == "all":
                return render.closure(a.name, engine.closure(a.name, source).collect())
            return render.deps(a.name, engine.deps(a.name, int(a.depth), source).collect())
        if a.command == "rdeps":
            rows, total = engine.rdeps(a.name, a.limit, module=a.module, source=source, generated=a.generated)
            return render.rdeps(a.name, rows.collect(), total)
        if a.command == "add":
            rows = engine.frontier(a.name, source).collect()
            names = [r["name"] for r in rows if r["role"] == "materialize"]
            own = engine.edges().join(spark.createDataFrame([(n,) for n in names], "src string"), "src", "left_semi") if names else None
            order = graph.topological([tuple(r) for r in own.select("src", "dst").collect()], names) if own is not None else []
            files = vendor.plan(rows, c.project.vendor, engine.sources, order)
            imports = sorted({r["module"] for r in rows if r["role"] == "import"})
            if not a.write:
                return render.plan(rows, files)
            written = vendor.write(files, imports, engine.read_module, c.at(c.project.root), a.force)
            return render.plan(rows, files, written, len(vendor.add_imports(c.at(c.project.imports), imports)))
        if a.command == "dup":
            scanned = scanner.declarations(scanner.read(spark, a.folder, a.source))
            scanned = scanner.resolve(scanned, engine.decls.select("name").distinct())
            rows = engine.dup(scanned.selectExpr("name", "kind", "cast(null as string) as concl", "deps"), a.source, a.threshold).collect()
            return render.dup(rows, {r["name"]: r["type"] for r in scanned.select("name", "type").collect()})
        now = spark.createDataFrame([(s.name, s.rev) for s in c.sources], "source string, revision string")
        stored = engine._provenance
        when = {r["source"]: r["indexed_at"] for r in stored.select("source", "indexed_at").collect()} if stored is not None else {}
        return render.status(engine.status(now).orderBy("source").collect(), engine.sources, int(time.time()), when)
    except NotFound as e:
        raise SystemExit(str(e)) from None
    except ValueError as e:
        raise SystemExit(str(e)) from None


def main() -> None:
    spark = SparkSession.builder.appName("lemmata").getOrCreate()
    print(run(sys.argv[1:], spark), end="")


if __name__ == "__main__":
    main()

