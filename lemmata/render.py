"""What the commands print."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Row

from .engine import Hits, NotFound, Shown
from .functions.statements import says
from .operators.diagnose import Empty, listed
from .operators.provenance import age
from .pattern.syntax import INFIX

WIDTH = 96


def first_line(text: str, width: int) -> str:
    line = text.split("\n", 1)[0]
    return line if len(line) <= width else line[:width] + "…"


def marks(row: Row) -> str:
    """[text] where no compiler has seen the row, and a warning where its proof is missing."""
    return ("" if row["elaborated"] else " [text]") + (" [sorry]" if "sorry" in row and row["sorry"] else "")


def place(row: Row) -> str:
    return f":{row['line_start']}-{row['line_end']}" if row["line_start"] is not None else ""


def wrapped(head: str, items: Iterable[str]) -> str:
    """Items after a head, in lines of at most WIDTH characters."""
    lines, line = [], head
    for x in items:
        if len(line) + 1 + len(x) > WIDTH:
            lines.append(line)
            line = "   "
        line += " " + x
    return "\n".join([*lines, line]) + "\n"


def symbol(head: str) -> str | None:
    return next((s for s, (h, *_) in INFIX.items() if h == head), None)


def hits(found: Hits, long: bool = False) -> str:
    if not found.rows:
        return empty(found.empty)
    out = []
    for r in found.rows:
        out.append(f"{r['name']}{marks(r)}  {r['kind']}  {r['module']}")
        stated = r["type"] if long else first_line(says(r["type"] or ""), 100)
        if stated:
            out.append(f"  {stated}")
        summary = next((x.strip() for x in (r["doc"] or "").split("\n") if x.strip()), "")
        if long and summary:
            out.append(f"  -- {first_line(summary, 200)}")
    n = len(found.rows)
    out.append(f"{n} shown, more match; refine or --limit" if found.truncated else f"{n} result(s)")
    return "\n".join(out) + "\n"


def read_as(found: Hits) -> list[str]:
    """How a pattern was read, where that isn't plain from what was written."""
    out = [f"`{word}` read as `{name}`" for word, name in found.read_as.items()]
    if found.variables:
        out.append(f"{', '.join(found.variables)} read as variables")
    out += [f"--text {t} read as --uses {t}" for t in found.text_as_uses]
    if found.swapped:
        out.append("matched with its sides traded")
    out += [f"a {'power' if p.head == 'HPow.hPow' else 'product'} of {p.exponent} matched as a {'product' if p.head == 'HPow.hPow' else 'power'}" for p in found.respelled]
    out += [f"`{written}` also matched as {', '.join(f'`{n}`' for n in names)}" for written, names in found.unfolded.items()]
    if found.reading and found.reading.lambdas:
        out.append(f"read as `_`: {', '.join(found.reading.lambdas)}")
    return out


def empty(e: Empty | None) -> str:
    """Why nothing was found, and what to change."""
    return f"no match{_why(e)}\n" if e and (_why(e)) else "no match\n"


def _ticks(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _why(e: Empty) -> str:
    w = e.what
    if e.cause == "Barren":
        some = w["conditions"]
        return f": {some[0]} matches nothing on its own" if len(some) == 1 else f": {', '.join(some)} match nothing on their own"
    if e.cause == "Combination":
        n, less = len(w["parts"]), w["without"]
        if n == 2:
            rest = ""
        elif not less:
            rest = f"; no {n - 1} of them match together"
        elif len(less) == n:
            rest = f"; any {n - 1} of them match together"
        else:
            rest = f"; all but {', or all but '.join(less)} match together"
        return f": {listed(w['parts'])} each match on their own, but not together{rest}"
    if e.cause == "InScope":
        where = " in ".join(x for x in (w["module"] and f"--in {w['module']}", w["source"] and f"--source {w['source']}") if x)
        held = f"{w['held']} declaration{'s' if w['held'] > 1 else ''}"
        rest = f", none matching {' or '.join(w['failing'])}" if w["failing"] else "; each condition matches some of them, none matches all"
        else_ = "".join(f"\n  {m} ({n})" for m, n in w["elsewhere"][:3])
        return f": {where} has {held}{rest}" + (f"\nwithout it:{else_}" if else_ else "")
    if e.cause == "NotIndexed":
        return f": `{w.get('module') or w.get('name')}` is in {w['missing']}, which is not a source of this index"
    if e.cause == "Unqualified":
        first, *rest = w["candidates"]
        also = f"; also {', '.join(_ticks(rest[:2]))}" if rest else ""
        return f": `{w['written']}` is `{first}` in the index, printed without its namespace, and that matches nothing either{also}"
    if e.cause == "NoSuchShape":
        if w["swapped"]:
            near = "; the same two sides the other way round do"
        elif w["under"]:
            near = "; those arguments go together under " + ", ".join(f"`{c}`" + (f" ({n})" if n > 1 else "") for c, n in w["under"][:3])
        elif len(w["without"]) > 1:
            near = f"; each of {', '.join(_ticks(w['without']))} matches without the others"
        else:
            near = "".join(f"; it matches with `{n}` written as `_`" for n in w["without"])
        return f": nothing has that shape{near}"
    if e.cause == "NotInShape":
        what = f"{' and '.join(_ticks(w['absent']))} together" if w["together"] else " or ".join(_ticks(w["absent"]))
        return f": the shape matches, but nothing of that shape mentions {what}; what is written inside a side is looked for anywhere in the statement"
    if e.cause == "NamedElsewise":
        over = f" over `{' '.join(w['args'])}`" if w["args"] else ""
        sign = symbol(w["concl"])
        more = f"; to match one side of it, append ` {sign} _` to the pattern" if w["on_a_side"] and sign else ""
        return f": `{w['name']}` concludes `{w['concl']}`{over}, and a pattern is matched against the whole conclusion{more}"
    if e.cause == "OnlyGenerated":
        return ": only names that the compiler generated match, which are hidden; add --generated to see them"
    if e.cause == "InstancesAreDefs":
        return ": no compiled row has the kind `instance`; older rows have instances as `def`, so read the source again"
    return ""


def shown(s: Shown, import_only: bool = False) -> str:
    row = s.row
    out = (s.import_line or f"-- source `{row['source']}` is not importable; `add --source {row['source']} {row['name']}` copies it instead") + "\n"
    if import_only:
        return out
    out += f"\n{row['name']}{marks(row)}\n  {row['kind']}  {row['module']}{place(row)}\n"
    if s.inside is not None:
        out += f"  generated inside {s.inside['name']}{place(s.inside)}; `show {s.inside['name']}` has the source\n"
    elif s.head is not None:
        out += f"  those lines declare nothing: `{s.head}`\n"
    if s.lines is not None:
        return out + f"\n{s.lines}\n"
    return out + (f"\n-- source not available: {s.missing}\n-- type: {row['type']}\n" if s.missing else f"\n{row['type']}\n")


def shown_many(some: Sequence[Shown | NotFound], import_only: bool = False) -> str:
    """All, or their import lines, each once."""
    each = [f"{s}\n" if isinstance(s, NotFound) else shown(s, import_only) for s in some]
    return "".join(dict.fromkeys(each)) if import_only else "\n".join(each)


def deps(root: str, rows: Sequence[Row]) -> str:
    out = f"{root}\n"
    if rows and rows[0]["approximate"]:
        out += "-- approximate: known as text only, so dependencies are guessed from identifiers\n"
    if not rows:
        return out + "\nno dependencies recorded\n"
    for level in sorted({r["level"] for r in rows}):
        here = [r for r in rows if r["level"] == level]
        out += f"depth {level} ({len(here)})\n"
        for source, text in sorted({(r["source"], "" if r["elaborated"] else " [text]") for r in here}):
            out += wrapped(f"  {source}{text}:", [r["name"] for r in here if r["source"] == source and bool(text) != r["elaborated"]])
    return out


def closure(root: str, rows: Sequence[Row]) -> str:
    total, theorems = sum(r["n"] for r in rows), sum(r["theorems"] for r in rows)
    each = "".join(f"  {r['source']} {r['n']}\n" for r in rows if r["source"] is not None)
    return f"{root}\n\n{total} declarations in the transitive closure, {theorems} of them theorems\n{each}"


def rdeps(name: str, rows: Sequence[Row], total: int) -> str:
    if not total:
        return f"nothing in the index mentions {name}\n"
    more = f", first {len(rows)} shown; --limit for more" if total > len(rows) else ""
    star = " (* in the statement)" if any(r["in_statement"] for r in rows) else ""
    groups: dict[str, list[str]] = {}
    for r in rows:
        groups.setdefault(f"  {r['module']}{'' if r['elaborated'] else ' [text]'}:", []).append(r["name"] + ("*" if r["in_statement"] else ""))
    return f"{name}: used by {total}{more}{star}\n" + "".join(wrapped(h, items) for h, items in groups.items())


def plan(rows: Sequence[Row], files: Sequence, written: Sequence[str] | None = None, registered: int = 0) -> str:
    """What copying a declaration takes: rows of Engine.frontier, and the files of vendor.plan."""
    out = "-- approximate: part of this tree is known as text only\n\n" if any(r["approximate"] for r in rows) else ""
    imports = sorted({r["module"] for r in rows if r["role"] == "import"})
    out += "imports\n" + "".join(f"  import {m}\n" for m in imports) + "\n" if imports else ""
    if not files:
        return out + "Nothing to copy: every dependency is reachable by an import.\n"
    depth = max(r["level"] for r in rows if r["role"] == "materialize")
    out += f"to materialize: {sum(len(f.names) for f in files)} declaration(s) in {len(files)} file(s), {sum(f.lines for f in files)} lines, tree depth {depth}\n\n"
    by: dict[str, int] = {}
    for f in files:
        by[f.source] = by.get(f.source, 0) + len(f.names)
    out += "".join(f"  {s} {n}\n" for s, n in sorted(by.items())) + "\n"
    out += "".join(f"  {f.path} {len(f.names)} decl(s), {f.lines} lines\n" for f in files)
    missing = sorted(r["name"] for r in rows if r["role"] == "missing")
    if missing:
        out += f"\n{len(missing)} dependency(ies) are not in the index, so this tree is incomplete:\n" + "".join(f"  {m}\n" for m in missing[:10])
    if written is None:
        return out + "\nDry run. Nothing was written; run again with --write.\n"
    return out + f"\nwritten: {len(written)} file(s); registered {registered} module(s) in the aggregator\n"


def status(rows: Sequence[Row], sources: dict, now: int, indexed_at: dict[str, int]) -> str:
    """The table of sources, and the ones that are behind."""
    line = "{:<14} {:<7} {:<12} {:<12} {:>12}  {:<8} {}\n"
    out = line.format("source", "kind", "elaborated", "importable", "declarations", "indexed", "state")
    for r in rows:
        s = sources.get(r["source"])
        when = age(now - indexed_at[r["source"]]) if r["source"] in indexed_at else "never"
        out += line.format(r["source"], s.kind if s else "-", str(s.is_compiled).lower() if s else "-", str(s.can_import).lower() if s else "-", r["rows"], when, r["state"])
    out += f"\n{sum(r['rows'] for r in rows)} declarations indexed\n"
    behind = [r["source"] for r in rows if r["state"] in ("moved", "outdated")]
    return out + (f"\nbehind: {', '.join(behind)}; run refresh\n" if behind else "")


def stale(rows: Sequence[Row]) -> str:
    why = {"moved": "has moved since it was indexed", "outdated": "has rows of an older format"}
    return "".join(f"`{r['source']}` {why[r['why']]}; run refresh {r['source']}\n" for r in rows)


def dup(rows: Sequence[Row], types: dict[str, str]) -> str:
    if not rows:
        return "nothing here looks like a declaration of another source\n"
    out, names = "", list(dict.fromkeys(r["name"] for r in rows))
    for name in names:
        out += f"{name}\n  {first_line(says(types.get(name, '')), 100)}\n"
        out += "".join(f"  {round(r['similarity'] * 100):>3}%  {r['other']}\n         {r['module']}\n" for r in rows if r["name"] == name) + "\n"
    return out + f"{len(names)} declaration(s) with candidates\n"
