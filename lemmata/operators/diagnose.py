"""Why a search found nothing: one of eleven causes, each with its own repair."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base
from ..query import Arg, NameQuery, Query
from . import find
from .aggregates import spread
from .looks import Words, renamed
from .terms import asks, needs_terms

#: The causes, in the order in which they are looked for.
CAUSES = ("Unqualified", "OnlyGenerated", "NotIndexed", "InstancesAreDefs", "Plain", "Barren", "NoSuchShape", "NotInShape", "NamedElsewise", "InScope", "Combination")


@dataclass(frozen=True)
class Empty:
    """cause: one of CAUSES; what: what the cause has to say."""

    cause: str
    what: dict = field(default_factory=dict)


def _shape(q: Query) -> Query:
    return Query(concl=q.concl, args=q.args, implicit=q.implicit)


def _pieces(name: str) -> list[str]:
    return [p for p in (x.removesuffix(".") for x in name.split("*")) if p]


def _labelled(q: Query, use: str) -> str:
    return f"`{use}` in the pattern" if use in q.pattern_uses else f"--uses {use}"


def conditions(q: Query) -> list[tuple[str, Query]]:
    """Each condition alone, under the words in which it was written."""
    out: list[tuple[str, Query]] = []
    pieces = _pieces(q.name) if q.name else []
    if len(pieces) > 1:
        out += [(f"`{p}` in --name", Query(name=p)) for p in pieces]
    elif pieces:
        out.append((f"--name {q.name}", Query(name=q.name)))
    if q.concl:
        out.append((f"--concl {q.concl}", Query(concl=q.concl)))
    out += [(f"`{a.written}` in the pattern", Query(args=(a,), implicit=q.implicit)) for a in q.args if a.written]
    out += [(_labelled(q, u), Query(uses=(u,))) for u in q.uses]
    if q.term and needs_terms(q.term):
        kind = "type constraints" if asks(json.loads(q.term), "ty") else "numeric literals"
        out.append((f"{kind} in the pattern", Query(term=q.term)))
    if q.module:
        out.append((f"--in {q.module}", Query(module=q.module)))
    if q.source:
        out.append((f"--source {q.source}", Query(source=q.source)))
    if q.kinds:
        out.append((f"--kind {','.join(q.kinds)}", Query(kinds=q.kinds)))
    return out + [(f"--text {t}", Query(text=(t,))) for t in q.text]


def parts(q: Query) -> list[tuple[str, Query]]:
    """Each part as it was written, a pattern's shape as one, with the query that is left without it."""
    out: list[tuple[str, Query]] = []
    pieces = _pieces(q.name) if q.name else []
    if len(pieces) > 1:
        out += [(f"`{p}` in --name", replace(q, name="*".join(pieces[:i] + pieces[i + 1 :]))) for i, p in enumerate(pieces)]
    elif pieces:
        out.append((f"--name {q.name}", replace(q, name=None)))
    if q.concl or q.args:
        label = f"--concl {q.concl}" if q.concl and not (q.args or q.pattern_uses or q.term) else "the shape"
        out.append((label, replace(q, concl=None, args=(), inside=(), powers=(), term=None, implicit=False)))
    for u in q.uses:
        less = {k: tuple(x for x in getattr(q, k) if x != u) for k in ("uses", "pattern_uses")}
        term = renamed(q.term, lambda n, u=u: None if n == u else n)
        out.append((_labelled(q, u), replace(q, **less, inside=tuple(tuple(x for x in h if x != u) for h in q.inside), term=term)))
    if q.term and needs_terms(q.term):
        said = []
        numerals = _numerals(json.loads(q.term))
        if numerals:
            said.append(f"the value{'s' if len(numerals) > 1 else ''} of {listed([f'`{n}`' for n in numerals])}")
        if asks(json.loads(q.term), "ty"):
            said.append("the type ascribed")
        out.append((" and ".join(said), replace(q, term=None)))
    if q.module:
        out.append((f"--in {q.module}", replace(q, module=None)))
    if q.source:
        out.append((f"--source {q.source}", replace(q, source=None)))
    if q.kinds:
        out.append((f"--kind {','.join(q.kinds)}", replace(q, kinds=())))
    return out + [(f"--text {t}", replace(q, text=tuple(x for x in q.text if x != t))) for t in q.text]


def _numerals(t: dict) -> list[str]:
    out = [t["literal"]] if t.get("literal", "").isdecimal() else []
    return out + [n for a in [*t.get("args", []), *([t["ty"]] if t.get("ty") else [])] for n in _numerals(a)]


def listed(some: list[str]) -> str:
    return some[0] if len(some) == 1 else f"{', '.join(some[:-1])} and {some[-1]}"


@dataclass
class Diagnosis:
    """missing_module, missing_name: which corpus that no source indexes has a module or declares a name, if any."""

    decls: DataFrame
    missing_module: Callable[[str], str | None] = lambda m: None
    missing_name: Callable[[str], str | None] = lambda n: None

    def any(self, *queries: Query) -> list[bool]:
        return find.found_any(self.decls, list(queries))

    def of(self, q: Query, words: Words = Words()) -> Empty:
        for written, candidates in words.called.items():
            return Empty("Unqualified", {"written": written, "candidates": candidates})
        if not q.generated and self.any(replace(q, generated=True))[0]:
            return Empty("OnlyGenerated")
        if q.module and (corpus := self.missing_module(q.module)) and not self.any(Query(module=q.module))[0]:
            return Empty("NotIndexed", {"module": q.module, "missing": corpus})
        head = _pieces(q.name)[0] if q.name and not q.name.startswith("*") and _pieces(q.name) else ""
        if "." in head and (corpus := self.missing_name(head)) and not self.any(Query(name=q.name))[0]:
            return Empty("NotIndexed", {"name": head, "missing": corpus})
        if q.kinds == ("instance",) and not self.any(Query(kinds=q.kinds, elaborated=True))[0]:
            return Empty("InstancesAreDefs")
        each = conditions(q)
        if len(each) < 2:
            if each and each[0][0].startswith(("--uses ", "--text ")):
                return Empty("Barren", {"conditions": [each[0][0]]})
            return Empty("Plain")
        met = self.any(*(x for _, x in each))
        if not all(met):
            return Empty("Barren", {"conditions": [label for (label, _), yes in zip(each, met, strict=True) if not yes]})
        steps = (self._no_such_shape, self._not_in_shape, self._named_elsewise, self._in_scope, self._combination)
        return next((found for step in steps if (found := step(q))), Empty("Plain"))

    def _no_such_shape(self, q: Query) -> Empty | None:
        """The shape fails by itself: which conclusions do take these arguments, which arguments stand in the way, and whether the other order matches."""
        shape = _shape(q)
        if not (q.concl or q.args) or self.any(shape)[0]:
            return None
        named = [i for i, a in enumerate(q.args) if a.names]
        tries = [replace(shape, args=q.args[::-1]), *(replace(shape, args=tuple(Arg() if j == i else a for j, a in enumerate(q.args))) for i in named)]
        met = self.any(*tries)
        under = []
        if q.concl and named:
            rows = find.matching(self.decls, replace(shape, concl=None)).where("concl is not null")
            under = [(r["concl"], r["n"]) for r in spread(rows, "concl").limit(60).collect()]
        without = [q.args[i].written or q.args[i].names[0] for i, yes in zip(named, met[1:], strict=True) if yes] if len(named) > 1 else []
        return Empty("NoSuchShape", {"under": under, "without": without, "swapped": q.args[::-1] != q.args and met[0]})

    def _not_in_shape(self, q: Query) -> Empty | None:
        """The shape matches, and nothing of that shape mentions what else the pattern has."""
        if not q.pattern_uses:
            return None
        base_ = replace(_shape(q), inside=q.inside, pattern_uses=q.pattern_uses)
        met = self.any(replace(base_, uses=q.pattern_uses), *(replace(base_, uses=(u,)) for u in q.pattern_uses))
        if met[0]:
            return None
        absent = [u for u, yes in zip(q.pattern_uses, met[1:], strict=True) if not yes] if len(q.pattern_uses) > 1 else []
        return Empty("NotInShape", {"absent": absent or list(q.pattern_uses), "together": not absent and len(q.pattern_uses) > 1})

    def _named_elsewise(self, q: Query) -> Empty | None:
        """A declaration has that very name, and concludes something else."""
        asked = NameQuery.read(q.name).pieces if q.name else ()
        if len(asked) != 1 or not (q.concl or q.args) or self.any(replace(_shape(q), name=q.name))[0]:
            return None
        rows = find.matching(self.decls, Query(name=q.name)).where("elaborated and concl is not null")
        rows = rows.where((F.lower("name") == asked[0]) | (F.lower(base(F.col("name"))) == asked[0]))
        d = rows.orderBy(F.octet_length("name"), "id").select("name", "concl", "concl_args").first()
        if d is None:
            return None
        return Empty("NamedElsewise", {"name": d["name"], "concl": d["concl"], "args": list(d["concl_args"]), "on_a_side": q.concl is not None and q.concl in d["concl_args"]})

    def _in_scope(self, q: Query) -> Empty | None:
        """The place that was named has rows: how many, which conditions find nothing there, and where the rest matches."""
        if not (q.module or q.source):
            return None
        scope = Query(module=q.module, source=q.source, generated=q.generated)
        held = find.count(self.decls, scope).first()["n"]
        if not held:
            return None
        rest = [(label, x) for label, x in conditions(q) if not label.startswith(("--in ", "--source "))]
        failing = [label for label, _ in rest]
        if len(rest) > 1:
            met = self.any(*(replace(x, module=q.module, source=q.source, generated=q.generated) for _, x in rest))
            failing = [label for label, yes in zip(failing, met, strict=True) if not yes]
        rows = find.matching(self.decls, replace(q, module=None, source=None))
        elsewhere = [(r["module"], r["n"]) for r in spread(rows, "module").limit(60).collect()]
        return Empty("InScope", {"module": q.module, "source": q.source, "held": held, "failing": failing, "elsewhere": elsewhere})

    def _combination(self, q: Query) -> Empty | None:
        """Every part matches something and no row all of them: the parts whose leaving out finds something."""
        some = parts(q)
        if len(some) < 2:
            return None
        met = [True, True] if len(some) == 2 else self.any(*(rest for _, rest in some))
        return Empty("Combination", {"parts": [p for p, _ in some], "without": [p for (p, _), yes in zip(some, met, strict=True) if yes]})
