"""Other ways to ask a query that found nothing: sides traded, powers spelled otherwise, bare words read as the constants they print for."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..query import Arg, Power, Query

#: Relations that say the same with their sides traded.
SYMMETRIC = ("Eq", "Iff", "Ne")


@dataclass(frozen=True)
class Look:
    query: Query
    turned: bool = False
    traded: tuple[Power, ...] = ()  # powers that are spelled otherwise, as they were written


def turned(q: Query) -> Query | None:
    """The sides of a symmetric relation traded, with all that belongs to each; None where that asks nothing else."""
    if q.concl not in SYMMETRIC:
        return None
    a, b = (1, 2) if q.implicit and q.concl != "Iff" else (0, 1)
    if len(q.args) != b + 1:
        return None
    swap = {a: b, b: a}

    def traded(some: tuple, blank) -> tuple:
        out = [*some, *[blank] * (len(q.args) - len(some))]
        out[a], out[b] = out[b], out[a]
        return tuple(out)

    term = json.loads(q.term) if q.term else None
    if term and len(term.get("args", [])) > b:
        term["args"][a], term["args"][b] = term["args"][b], term["args"][a]
    out = replace(
        q,
        args=traded(q.args, Arg()),
        inside=traded(q.inside, ()) if q.inside else q.inside,
        powers=tuple(sorted((swap.get(i, i), p) for i, p in q.powers)),
        term=json.dumps(term, ensure_ascii=False, sort_keys=True) if term else None,
    )
    return None if replace(out, limit=q.limit) == replace(q, powers=tuple(sorted(q.powers))) else out


def respelled(q: Query) -> Iterator[tuple[Query, tuple[Power, ...]]]:
    """Powers spelled the other way, where the shape has their head: all of them, then each alone if there are several."""
    at = [j for j, (i, p) in enumerate(q.powers) if i < len(q.args) and q.args[i].written == p.head]
    for some in [at, *([j] for j in at if len(at) > 1)]:
        if some:
            args, powers = list(q.args), list(q.powers)
            for j in some:
                i, p = powers[j]
                powers[j] = (i, p.respelled)
                args[i] = Arg.read(p.respelled.head)
            yield replace(q, args=tuple(args), powers=tuple(powers)), tuple(sorted({q.powers[j][1] for j in some}))


def looks(q: Query) -> list[Look]:
    """In the order in which they are taken: turned, then each respelling and that turned."""
    out = [Look(t, True) for t in [turned(q)] if t]
    for other, traded in respelled(q):
        out.append(Look(other, False, traded))
        out += [Look(t, True, traded) for t in [turned(other)] if t]
    return out


@dataclass
class Words:
    """What words of a pattern that found nothing are read as the second time."""

    called: dict[str, list[str]] = field(default_factory=dict)  # constants that print so, commonest first
    methods: dict[str, list[str]] = field(default_factory=dict)  # uses of what a method is written on
    variables: list[str] = field(default_factory=list)


def renamed(term: str | None, name) -> str | None:
    """A term with each head replaced by name(head); None makes it a wildcard."""

    def of(t: dict) -> dict:
        out = {k: v for k, v in t.items() if k not in ("head", "args", "ty")}
        if t.get("head") and (new := name(t["head"])):
            out["head"] = new
        if t.get("args"):
            out["args"] = [of(a) for a in t["args"]]
        if t.get("ty"):
            out["ty"] = of(t["ty"])
        return out

    return None if term is None else json.dumps(of(json.loads(term)), ensure_ascii=False, sort_keys=True)


def reworded(q: Query, words: Words) -> Query | None:
    """q with each bare word replaced by the constant that it most likely names, and words that name nothing left out. None where nothing changes."""
    gone = set(words.variables)

    def name(n: str) -> str | None:
        return words.called[n][0] if words.called.get(n) else None if n in gone else n

    args = []
    for a in q.args:
        n = name(a.written) if a.written else None
        args.append(a if not a.written or n == a.written else Arg() if n is None else Arg.read(n))

    def kept(some: tuple[str, ...], free: bool) -> tuple[str, ...]:
        return tuple(name(u) or u for u in some if not (free and u in gone))

    brought = set(q.pattern_uses)
    uses = tuple(name(u) or u for u in q.uses if not (u in gone and u in brought))
    inside = [kept(h, True) for h in q.inside]
    more = [u for some in words.methods.values() for u in some]
    for word, some in words.methods.items():
        inside += [()] * (len(args) - len(inside))
        for i, a in enumerate(q.args):
            if a.written == word or (i < len(q.inside) and word in q.inside[i]):
                inside[i] = (*inside[i], *some)
    out = replace(
        q,
        concl=None if q.concl is None else name(q.concl),
        args=tuple(args),
        uses=tuple(dict.fromkeys([*uses, *more])),
        pattern_uses=tuple(dict.fromkeys([*kept(q.pattern_uses, True), *more])),
        inside=tuple(inside),
        term=renamed(q.term, name),
    )
    return None if out == q else out
