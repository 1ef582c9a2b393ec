"""What a search asks for: a conjunction of conditions, all optional."""

from __future__ import annotations

import re
from dataclasses import dataclass

WILD = "_"
#: Conclusions that are also kept under another head, one way.
ALSO_KEYED = {"HasSubset.Subset": "LE.le", "HasSSubset.SSubset": "LT.lt"}

#: Constants that most statements mention, so that they say nothing of what one is about.
UBIQUITOUS = (
    "Eq", "Iff", "And", "Or", "Not", "LE.le", "LT.lt", "Membership.mem", "HAdd.hAdd", "HMul.hMul", "HSub.hSub", "HDiv.hDiv", "OfNat.ofNat", "Zero.zero", "One.one", "Nat", "Prop", "Type", "Sort",
    "Exists", "Set", "Subtype", "Function.comp", "True", "False", "trivial",
)


@dataclass(frozen=True)
class NameQuery:
    """Pieces of a name with gaps (*) between them, compared in lower case. A dot before a star belongs to the gap."""

    pieces: tuple[str, ...]

    @classmethod
    def read(cls, asked: str) -> NameQuery:
        *gapped, last = asked.split("*")
        parts = [p.removesuffix(".") for p in gapped] + [last]
        return cls(tuple(p.lower() for p in parts if p))

    def regex(self, start: bool = False, end: bool = False) -> str:
        """For a search in the lower-case name: anywhere, from its start, or to its end too."""
        middle = r"[\s\S]*".join(map(quoted, self.pieces))
        return (r"\A" if start else "") + middle + (r"\z" if end else "")


def quoted(text: str) -> str:
    """Every ASCII sign escaped, for Java's and RE2's patterns alike."""
    return re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", text)


@dataclass(frozen=True)
class Arg:
    """An argument's head: any of `names`; the names other than `written` match only once unfolded. No names: anything."""

    names: tuple[str, ...] = ()
    written: str | None = None

    @classmethod
    def read(cls, head: str) -> Arg:
        return cls() if head == WILD else cls((head,), head)


@dataclass(frozen=True, order=True)
class Power:
    """A term so many times, as a power (HPow.hPow) or as a product (HMul.hMul) of itself."""

    exponent: int
    head: str

    @property
    def respelled(self) -> Power:
        return Power(self.exponent, "HMul.hMul" if self.head == "HPow.hPow" else "HPow.hPow")


@dataclass(frozen=True)
class Query:
    name: str | None = None
    concl: str | None = None
    args: tuple[Arg, ...] = ()
    inside: tuple[tuple[str, ...], ...] = ()  # uses written inside each argument
    uses: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    term: str | None = None  # JSON of a term to unify with the row's
    module: str | None = None
    source: str | None = None
    kinds: tuple[str, ...] = ()
    elaborated: bool = False
    no_sorry: bool = False
    generated: bool = False
    implicit: bool = False
    limit: int = 10
    powers: tuple[tuple[int, Power], ...] = ()  # which arguments a pattern writes as powers
    pattern_uses: tuple[str, ...] = ()  # those of uses that a pattern brought

    @property
    def needs_shape(self) -> bool:
        return self.concl is not None or bool(self.args) or self.term is not None

    @property
    def unfolds(self) -> bool:
        return any(a.written and set(a.names) - {a.written} for a in self.args)

    def check(self) -> None:
        """A query without conditions is refused."""
        name = NameQuery.read(self.name).pieces if self.name else ()
        if not (name or self.needs_shape or self.uses or self.text or self.module or self.source or self.kinds):
            raise ValueError("the query asks for nothing")
        for x in (self.concl, *self.uses):
            if x is not None and re.search(r"\s", re.sub("«[^»]*»", "", x)):
                raise ValueError(f"not a name: {x!r}")


def is_field(name: str) -> bool:
    """.length stands for any name that ends so."""
    return name.startswith(".")


def keyed_as(head: str) -> list[str]:
    return [head, *([ALSO_KEYED[head]] if head in ALSO_KEYED else [])]
