"""Printed statements: what they say without inferred binders, how many arguments they take, and words that they print bare."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

_CLOSE = {"(": ")", "{": "}", "[": "]", "⦃": "⦄", "⟨": "⟩"}


def _outside(text: str, sign: str) -> int | None:
    """Where `sign` first stands outside all brackets; -1 if nowhere, None if brackets don't match."""
    open_: list[str] = []
    for i, c in enumerate(text):
        if c in _CLOSE:
            open_.append(_CLOSE[c])
        elif open_ and c == open_[-1]:
            open_.pop()
        elif c in _CLOSE.values():
            return None
        elif c == sign and not open_:
            return i
    return None if open_ else -1


def _binders(text: str) -> tuple[list[str], str] | None:
    """Groups after a leading ∀, each a bracket with what is in it or bare words, and what follows the comma."""
    end = _outside(text, ",")
    if not end or end < 0:
        return None
    head, groups, at = text[1:end].strip(), [], 0
    while at < len(head):
        if head[at] in _CLOSE:
            depth, stop = 0, at
            while True:
                depth += (head[stop] in _CLOSE) - (head[stop] in _CLOSE.values())
                stop += 1
                if not depth or stop == len(head):
                    break
            groups.append(head[at:stop])
        else:
            stop = next((i for i in range(at, len(head)) if head[i] in _CLOSE and ":" not in head[at:i] and "∈" not in head[at:i]), len(head))
            if head[at:stop].strip():
                groups.append(head[at:stop].strip())
        at = stop
    return groups, text[end + 1 :].strip()


def says(type_: str) -> str:
    """On one line, without the leading binders that are inferred: those in {}, [] and ⦃⦄."""
    text, said = " ".join(type_.split()), ""
    while text.startswith("∀") and (found := _binders(text)):
        kept = [g for g in found[0] if g[0] not in "{[⦃"]
        said += f"∀ {' '.join(kept)}, " if kept else ""
        text = found[1]
    return said + text


def _names(group: str) -> int:
    """Names that a group binds: the words before its colon."""
    return len(re.split(r"[:∈]", group.strip("()"), maxsplit=1)[0].split())


def explicit_arity(type_: str) -> int | None:
    """How many arguments are written: explicit binders and bare domains of arrows. None if brackets don't match."""
    text, n = " ".join(type_.split()), 0
    while True:
        if text.startswith("∀"):
            if (found := _binders(text)) is None:
                return None
            n += sum(_names(g) for g in found[0] if g[0] not in "{[⦃")
            text = found[1]
            continue
        at = _outside(text, "→")
        if at is None:
            return None
        if at < 0:
            return n
        domain = text[:at].strip()
        if domain[:1] == "(" and re.match(r"\([^():]+ : ", domain) and _outside(domain, ":") == -1:
            n += _names(domain)
        elif domain[:1] not in ("{", "[", "⦃"):
            n += 1
        text = text[at + 1 :].strip()


def explicit_positions(heads: Sequence[str], explicit: Sequence[str] | None) -> list[int | None] | None:
    """Where each explicit head stands among all heads; None for one that could stand in several places."""
    if explicit is None:
        return None
    first, at = [], 0
    for x in explicit:
        while at < len(heads) and heads[at] != x:
            at += 1
        if at == len(heads):
            return None
        first.append(at)
        at += 1
    last, at = [], len(heads) - 1
    for x in reversed(explicit):
        while heads[at] != x:
            at -= 1
        last.append(at)
        at -= 1
    return [a if a == b else None for a, b in zip(first, reversed(last), strict=True)]


@pandas_udf(StringType())
def said(type_: pd.Series) -> pd.Series:
    """says() of a column; for the few rows that are printed."""
    return type_.map(lambda t: None if t is None else says(t))


@pandas_udf(IntegerType())
def arity(type_: pd.Series) -> pd.Series:
    """explicit_arity() of a column."""
    return pd.Series([None if t is None else explicit_arity(t) for t in type_], dtype="Int32")


def _java(word: str) -> str:
    return r"\Q" + word.replace("\\E", r"\E\\E\Q") + r"\E"


def prints_bare(type_: Column, word: str) -> Column:
    """Whether a statement has the word as a name of its own, nowhere after a dot, and nowhere as what a binder binds."""
    glued, w = r"[\p{L}\p{N}_']", _java(word)
    after = rf"(?!{glued}|[!?])"
    bare = type_.rlike(rf"(?<!{glued}|\.){w}{after}")
    dotted = type_.rlike(rf"\.{w}{after}")
    bound = type_.rlike(rf"(?<!{glued}|\.){w}{after}(?:\s+[^\s():,\[\]{{}}⦃⦄]+)*\s+:")
    return bare & ~dotted & ~bound


def abbreviated(name: Column, word: str) -> Column:
    """Whether `word` may stand for a name: leading namespaces left out, or those between the first ones and the base."""
    space, _, last = word.rpartition(".")
    test = (name == word) | name.endswith("." + word)
    return test | (name.startswith(space + ".") & name.endswith("." + last)) if space else test


def lines_of(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) of a text; tolerant of an end beyond it."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def span_lines(start: Column, end: Column) -> Column:
    return end - start + 1
