"""Words, phrases and parts of dotted names."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_BETWEEN = r"[^\p{IsAlphabetic}\p{N}]+"
_ASKED = regex.compile(r"[^\p{Alphabetic}\p{N}]+")
_LAST = r"(?:«[^»]*»|[^.«»])*$"


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _BETWEEN), lambda w: w != "")


def asked_words(text: str) -> list[str]:
    """The same of a constant: letters (and marks that Unicode counts as alphabetic) and digits, by the same classes as in _BETWEEN."""
    return [w for w in _ASKED.split(text.lower()) if w]


def has_text(columns: list[Column], text: str) -> Column:
    """Whether one of the columns has the words of `text` next to each other; a text of symbols alone is looked for as it is, an empty one is nowhere."""
    asked = asked_words(text)
    if asked:
        phrase = f" {' '.join(asked)} "
        tests = [F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")).contains(phrase) for c in columns]
    else:
        tests = [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) & F.lit(text != "") for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def base(name: Column) -> Column:
    """Last component of a dotted name; dots in «quotes» don't count."""
    return F.when(name.contains("«"), F.regexp_extract(name, _LAST, 0)).otherwise(F.substring_index(name, ".", -1))


def namespace(name: Column) -> Column:
    """All components but the last; empty for a bare name."""
    quoted = F.regexp_replace(name, r"\.?" + _LAST, "")
    return F.when(name.contains("«"), quoted).otherwise(F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1))


def summary(doc: Column) -> Column:
    """First line with anything on it, trimmed."""
    return F.trim(F.get(F.filter(F.split(doc, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))


def clipped(c: Column, n: int = 100) -> Column:
    """First line, cut to n characters with an ellipsis."""
    line = F.substring_index(c, "\n", 1)
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def import_line(module: Column) -> Column:
    return F.concat(F.lit("import "), module)


def source_path(module: Column, suffix: str = ".lean") -> Column:
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(suffix))
