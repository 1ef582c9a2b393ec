"""The declaration row, and names for its kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One row for each declaration. Null means unknown in concl_explicit_args and term, nothing in the others.
DECL = (
    "id bigint, name string, source string, module string, kind string, type string, concl string, concl_args array<string>,"
    " concl_explicit_args array<string>, term string, consts array<string>, deps array<string>, doc string, sorry boolean,"
    " line_start int, line_end int, elaborated boolean, unfolds string"
)
#: Other words for a kind.
KIND_ALIASES = {"lemma": "theorem", "abbrev": "def", "class": "structure"}


def kind_of(word: Column) -> Column:
    """The kind that a word stands for; an unknown word is a kind of its own."""
    known = F.create_map(*(F.lit(x) for pair in KIND_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, word), word)
