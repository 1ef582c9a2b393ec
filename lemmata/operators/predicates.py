"""One condition each on a declaration row, and their conjunction. Cheap tests come first."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import base, has_text
from ..query import NameQuery, Query, is_field, keyed_as

#: Names that a compiler makes up beside what a file declares.
GENERATED = ("ctorIdx", "ctorElim", "ctorElimType", "congr_simp", "ofNat_ctorIdx")


def name_is(name: Column, asked: str) -> Column:
    """Pieces in order, anywhere in the name, in any case. Without gaps this is a plain substring."""
    q = NameQuery.read(asked)
    if not q.pieces:
        return F.lit(True)
    low = F.lower(name)
    return low.contains(q.pieces[0]) if len(q.pieces) == 1 else low.rlike(q.regex())


def under(module: Column, prefix: str) -> Column:
    """The module itself or one below it; the empty prefix has all."""
    return F.lit(True) if not prefix else (module == prefix) | module.startswith(prefix + ".")


def named(c: Column, asked: str) -> Column:
    """The name asked for; for a field, any name that ends with it."""
    return c.endswith(asked) if is_field(asked) else c == asked


def mentions(consts: Column, asked: str) -> Column:
    found = F.exists(consts, lambda x: named(x, asked)) if is_field(asked) else F.array_contains(consts, asked)
    return F.coalesce(found, F.lit(False))


def concludes(concl: Column, asked: str) -> Column:
    return reduce(or_, (named(concl, k) for k in keyed_as(asked)))


def generated(name: Column, type_: Column) -> Column:
    last = base(name)
    return last.isin(*GENERATED) | name.contains(".brecOn.") | ((last == "elim") & type_.contains("ctorIdx = "))


def _head(actual: Column, names: tuple[str, ...]) -> Column:
    if not names:
        return F.lit(True)
    plain = [n for n in names if not is_field(n)]
    tests = [actual.isin(*plain)] if plain else []
    return F.coalesce(reduce(or_, tests + [actual.endswith(n) for n in names if is_field(n)]), F.lit(False))


def answers_shape_and_uses(q: Query, concl: Column, heads: Column, explicit: Column, consts: Column) -> Column:
    """Argument heads in place, and all uses mentioned or excused by the same placing.

    Heads are those of explicit arguments where these are known. A placing starts at the first one if visibility is known and the conclusion is a name of its own; else anywhere. A use
    written only inside arguments that matched through an unfolding is excused.
    """
    k = len(q.args)
    known = F.lit(True) if q.implicit else explicit.isNotNull()
    own = heads if q.implicit else F.coalesce(explicit, heads)
    anchor = known & F.lit(q.concl is not None and not is_field(q.concl or "."))

    def at(o: Column) -> Column:
        tests = [_head(F.get(own, o + i), a.names) for i, a in enumerate(q.args) if a.names]
        for use in q.uses:
            holders = [i for i, inner in enumerate(q.inside) if use in inner]
            test = mentions(consts, use)
            if holders and all(i < k and q.args[i].written for i in holders):
                test = test | reduce(and_, (F.get(own, o + i) != q.args[i].written for i in holders))
            tests.append(test)
        return F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))

    places = F.sequence(F.lit(0), F.greatest(F.size(own) - k, F.lit(0)))  # sequence(0, -1) would count down
    fits = F.when(anchor, at(F.lit(0))).otherwise(F.exists(places, at))
    ok = (F.size(own) >= k) & fits
    return ok & concludes(concl, q.concl) if q.concl is not None else ok


def matches(q: Query) -> Column:
    """The whole rule, over columns of a declaration row."""
    c = F.col
    tests: list[Column] = []
    if q.source is not None:
        tests.append(c("source") == q.source)
    if q.kinds:
        tests.append(c("kind").isin(*q.kinds))
    if q.elaborated or q.needs_shape:
        tests.append(c("elaborated"))
    if q.no_sorry:
        tests.append(~c("sorry"))
    if q.module:
        tests.append(under(c("module"), q.module))
    if q.needs_shape:
        tests.append(c("concl").isNotNull())
    if q.concl is not None:
        tests.append(concludes(c("concl"), q.concl))
    heads = {n for a in q.args for n in a.names if len(a.names) == 1 and not is_field(n)}
    for head in sorted(heads):  # needed by any placing, and cheap
        tests.append(F.array_contains(c("concl_args") if q.implicit else F.coalesce("concl_explicit_args", "concl_args"), head))
    if q.name:
        tests.append(name_is(c("name"), q.name))
    if not q.generated:
        tests.append(~F.coalesce(generated(c("name"), c("type")), F.lit(False)))
    if q.unfolds or q.args:
        tests.append(answers_shape_and_uses(q, c("concl"), c("concl_args"), c("concl_explicit_args"), c("consts")))
    else:
        tests += [mentions(c("consts"), u) for u in q.uses]
    tests += [has_text([c("name"), c("type"), c("doc")], t) for t in q.text]
    return reduce(and_, tests, F.lit(True))
