"""Ranked search, counting, and saying why a search found nothing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import asked_words, base
from ..query import NameQuery, Query, is_field
from . import predicates as P
from .powers import writes_powers
from .terms import needs_terms, specifics


def name_score(name: Column, asked: str) -> Column:
    """8 if the pieces make up the name, 6 its last component, 2 if it begins with them."""
    q = NameQuery.read(asked)
    low, last = F.lower(name), F.lower(base(name))
    if not q.pieces:
        return F.lit(8)
    whole, start = q.regex(True, True), q.regex(True)
    return F.when(low.rlike(whole), 8).when(last.rlike(whole), 6).when(low.rlike(start), 2).otherwise(0)


def score(q: Query) -> Column:
    """Name, conclusion, matched as written (for unfolding queries), uses mentioned."""
    total = F.lit(0)
    if q.name:
        total = total + name_score(F.col("name"), q.name)
    if q.concl is not None:
        total = total + F.when(P.concludes(F.col("concl"), q.concl), 4).otherwise(0)
    if q.unfolds:
        plain = replace(q, args=tuple(replace(a, names=(a.written,)) if a.written else a for a in q.args))
        written = P.answers_shape_and_uses(plain, F.col("concl"), F.col("concl_args"), F.col("concl_explicit_args"), F.col("consts"))
        total = total + F.when(written, 4).otherwise(0)
    for use in q.uses:
        total = total + P.mentions(F.col("consts"), use).cast("int")
    return total


def _semi(decls: DataFrame, q: Query, uses: DataFrame | None, tokens: DataFrame | None) -> DataFrame:
    """Rows that an index of mentions (id, dst) or words (id, token) lets through: those with every use and every word asked for. The whole rule is tested on them all the same."""
    plain = [u for u in q.uses if not is_field(u) and not any(u in held for held in q.inside)]
    for use in plain if uses is not None else []:
        decls = decls.join(uses.where(F.col("dst") == use).select("id"), "id", "left_semi")
    for text in q.text if tokens is not None else []:
        words = sorted(set(asked_words(text)))
        if words:
            met = tokens.where(F.col("token").isin(words)).groupBy("id").agg(F.countDistinct("token").alias("n"))
            decls = decls.join(met.where(F.col("n") == len(words)).select("id"), "id", "left_semi")
    return decls


def matching(decls: DataFrame, q: Query, uses: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """All rows that match. Terms are unified last, in Python, and only on rows that meet every other condition; they add a column specifics.

    With `uses` (id, dst) and `tokens` (id, token), written by store.write_index, mentions and words are looked up there first (left semi joins).
    """
    rows = _semi(decls, q, uses, tokens).where(P.matches(q))
    return rows if q.term is None else rows.withColumn("specifics", specifics(F.col("term"), q.term)).where("specifics is not null")


def ranked(decls: DataFrame, q: Query, uses: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """All matches with their score, best first: score, then how little a term is particular, bytes of the type, load order. No candidate is cut before ranking. writes: whether a row writes the powers of q."""
    q.check()
    particular = [] if q.term is None else ["specifics"]
    rows = matching(decls, q, uses, tokens)
    total = score(q)
    if q.powers:
        rows = rows.withColumn("writes", F.coalesce(writes_powers(q), F.lit(False)))
        total = total + F.when(F.col("writes"), 4).otherwise(0)
    total = F.greatest(total - F.when(F.col("sorry"), 2).otherwise(0), F.lit(0))
    return rows.withColumn("score", total).orderBy(F.desc("score"), *particular, F.octet_length("type"), "id")


def find(decls: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """The best q.limit rows, and a one-row frame that tells whether more match. Both plan as a top-k. collect_best() has both from one scan."""
    best = ranked(decls, q)
    return best.limit(q.limit), best.limit(q.limit + 1).agg((F.count("*") > q.limit).alias("truncated"))


def collect_best(decls: DataFrame, q: Query, uses: DataFrame | None = None, tokens: DataFrame | None = None) -> tuple[list[Row], bool]:
    """The best q.limit rows, and whether more match: one top-k of q.limit + 1 rows."""
    got = ranked(decls, q, uses, tokens).limit(q.limit + 1).collect()
    return got[: q.limit], len(got) > q.limit


def count(decls: DataFrame, q: Query) -> DataFrame:
    return matching(decls, q).agg(F.count("*").alias("n"))


def found_any(decls: DataFrame, queries: list[Query]) -> list[bool]:
    """Whether each of several queries finds anything: one pass over the rows for all of them."""
    if not queries:
        return []
    rows, tests = decls, []
    for i, q in enumerate(queries):
        test = P.matches(q)
        if q.term is not None:
            rows = rows.withColumn(f"_term{i}", specifics(F.when(test, F.col("term")), q.term))
            # a row without a term answers what needs none
            test = test & F.when(F.col("term").isNull() & F.lit(not needs_terms(q.term)), F.lit(True)).otherwise(F.col(f"_term{i}").isNotNull())
        tests.append(F.max(F.coalesce(test, F.lit(False))).alias(f"q{i}"))
    row = rows.agg(*tests).first()
    return [bool(row[f"q{i}"]) for i in range(len(queries))]


def exists(decls: DataFrame, q: Query) -> bool:
    return not matching(decls, q).limit(1).isEmpty()


def conditions(q: Query) -> dict[str, Query]:
    """Each condition of q alone."""
    empty = Query(limit=q.limit, generated=True)
    parts = {}
    if q.name:
        parts["name"] = replace(empty, name=q.name)
    if q.needs_shape:
        parts["shape"] = replace(empty, concl=q.concl, args=q.args, implicit=q.implicit)
    for i, use in enumerate(q.uses):
        parts[f"uses{i}"] = replace(empty, uses=(use,))
    for i, text in enumerate(q.text):
        parts[f"text{i}"] = replace(empty, text=(text,))
    for key in ("module", "source", "kinds"):
        if getattr(q, key):
            parts[key] = replace(empty, **{key: getattr(q, key)})
    if q.no_sorry:
        parts["no_sorry"] = replace(empty, no_sorry=True)
    return parts


def without(q: Query, part: str) -> Query:
    """q less one condition of conditions()."""
    if part == "shape":
        return replace(q, concl=None, args=(), inside=(), term=None)
    for key in ("uses", "text"):
        if part.startswith(key):
            values = getattr(q, key)
            i = int(part[len(key) :])
            return replace(q, **{key: values[:i] + values[i + 1 :]})
    return replace(q, **{part: getattr(Query(), part)})


def diagnosis(decls: DataFrame, q: Query) -> DataFrame:
    """condition, alone, rest: rows that meet each condition by itself, and all the others. One pass over the rows for all of them.

    A condition with none alone can't be met here; one whose rest is not empty is what stands in the way.
    """
    parts = conditions(q)
    sums = []
    for name, alone in parts.items():
        sums += [F.count_if(P.matches(alone)).alias(f"{name}_alone"), F.count_if(P.matches(without(q, name))).alias(f"{name}_rest")]
    row = decls.agg(*sums)
    pairs = ", ".join(f"'{p}', {p}_alone, {p}_rest" for p in parts)
    return row.selectExpr(f"stack({len(parts)}, {pairs}) as (condition, alone, rest)")


def first_look(decls: DataFrame, looks: list[Query]) -> DataFrame:
    """Rows of the first of several queries that finds any, with its number; in one pass, without probing them one by one."""
    looked = F.array(*(F.when(P.matches(q), F.lit(i)) for i, q in enumerate(looks)))
    each = decls.withColumn("look", F.explode(F.filter(looked, lambda x: x.isNotNull())))
    least = each.agg(F.min("look").alias("least"))
    return each.join(F.broadcast(least), F.col("look") == F.col("least")).drop("least")
