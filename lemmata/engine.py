"""The declaration store and its commands: find, show, deps, rdeps, add, dup, index, scan, status, refresh."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.statements import explicit_arity
from .functions.text import base
from .operators import aggregates, find, graph, joins, store
from .operators import predicates as P
from .operators.diagnose import Diagnosis, Empty
from .operators.looks import Words, looks, reworded
from .operators.provenance import Source, stale_among
from .operators.terms import components, needs_terms, term_heads
from .pattern import Known, Reading, applied_constants, parse
from .pattern.syntax import COERCION
from .query import Arg, Power, Query, is_field
from .sources import scanner

#: Names listed where one is meant and several fit.
SHOWN = 10
#: Classes of bundled maps.
BUNDLED = ("DFunLike", "FunLike", "EquivLike")
#: Steps outward from a generated declaration.
GENERATOR_STEPS = 8


class NotFound(LookupError):
    """Nothing has the name, or several have."""


@dataclass
class Hits:
    """What a search found, and how it was read to find it."""

    rows: list[Row]
    truncated: bool = False
    query: Query | None = None
    reading: Reading | None = None
    empty: Empty | None = None
    read_as: dict[str, str] = field(default_factory=dict)
    variables: list[str] = field(default_factory=list)
    text_as_uses: list[str] = field(default_factory=list)
    swapped: bool = False
    respelled: tuple[Power, ...] = ()
    unfolded: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Shown:
    """A declaration with its source: lines, or the declaration that it was generated inside, or why there are none."""

    row: Row
    import_line: str | None
    lines: str | None = None
    inside: Row | None = None
    head: str | None = None
    missing: str | None = None
    asked: str | None = None


class Engine:
    """A table of declarations (schema.DECL), with the tables that store.write_index writes beside it, if there are any.

    Each method of the store plans as a filter, a semi-join or an aggregate over these tables; searches collect the few rows that they show.
    read_module(source, module) gives a module's text, for show and add. edges (src, dst) has the dependencies, by name, where they are a table of their own; else they are read from the rows.
    """

    def __init__(
        self,
        decls: DataFrame,
        uses: DataFrame | None = None,
        tokens: DataFrame | None = None,
        provenance: DataFrame | None = None,
        sources: Iterable[Source] = (),
        namespace: str = "",
        read_module: Callable[[str, str], str | None] = lambda source, module: None,
        missing_module: Callable[[str], str | None] = lambda m: None,
        missing_name: Callable[[str], str | None] = lambda n: None,
        edges: DataFrame | None = None,
    ):
        self.decls, self.uses, self.tokens, self._provenance, self._edges = decls, uses, tokens, provenance, edges
        self.sources = {s.id: s for s in sources}
        self.namespace, self.read_module = namespace, read_module
        self.missing_module, self.missing_name = missing_module, missing_name

    @property
    def spark(self) -> SparkSession:
        return self.decls.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, path: str, **more) -> Engine:
        """Over an index that store.write_index wrote."""
        index = store.read_index(spark, path)
        return cls(index.decls, index.uses, index.tokens, index.provenance, **more)

    # ------------------------------------------------------------ store

    def named(self, name: str) -> DataFrame:
        """All rows of a name, compiled ones first."""
        return self.decls.where(F.col("name") == name).orderBy(F.desc("elaborated"), "id")

    def get(self, name: str, source: str | None = None) -> Row | None:
        rows = self.named(name)
        return (rows if source is None else rows.where(F.col("source") == source)).first()

    def get_many(self, names: list[str]) -> DataFrame:
        """A row for each name that is there, in the order asked."""
        asked = self.spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "name string, pos int")
        return joins.lookup(self.decls, asked)

    def matching(self, q: Query) -> DataFrame:
        return find.matching(self.decls, q, self.uses, self.tokens)

    def any(self, q: Query) -> bool:
        return not self.matching(q).limit(1).isEmpty()

    def count(self, q: Query) -> int:
        return self.matching(q).count()

    def counts(self) -> DataFrame:
        return aggregates.by_source(self.decls)

    def contains(self, name: str) -> bool:
        return not self.decls.where(F.col("name") == name).limit(1).isEmpty()

    def is_constant(self, name: str) -> bool:
        """Declared, or mentioned by a statement."""
        if self.uses is not None:
            return self.contains(name) or not self.uses.where(F.col("dst") == name).limit(1).isEmpty()
        return not self.decls.where((F.col("name") == name) | F.array_contains("consts", name)).limit(1).isEmpty()

    def heads_called(self, word: str) -> list[str]:
        return [r["head"] for r in aggregates.heads_called(self.decls, word).limit(SHOWN).collect()]

    def mentions(self) -> DataFrame:
        """id, dst of what statements mention."""
        return self.uses if self.uses is not None else self.decls.select("id", F.explode("consts").alias("dst"))

    def ending_in(self, suffix: str) -> DataFrame:
        return aggregates.ending_in(self.decls, self.mentions(), suffix)

    def used_by(self, name: str, within: Query = Query(generated=True)) -> DataFrame:
        """Rows that mention a name, in their order, with in_statement; without the name's own rows, and without generated ones unless asked for."""
        proofs = self.decls.select("id", F.explode("deps").alias("dst"))
        met = joins.mentions_of(self.mentions(), proofs, name)
        tests = P.matches(Query(module=within.module, source=within.source, generated=within.generated))
        return self.decls.where(tests & (F.col("name") != name)).join(met, "id").orderBy("source", "module", "name", "id")

    def reducible_class(self, name: str) -> list[str]:
        return graph.unfolding_class(self.decls, name)

    def missing_term_sources(self, q: Query) -> list[str]:
        """Sources of rows that would answer but for their term, which is missing."""
        rows = self.matching(replace(q, term=None)).where("elaborated and concl is not null and term is null")
        return sorted(r["source"] for r in rows.select("source").distinct().collect())

    def provenance(self, source: str) -> Row | None:
        return None if self._provenance is None else self._provenance.where(F.col("source") == source).first()

    def located_in(self, source: str, modules: list[str] | None = None) -> DataFrame:
        rows = self.decls.where(F.col("source") == source)
        rows = rows if modules is None else rows.where(F.col("module").isin(modules))
        return rows.select("source", "module", "name", "line_start", "line_end", "type")

    def enclosing(self, row: Row) -> Row | None:
        """The smallest declaration of its module that strictly contains a row."""
        if row["line_start"] is None:
            return None
        a, b = row["line_start"], row["line_end"]
        same = self.decls.where((F.col("source") == row["source"]) & (F.col("module") == row["module"]) & (F.col("line_start") <= a) & (F.col("line_end") >= b))
        return same.where((F.col("line_start") < a) | (F.col("line_end") > b)).orderBy(F.col("line_end") - F.col("line_start"), "name").first()

    def sources_of(self, q: Query) -> list[str]:
        """Sources that could answer: the one asked for, those below the module, or all."""
        if q.source:
            return [q.source]
        rows = self.decls.where(P.under(F.col("module"), q.module)) if q.module else self.decls
        return sorted(r["source"] for r in rows.select("source").distinct().collect())

    # ------------------------------------------------------------ find

    def known(self, pattern: str) -> Known:
        """What a pattern can't say of the constants that it applies: their arity, and whether they return a map (a type that a bundled class has an instance for)."""
        applied, coerces = applied_constants(pattern)
        rows = self.get_many(sorted(applied)).where("elaborated").select("name", "type", "concl").collect() if applied else []
        constants = {}
        for r in rows:
            takes = explicit_arity(r["type"])
            if takes is not None:
                constants[r["name"]] = (takes, takes < applied[r["name"]] and r["concl"] is not None and self._bundled(r["concl"]))
        return Known(constants, self.coercions() if coerces else ())

    def _bundled(self, type_: str) -> bool:
        arg = Arg(tuple(self.reducible_class(type_)), type_)
        return any(find.found_any(self.decls, [Query(concl=c, args=(arg,), elaborated=True) for c in BUNDLED]))

    def coercions(self) -> tuple[str, ...]:
        """What maps are applied through: the one of all bundled maps, then those of types of their own, which instances of CoeFun use."""
        instances = self.matching(Query(concl="CoeFun", elaborated=True)).select(F.get("concl_args", F.lit(0)).alias("of"), "consts", "deps")
        each = instances.where("of <> '_'").where(~F.array_contains("deps", COERCION)).select("of", F.explode(F.array_except("deps", "consts")).alias("name"))
        own = each.where(F.col("name").startswith(F.concat("of", F.lit("."))) & (F.col("name") != F.col("of")))
        functions = own.join(self.decls.where("elaborated and kind = 'def'").select("name", "type"), "name").select("of", "name", "type").distinct().collect()
        best: dict[str, tuple[bool, str]] = {}
        for r in functions:  # one for each type with an instance of its own
            takes = explicit_arity(r["type"]) or 0
            if takes:
                best[r["of"]] = min(best.get(r["of"], (True, "~")), (takes < 2, r["name"]))
        return (COERCION, *sorted({name for _, name in best.values()}))

    def unfolding(self, q: Query) -> Query:
        """Each argument head as every name of the same thing once reducible definitions are unfolded."""
        args = []
        for a in q.args:
            names = self.reducible_class(a.written) if a.written and a.names == (a.written,) and not is_field(a.written) and a.written != COERCION else a.names
            args.append(Arg(tuple(names), a.written) if len(names) > 1 else a)
        return replace(q, args=tuple(args))

    def query(self, pattern: str | None = None, **flags) -> tuple[Query, Reading | None]:
        """A pattern's query with flags: these come first, but uses and text add to the pattern's."""
        if pattern is None:
            return Query(**flags), None
        reading = parse(pattern, self.known(pattern))
        if reading.unknown:
            raise ValueError(f"can't read {', '.join(reading.unknown)} in the pattern")
        more = {k: getattr(reading.query, k) + tuple(flags.pop(k, ())) for k in ("uses", "text")}
        return replace(reading.query, **more, **flags), reading

    def find(self, pattern: str | Query | None = None, **flags) -> Hits:
        """The best rows of a pattern or query; on a miss by other looks at it, and else with the reason for the miss.

        Looks are taken in order: bare words as the constants that print so; dotted text as uses; sides traded; powers spelled otherwise, where rows write them. Each is one pass over the rows that could match.
        """
        asked, reading = (pattern, None) if isinstance(pattern, Query) else self.query(pattern, **flags)
        asked.check()
        first = self.unfolding(asked)
        hits = self._best(first)
        hits.reading, words, resolved = reading, Words(), False
        if not hits.rows:
            words = self.words(first)
            other = reworded(first, words)
            if other is not None and (other.needs_shape or other.uses or other.text or other.name):
                hits, resolved = self._best(self.unfolding(other)), True
        self._require_terms(hits.query)
        if not hits.rows and hits.query.text:
            hits = self._text_as_uses(hits)
        if not self._answers(hits):
            hits = self._second_looks(hits)
        hits.reading = reading
        if hits.rows or not words.called:
            hits.variables = words.variables
            hits.read_as = {w: c[0] for w, c in words.called.items()}
        elif resolved:
            hits.query = first
        if not hits.rows:
            found = Diagnosis(self.decls, self.missing_module, self.missing_name)
            hits.empty = found.of(hits.query, words)
        for r in hits.rows:
            for a in hits.query.args:
                stated = set(a.names[:]) & {*r["concl_args"]} if a.written and len(a.names) > 1 and a.written not in r["concl_args"] else ()
                for s in sorted(stated):
                    if s not in hits.unfolded.setdefault(a.written, []):
                        hits.unfolded[a.written].append(s)
        return hits

    def _best(self, q: Query) -> Hits:
        rows, more = find.collect_best(self.decls, q, self.uses, self.tokens)
        return Hits(rows, more, q)

    def _require_terms(self, q: Query) -> None:
        if q.term and needs_terms(q.term) and (missing := self.missing_term_sources(q)):
            raise ValueError(f"argument types or numerals were not recorded for matching rows in {', '.join(missing)}; load these sources again")

    def _answers(self, hits: Hits) -> bool:
        """Whether any row writes the powers that the query does."""
        if not hits.query.powers:
            return bool(hits.rows)
        return any(r["writes"] for r in hits.rows) or (hits.truncated and self._writing(hits.query, 1).rows != [])

    def _writing(self, q: Query, limit: int | None = None) -> Hits:
        """The best rows that write the powers of q."""
        best = find.ranked(self.decls, q, self.uses, self.tokens)
        if q.powers:
            best = best.where("writes")
        n = limit or q.limit
        got = best.limit(n + 1).collect()
        return Hits(got[:n], len(got) > n, q)

    def _text_as_uses(self, hits: Hits) -> Hits:
        names = [t for t in hits.query.text if "." in t and self.is_constant(t)]
        if names:
            q = replace(hits.query, uses=hits.query.uses + tuple(names), text=tuple(t for t in hits.query.text if t not in names))
            found = self._best(q)
            if found.rows:
                found.text_as_uses = names
                return found
        return hits

    def _second_looks(self, hits: Hits) -> Hits:
        shared = None
        for look in looks(hits.query):
            self._require_terms(look.query)
            found = self._writing(look.query)
            if found.rows:
                found.swapped, found.respelled = look.turned, look.traded
                found.text_as_uses = hits.text_as_uses
                return found
            if not hits.rows and not look.traded and shared is None:
                found = self._best(look.query)
                if found.rows:
                    found.swapped, shared = look.turned, found
        return shared or hits

    def words(self, q: Query) -> Words:
        """What the words of a query that found nothing could be: names that print so, methods on constants, or variables."""
        out = Words()
        heads = [q.concl, *(n for a in q.args for n in ([a.written] if a.written else []))]
        for word in dict.fromkeys(n for n in [*heads, *q.pattern_uses, *sorted(term_heads(q.term))] if n and not is_field(n)):
            if self.is_constant(word):
                continue
            called = self.heads_called(word)
            if not called and "." in word:
                called = [r["name"] for r in self.ending_in("." + word).limit(SHOWN).collect()]
            if called:
                out.called[word] = called
                continue
            pieces = components(word)
            receiver = self._receiver(pieces)
            if receiver:
                at, prefix = receiver
                out.methods[word] = [prefix, *("." + p for p in pieces[at:-1])]
                out.called[word] = ["." + pieces[-1]]
            elif len(pieces) == 1 and re.match(r"[^\W\d_]", word) and word[0].islower():
                out.variables.append(word)
        return out

    def _receiver(self, pieces: list[str]) -> tuple[int, str] | None:
        """The longest part of a dotted word that is a constant and no type: what a method is written on."""
        for at in range(len(pieces) - 1, 0, -1):
            prefix = ".".join(pieces[:at])
            known = prefix if self.is_constant(prefix) else next(iter(self.heads_called(prefix)), None) if "." in prefix else None
            if known:
                row = self.get(known)
                if row is None or row["kind"] not in ("inductive", "structure"):
                    return at, known
        return None

    # ------------------------------------------------------------ show

    def meant(self, name: str, source: str | None = None) -> Row:
        """The row of a name; else of the one declaration that ends with it, the project's own first."""
        row = self.get(name, source)
        if row is not None:
            return row
        ending = self.decls.where(F.col("name").endswith(name if is_field(name) else "." + name))
        ending = ending if source is None else ending.where(F.col("source") == source)
        names = [r["name"] for r in ending.select("name").distinct().orderBy("name").limit(1000).collect()]
        own = [n for n in names if n.startswith(self.namespace + ".")] if self.namespace else []
        if len(names) == 1 or len(own) == 1:
            return self.get(own[0] if len(own) == 1 else names[0], source)
        if not names:
            corpus = self.missing_name(name)
            raise NotFound(f"{name} is in {corpus}, which no source indexes" if corpus else f"{name} is not in the index")
        some = own + [n for n in names if n not in own]
        more = f", and {len(some) - SHOWN} more" if len(some) > SHOWN else ""
        raise NotFound(f"{len(some)} declarations end in {name}; name one: {', '.join(some[:SHOWN])}{more}")

    def importable(self, source: str) -> bool:
        return source in self.sources and self.sources[source].can_import

    def show(self, name: str, source: str | None = None) -> Shown:
        row = self.meant(name, source)
        out = Shown(row, f"import {row['module']}" if self.importable(row["source"]) else None, asked=name if row["name"] != name else None)
        if row["line_start"] is None:
            out.missing = "the index has no line range for this declaration"
            return out
        text = self.read_module(row["source"], row["module"])
        if text is None:
            out.missing = f"there is no text of {row['module']}"
            return out
        lines = "\n".join(text.split("\n")[row["line_start"] - 1 : row["line_end"]])
        if not scanner.declares(lines, row["name"]):
            out.inside = self.generator(row, text)
            if out.inside is not None or not scanner.declares(lines):
                out.head = scanner.first_code_line(lines)
                return out
        out.lines = lines
        return out

    def show_many(self, names: list[str]) -> list[Shown | NotFound]:
        """One for each name; a name that isn't there doesn't stop the others."""
        out: list[Shown | NotFound] = []
        for name in names:
            try:
                out.append(self.show(name))
            except NotFound as e:
                out.append(e)
        return out

    def generator(self, row: Row, text: str) -> Row | None:
        """The written declaration that a generated one lies in: outwards until a container's lines declare its own name."""
        at = row
        for _ in range(GENERATOR_STEPS):
            up = self.enclosing(at)
            if up is None:
                return at if at["name"] != row["name"] else None
            if scanner.declares("\n".join(text.split("\n")[up["line_start"] - 1 : up["line_end"]]), up["name"]):
                return up
            at = up
        return at

    # ------------------------------------------------------------ graph

    def edges(self) -> DataFrame:
        return self._edges if self._edges is not None else self.decls.select(F.col("name").alias("src"), F.explode("deps").alias("dst"))

    def deps(self, name: str, depth: int | None = 1, source: str | None = None) -> DataFrame:
        """level, name, source, module, kind, elaborated, approximate: what a declaration rests on, up to a depth (None: all). approximate: the root is known as text only."""
        root = self.meant(name, source)
        found = graph.reach_one(self.edges(), root["name"], depth=depth).where("level > 0").select(F.col("node").alias("name"), "level")
        rows = found.join(self._first_rows(found), "name")
        return rows.select("level", "name", "source", "module", "kind", "elaborated", F.lit(not root["elaborated"]).alias("approximate")).orderBy("level", "name")

    def closure(self, name: str, source: str | None = None) -> DataFrame:
        """source, n, theorems of all that a declaration rests on; names that aren't in the index have a null source."""
        root = self.meant(name, source)
        found = graph.reach_one(self.edges(), root["name"]).where("level > 0").select(F.col("node").alias("name"))
        rows = found.join(self._first_rows(found), "name", "left")
        return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "theorem").alias("theorems")).orderBy("source")

    def _first_rows(self, names: DataFrame | None = None) -> DataFrame:
        """One row for each name, compiled ones first; with names (name), of these and perhaps a few more."""
        rows = self.decls if names is None else graph.may_match(self.decls, "name", names, "name")
        best = F.max_by(F.struct("source", "module", "kind", "elaborated", "line_start", "line_end", "id"), F.struct("elaborated", -F.col("id")))
        return rows.groupBy("name").agg(best.alias("r")).select("name", "r.*")

    def rdeps(self, name: str, limit: int = 100, **within) -> tuple[DataFrame, int]:
        """What mentions a declaration, in order of source, module and name, and how many do."""
        if is_field(name):
            name = self.meant(name)["name"]
        elif not self.contains(name):
            raise NotFound(f"{name} is not in the index")
        found = self.used_by(name, Query(**within))
        return found.limit(limit), found.count()

    def frontier(self, name: str, source: str | None = None) -> DataFrame:
        """role, name, level, module, source, lines, approximate of what copying a declaration takes; see graph.frontier."""
        root = self.meant(name, source)
        importable = F.col("source").isin([s.id for s in self.sources.values() if s.can_import])
        first = self._first_rows().withColumn("importable", importable)
        nodes = first.select(F.col("name").alias("node"), "module", "importable")
        roots = self.spark.createDataFrame([(root["name"],)], "node string")
        found = graph.frontier(self.edges(), nodes, roots).drop("module").withColumnRenamed("node", "name")
        return found.join(first.drop("importable"), "name", "left").select("role", "name", "level", "module", "source", "line_start", "line_end", (~F.coalesce("elaborated", F.lit(True))).alias("approximate"))

    # ------------------------------------------------------------ near-duplicates

    def dup(self, scanned: DataFrame, local: str, threshold: float = 0.6) -> DataFrame:
        """For each proposition of scanned (scanner.resolve) the five most similar compiled ones of other sources: name, other, module, similarity.

        Candidates have the same conclusion, where it is known, and mention the first three distinctive constants; identifiers that aren't declared don't count.
        """
        return joins.duplicates(scanned, self.decls, local, threshold)

    # ------------------------------------------------------------ sources

    def status(self, now: DataFrame) -> DataFrame:
        """rows, what was recorded, and the state of each source; now (source, revision)."""
        empty = self.spark.createDataFrame([], store.PROVENANCE)
        return store.status(self.counts(), self._provenance if self._provenance is not None else empty, now)

    def stale(self, now: DataFrame) -> DataFrame:
        """Sources that have moved since they were indexed, or whose rows an older format has."""
        empty = self.spark.createDataFrame([], store.PROVENANCE)
        return stale_among(self._provenance if self._provenance is not None else empty, now)

    def refreshable(self, now: DataFrame, q: Query = Query()) -> list[str]:
        """Local sources in the query's reach that are behind."""
        reach = [s.id for s in self.sources.values() if s.kind == "local" and q.source in (None, s.id)]
        return sorted(r["source"] for r in self.stale(now).where(F.col("source").isin(reach)).select("source").collect())

    def refresh(self, sources: Iterable[str], read: Callable[[str], DataFrame], path: str, now: DataFrame) -> dict[str, str | None]:
        """Reads sources again into the index at `path`, and then has its tables; a source that fails doesn't stop the others. Returns what went wrong for each, or None."""
        out: dict[str, str | None] = {}
        for source in sources:
            try:
                store.load(read(source), path, source, now)
                out[source] = None
            except Exception as e:  # the message is the result
                out[source] = f"{type(e).__name__}: {e}"
        index = store.read_index(self.spark, path)
        self.decls, self.uses, self.tokens, self._provenance = index.decls, index.uses, index.tokens, index.provenance
        return out


def tail(name: str) -> str:
    """Last component, for messages."""
    return components(name)[-1]


__all__ = ["Engine", "Hits", "NotFound", "Shown", "base", "tail"]
