"""Lookups, containment, staleness and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..query import UBIQUITOUS

#: Sets of up to so many items are sent along with the items by which they meet others.
CARRIED = 32
#: Cells of hashes by which it is counted how often items occur.
CELLS = 1 << 16


def lookup(decls: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each of names (name, pos) that is there, in the order asked: elaborated rows first, then load order."""
    met = decls.join(names, "name")
    order = Window.partitionBy("name").orderBy(F.desc("elaborated"), "id")
    return met.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn").orderBy("pos")


def enclosing(spans: DataFrame) -> DataFrame:
    """For each row (name, source, module, line_start, line_end) the smallest row of its module that strictly contains it; ties by name.

    Rows of equal spans are one. What contains a span begins on its line, and then the next longer span there is the smallest; or it begins on an earlier line of the module. Those lines
    are a few blocks, each a power of two long and in its place (as in a Fenwick tree, one for each bit of the number of lines). A span is put down in each block that has its first line
    and is asked for, and asks in each of its own blocks for the smallest that ends with it or later: a running minimum from the last line up. So rows grow with the spans and the bits
    of a module's length, and never with the pairs of spans.
    """
    at = ["source", "module", "line_start", "line_end"]
    spans = spans.where("source is not null and module is not null and line_start is not null and line_end is not null").select(*at, "name")
    own = spans.groupBy(*at).agg(F.min("name").alias("first"))
    size = (F.col("line_end") - F.col("line_start")).alias("size")
    held = F.struct(size, F.col("first").alias("outer_name"))
    longer = Window.partitionBy("source", "module", "line_start").orderBy("line_end")
    same = own.select(*at, F.lead(held).over(longer).alias("m")).where("m is not null")

    ends = own.groupBy("source", "module").agg(F.min("line_start").cast("bigint").alias("lo"), F.max("line_start").cast("bigint").alias("hi"))
    own = own.join(ends, ["source", "module"]).withColumn("x", F.col("line_start") - F.col("lo"))
    bits = F.sequence(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - 1)
    block = F.struct(F.col("bit"), F.expr("shiftright(x, bit)").alias("n"))
    cells = own.withColumn("bit", F.explode(bits)).select(*at, "first", block.alias("block"))
    # Blocks that are asked for are even: where a bit of x is set its own block is odd, and the one before that holds lines before x alone.
    odd = F.col("block.n") % 2 == 1
    met = cells.select(
        *at, F.struct(F.col("block.bit"), (F.col("block.n") - odd.cast("int")).alias("n")).alias("block"), odd.alias("asks"), F.when(~odd, held).alias("held")
    )
    below = Window.partitionBy("source", "module", "block").orderBy(F.desc("line_end"))
    before = met.withColumn("m", F.min("held").over(below)).where("asks and m is not null").select(*at, "m")
    best = same.unionByName(before).groupBy(*at).agg(F.min("m").alias("m"))
    return spans.distinct().join(best, at).select("source", "module", "name", F.col("m.outer_name").alias("enclosing"), (F.col("m.size") + 1).alias("lines"))


def mentions_of(uses: DataFrame, deps: DataFrame, name: str) -> DataFrame:
    """Rows of decl ids whose statement (uses) or proof (deps) has the name: id, in_statement. Both have columns id, dst."""
    both = uses.where(F.col("dst") == name).select("id", F.lit(True).alias("s")).unionByName(
        deps.where(F.col("dst") == name).select("id", F.lit(False).alias("s"))
    )
    return both.groupBy("id").agg(F.max("s").alias("in_statement"))


def undeclared(declared: DataFrame, indexed: DataFrame) -> DataFrame:
    """What files declare and the index doesn't have."""
    return declared.join(indexed, ["source", "module", "name"], "left_anti")


def restated(declared: DataFrame, indexed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in both that differ in one of the columns, nulls being equal to each other."""
    other = indexed.select("source", "module", "name", *(F.col(c).alias(f"_{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return declared.join(other, ["source", "module", "name"]).where(differs).select(*declared.columns)


def relocated(declared: DataFrame, indexed: DataFrame) -> DataFrame:
    """Names of a source that are now in another module: source, name, module, was."""
    old = indexed.select("source", "name", F.col("module").alias("was"))
    return declared.select("source", "name", "module").join(old, ["source", "name"]).where("module <> was")


def _ordered(sets: DataFrame) -> DataFrame:
    """id, o: a set's items in an order that is the same for all sets, those first that are rare. How rare is counted by cells of hashes, few enough to be sent to all tasks; any order is right."""
    items = sets.select("id", F.explode("items").alias("item")).withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(CELLS)))
    often = items.groupBy("cell").agg(F.count("*").alias("often"))
    put = items.join(F.broadcast(often), "cell").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("o"))
    return put.select("id", F.col("o.item").alias("o"))


def _prefix(ordered: DataFrame, threshold: float) -> DataFrame:
    """A row (id, o, item) for each of the first n - ceil(t n) + 1 items of a set."""
    n = F.size("o")
    return ordered.select("id", "o", F.explode(F.slice("o", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1)).alias("item"))


def _similar_carried(sets: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """Pairs of small sets. A set goes with each item of its prefix, so that two that meet are compared there, at the first item they share and nowhere else: pairs are never shuffled.

    Equal sets are one where they meet; each of them is paired with the first of another's, as many as can be among the `most`.
    """
    at = F.max(F.array_position("o", F.col("item")).cast("int")).alias("at")  # aggregated: a filter by it comes after the shuffle then, which both sides of the join share
    probe = _prefix(_ordered(sets), threshold).repartition("item").groupBy("item", "o").agg(F.sort_array(F.collect_list("id")).alias("ids"), at)
    probe = probe.withColumn("n", F.size("o"))
    # Of two sets that are similar enough, the smaller (both, if as large) has the first shared item among the first n - ceil(2t / (1 + t) n) + 1.
    short = F.col("n") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n") - 1e-9).cast("int") + 1
    s, p = probe.where(F.col("at") <= short).alias("s"), probe.alias("p")
    longest = F.least(F.col("s.n") - F.col("s.at"), F.col("p.n") - F.col("p.at")) + 1  # what can be shared from here on
    both = F.array_intersect("s.o", "p.o")
    similarity = F.size(both) / (F.col("s.n") + F.col("p.n") - F.size(both))
    met = (
        s.join(p, F.col("s.item") == F.col("p.item"))
        .where((F.col("p.n") >= F.col("s.n")) & (F.col("s.n") >= F.lit(threshold) * F.col("p.n") - 1e-9))
        .where((1 + threshold) * longest >= threshold * (F.col("s.n") + F.col("p.n")) - 1e-9)
        .where((similarity >= threshold) & (F.get(both, F.lit(0)) == F.col("s.item")))
    )
    first = lambda ids: F.col(ids) if most is None else F.slice(ids, 1, most + 1)
    there, back = (F.struct(F.col(f"{x}.ids").alias("ids"), first(f"{y}.ids").alias("others")) for x, y in ("sp", "ps"))
    ways = F.when(F.col("p.n") > F.col("s.n"), F.array(there, back)).otherwise(F.array(there))  # of sets as large, each is s once
    each = met.select(similarity.alias("similarity"), F.explode(ways).alias("w")).select("similarity", "w.others", F.explode("w.ids").alias("id"))
    return each.select("id", F.explode("others").alias("other"), "similarity").where("id <> other")


def _similar_looked_up(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets one of which is not small: candidates first, then their sets are joined to them."""
    probe = _prefix(_ordered(sets), threshold).select("id", F.size("o").alias("n"), F.array_position("o", F.col("item")).cast("int").alias("at"), "item")
    left, right = probe.alias("l"), probe.alias("r")
    longest = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) + 1
    pairs = (
        left.join(right, F.col("l.item") == F.col("r.item"))
        .where((F.col("l.id") < F.col("r.id")) & (F.greatest("l.n", "r.n") > CARRIED))
        .where(F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n") - 1e-9)
        .where((1 + threshold) * longest >= threshold * (F.col("l.n") + F.col("r.n")) - 1e-9)
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .distinct()
    )
    x, y = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    ways = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    return met.select(F.explode(ways).alias("w"), "similarity").select("w.id", "w.other", "similarity")


def similar(sets: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Pairs id, other, similarity of rows (id, items: distinct values) with a Jaccard similarity of threshold or more; of each row the `most` most similar.

    Exact: two such sets share an item among the first n - ceil(t n) + 1 of each in the order of rising frequency (prefix
    filter), and what follows the first such item must be long enough for the rest (position filter), so only rare items are joined and common ones never meet.
    Sets of CARRIED items at most are sent along with these items; what is shuffled for larger ones would grow with the square of their size, so they are looked up for pairs.
    """
    sets, size = sets.where("id is not null"), F.size("items")  # said once for all that is made of sets, so that shuffles they need are shared
    carried = _similar_carried(sets.where(size <= CARRIED), threshold, most)
    each = carried.unionByName(_similar_looked_up(sets.where(size > threshold * CARRIED - 1e-9), threshold))
    if most is None:
        return each
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def duplicates(scanned: DataFrame, decls: DataFrame, local: str, threshold: float, most: int = 5) -> DataFrame:
    """name, other, module, similarity, rank: for each proposition (theorem or axiom) of scanned (name, kind, concl, deps) the most similar compiled rows of other sources.

    A row that is declared already is taken as it is indexed. Candidates have its conclusion, where that is known, are without sorry, and mention its first three distinctive constants
    (query.UBIQUITOUS says nothing); similarity is the constants' Jaccard coefficient. A statement without any distinctive constant has none.
    """
    best = F.max_by(F.struct("concl", "consts"), F.struct("elaborated", -F.col("id")))
    known = decls.groupBy("name").agg(best.alias("k"))
    own = scanned.where(F.col("kind").isin("theorem", "axiom")).join(known, "name", "left")
    own = own.select("name", F.col("k.concl").alias("concl"), F.array_distinct(F.coalesce("k.consts", "deps")).alias("consts"))
    anchors = F.slice(F.filter("consts", lambda c: ~c.isin(*UBIQUITOUS)), 1, 3)
    own = own.withColumn("anchors", anchors).where(F.size("anchors") > 0)
    rows = decls.where((F.col("source") != local) & F.col("elaborated") & ~F.col("sorry")).select(
        F.col("id").alias("other_id"), F.col("name").alias("other"), "module", F.col("concl").alias("other_concl"), F.array_distinct("consts").alias("theirs")
    )
    mentions = rows.select("other_id", F.explode("theirs").alias("const"))
    met = own.select("name", F.explode("anchors").alias("const"), F.size("anchors").alias("n")).join(mentions, "const")
    pairs = met.groupBy("name", "n", "other_id").agg(F.count("*").alias("shared")).where("shared = n").select("name", "other_id")
    met = pairs.join(own, "name").join(rows, "other_id").where("other <> name and (concl is null or concl = other_concl)")
    both = F.size(F.array_intersect("consts", "theirs"))
    met = met.withColumn("similarity", both / (F.size("consts") + F.size("theirs") - both)).where(F.col("similarity") >= threshold)
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), "other", "other_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("name", "other", "module", "similarity", "rank")
