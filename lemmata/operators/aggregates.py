"""Counts and spreads over declaration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statements import abbreviated, prints_bare


def by_source(decls: DataFrame) -> DataFrame:
    return decls.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def modules_of(decls: DataFrame, source: str) -> DataFrame:
    return decls.where(F.col("source") == source).select("module").distinct()


def spread(decls: DataFrame, column: str) -> DataFrame:
    """How the matches spread over conclusions or modules, commonest first."""
    return decls.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def heads_called(decls: DataFrame, word: str) -> DataFrame:
    """Heads that print as the word: rows that have them (each once), commonest first, then the shorter name.

    The word is a head's last components, or leaves out components between the first ones and the base. Rows whose statement prints the word only after a dot, or binds it, say nothing of what it names;
    heads that are the word itself count always.
    """
    heads = F.array_distinct(F.concat(F.array("concl"), F.coalesce("concl_args", F.array().cast("array<string>"))))
    each = decls.select(F.explode(heads).alias("head"), F.coalesce("type", F.lit("")).alias("type")).where(abbreviated(F.col("head"), word))
    each = each.where((F.col("head") == word) | prints_bare(F.col("type"), word))
    return each.groupBy("head").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.octet_length("head"), "head")


def ending_in(decls: DataFrame, uses: DataFrame, field: str) -> DataFrame:
    """Names that end with a field, by how many rows mention them."""
    names = decls.where(F.col("name").endswith(field)).select("name").distinct()
    counts = uses.where(F.col("dst").endswith(field)).groupBy("dst").agg(F.countDistinct("id").alias("n"))
    return names.join(counts, names["name"] == counts["dst"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")


def vendor_plan(decls: DataFrame) -> DataFrame:
    """Files to copy: source, module, names in order of their place, declarations and lines."""
    lines = F.col("line_end") - F.col("line_start") + 1
    return decls.groupBy("source", "module").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "name"))), lambda x: x["name"]), ",").alias("names"),
        F.count("*").alias("decls"),
        F.sum(lines).alias("lines"),
    )
