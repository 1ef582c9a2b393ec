"""The driver's tables as declaration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def as_decls(df: DataFrame, **columns: Column) -> DataFrame:
    """Missing columns take what a row has that says nothing."""
    empty = F.array().cast("array<string>")
    defaults = {
        "source": F.lit("main"),
        "module": F.lit("main"),
        "kind": F.lit("def"),
        "type": F.lit(""),
        "concl": _none("string"),
        "concl_args": empty,
        "concl_explicit_args": _none("array<string>"),
        "consts": empty,
        "deps": empty,
        "doc": _none("string"),
        "sorry": F.lit(False),
        "elaborated": F.lit(True),
    }
    return df.select(*(c.alias(k) for k, c in (defaults | columns).items()))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a declaration: its parts are the constants of its statement, its suppliers those of its proof."""
    named = lambda kind, keys: F.array_sort(F.transform(keys, lambda k: F.concat(F.lit(kind), k)))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(  # keys are shuffled, names made of them afterwards
        F.collect_set("l_partkey").alias("parts"),
        F.collect_set("l_suppkey").alias("supps"),
        F.max(F.col("l_returnflag") == "R").alias("returned"),
    )
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return as_decls(
        o,
        id=F.col("o_orderkey"),
        name=F.concat(F.lit("Order."), "o_orderkey"),
        source=F.col("o_orderpriority"),
        module=F.date_format("o_orderdate", "'Sales.'yyyy.MM"),
        kind=F.col("o_orderstatus"),
        type=F.concat(F.lit("total "), F.col("o_totalprice").cast("bigint").cast("string")),
        consts=named("part.", F.col("parts")),
        deps=named("supp.", F.col("supps")),
        sorry=F.col("returned"),
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, items: the parts of each order that has lines, as keys."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    return lines.repartition("id").groupBy("id").agg(F.collect_set("item").alias("items"))  # an order's lines lie apart, arrays of one item are larger than its key


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_decls(
        table(spark, sf_dir, "part"),
        id=F.col("p_partkey"),
        name=F.concat(F.lit("Part."), "p_brand", F.lit("."), "p_name"),
        kind=F.col("p_type"),
        type=F.col("p_name"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "toxic"), F.col("doc_id") == F.col("l"), "left")
    return as_decls(
        d,
        id=F.col("doc_id"),
        name=F.concat(F.lit("Doc."), "source", F.lit("."), "lang", F.lit(".d"), F.col("doc_id").cast("string")),
        source=F.col("source"),
        module=F.col("lang"),
        doc=F.col("text"),
        elaborated=F.col("toxic").isNotNull(),
        sorry=F.coalesce(F.col("toxic") == 1, F.lit(False)),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return as_decls(
        table(spark, sf_dir, "pages"),
        id=F.col("page_id"),
        name=F.regexp_extract("url", "://[^/]*(.*)$", 1),
        module=F.array_join(F.reverse(F.split(host, r"\.")), "."),
        kind=F.substring_index("url", ":", 1),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first event is the conclusion's head, all events in order are the heads of its arguments."""
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("heads")
    )
    return as_decls(
        ev,
        id=F.col("user_id"),
        name=F.concat(F.lit("User.u"), F.col("user_id").cast("string")),
        concl=F.get("heads", F.lit(0)),
        concl_args=F.col("heads"),
        concl_explicit_args=F.when(F.col("user_id") % 2 == 0, F.col("heads")),
        consts=F.array_sort(F.array_distinct("heads")),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: what each entity refers to; as often as it does, since making them distinct would shuffle all."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    some = [
        t("nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst")),
        t("customer").select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst")),
        t("supplier").select(node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst")),
        t("orders").select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst")),
        t("lineitem").select(node("order", "l_orderkey").alias("src"), node("supplier", "l_suppkey").alias("dst")),
        t("lineitem").select(node("order", "l_orderkey").alias("src"), node("part", "l_partkey").alias("dst")),
    ]
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, module, importable: regions and nations can be imported; parts aren't known."""
    t = lambda name: table(spark, sf_dir, name)
    some = [("region", "r_regionkey", True), ("nation", "n_nationkey", True), ("customer", "c_custkey", False), ("supplier", "s_suppkey", False), ("orders", "o_orderkey", False)]
    out = None
    for name, key, importable in some:
        kind = name.removesuffix("s")
        x = t(name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("node"), F.lit("M." + kind).alias("module"), F.lit(importable).alias("importable"))
        out = x if out is None else out.unionByName(x)
    return out


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders span days of its nation."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(days).alias("line_start"), F.max(days).alias("line_end"))
    return o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("name"), F.lit("main").alias("source"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("module"), "line_start", "line_end"
    )
