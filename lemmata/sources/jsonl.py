"""Declaration rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import kind_of

_WIRE = (
    "format int, name string, source string, module string, kind string, type string, concl string, concl_args array<string>,"
    " concl_explicit_args array<string>, consts array<string>, deps array<string>, doc string, sorry boolean, line_start int, line_end int,"
    " elaborated boolean, unfolds string"
)
#: What a row must have.
NEEDED = ("name", "source", "module", "kind", "type", "elaborated")


#: Bits of an id that count lines within a split of a file; those above count splits.
_LINES = 33


def _numbered(spark: SparkSession, path: str, after: int) -> DataFrame:
    """value, id: lines by the files' names, then by their order. Spark deals files out by size, so an id is put together from a split's place in that order (one row a split goes to the driver) and a line's place in its task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = sorted(tuple(r) for r in lines.select("file", "block").distinct().collect())
    places = spark.createDataFrame([(*s, i) for i, s in enumerate(splits)], "file string, block bigint, place bigint")
    met = lines.join(F.broadcast(places), ["file", "block"])
    return met.select("value", (F.shiftleft("place", _LINES) + F.col("at").bitwiseAND(F.lit((1 << _LINES) - 1)) + F.lit(after + 1)).alias("id"))


def read(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Rows of the files; blank and malformed lines are skipped. `term` stays JSON text. ids follow the files' names and the lines' order, all above `after`, so that a later load's rows are the later ones."""
    lines = _numbered(spark, path, after)
    row = F.from_json("value", _WIRE, {"mode": "PERMISSIVE"})
    rows = lines.select("id", row.alias("r"), F.get_json_object("value", "$.term").alias("term"))
    rows = rows.where(" and ".join(f"r.{c} is not null" for c in NEEDED))
    empty = F.array().cast("array<string>")
    return rows.select(
        "id",
        *(F.col(f"r.{c}") for c in ("name", "source", "module")),
        kind_of(F.col("r.kind")).alias("kind"),
        F.col("r.type").alias("type"),
        "r.concl",
        F.coalesce("r.concl_args", empty).alias("concl_args"),
        "r.concl_explicit_args",
        "term",
        F.array_distinct(F.coalesce("r.consts", empty)).alias("consts"),
        F.array_distinct(F.coalesce("r.deps", empty)).alias("deps"),
        "r.doc",
        F.coalesce("r.sorry", F.lit(False)).alias("sorry"),
        F.when(F.col("r.line_end").isNotNull(), F.col("r.line_start")).alias("line_start"),
        F.when(F.col("r.line_start").isNotNull(), F.col("r.line_end")).alias("line_end"),
        "r.elaborated",
        "r.unfolds",
    )


def write(decls: DataFrame, path: str) -> None:
    """One JSON object a line; `term` is text in it."""
    decls.drop("id").write.mode("overwrite").json(path)


def row_format(spark: SparkSession, path: str) -> int:
    """Format of the first row that can be read: what it says, at most 4; without saying, 2 if it has a key `unfolds`, else 1."""
    rows = spark.read.text(path).select(
        F.get_json_object("value", "$.format").cast("int").alias("format"), F.json_object_keys("value").alias("keys")
    )
    first = rows.where("keys is not null").first()
    if first is None:
        return 1
    return min(first["format"], 4) if first["format"] is not None else 2 if "unfolds" in first["keys"] else 1
