"""Loading: last write wins, replacement by source, provenance and staleness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..schema import DECL

#: Rows written in an older format are outdated.
ROW_FORMAT = 4
KEY = ("name", "source", "module")
#: What is known of a loaded source.
PROVENANCE = "source string, revision string, stamp string, indexed_at bigint, decls bigint, writer string, row_format int"


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows by key, the one with the highest id of each; aggregated before the shuffle, so no group is sorted."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "id").alias("r"))
    return best.select(*key, "r.*").select(*rows.columns)


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    return old.where(F.col("source") != source).unionByName(new.where(F.col("source") == source))


@dataclass(frozen=True)
class Index:
    """The tables of a written index; uses (id, dst) and tokens (id, token) are None where they weren't written."""

    decls: DataFrame
    uses: DataFrame | None
    tokens: DataFrame | None
    provenance: DataFrame | None


def _replacing(df: DataFrame, path: str, order: list[str]) -> None:
    """Overwrites the sources that df has and no others: their partitions alone."""
    df.sortWithinPartitions("source", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def write(decls: DataFrame, path: str) -> None:
    """Partitioned by source, so that loading a source again overwrites its partition alone; sorted by conclusion for row-group statistics."""
    _replacing(decls, path, ["concl", "id"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECL).parquet(path)


def mentions_of(decls: DataFrame) -> DataFrame:
    """source, id, dst: constants of statements, as rows."""
    return decls.select("source", "id", F.explode("consts").alias("dst"))


def tokens_of(decls: DataFrame) -> DataFrame:
    """source, id, token: words of names, types and docstrings, each once a row."""
    all_ = F.array_distinct(F.concat(*(words(F.col(c)) for c in ("name", "type", "doc"))))
    return decls.select("source", "id", F.explode(all_).alias("token"))


def write_index(decls: DataFrame, path: str) -> None:
    """The rows, and beside them what statements mention and which words they have, sorted so that a lookup reads few row groups. Sources that decls doesn't have stay as they are."""
    seen = Observation()
    write(decls.observe(seen, F.collect_set("source").alias("sources"), F.count_if(F.coalesce("source", F.lit("")) == "").alias("without")), f"{path}/decl")
    there, ours = read(decls.sparkSession, f"{path}/decl"), F.col("source").isin(seen.get["sources"])
    kept = there.where(ours | F.col("source").isNull() if seen.get["without"] else ours)  # the rows as written, not made a second time
    _replacing(mentions_of(kept), f"{path}/uses", ["dst", "id"])
    _replacing(tokens_of(kept), f"{path}/tokens", ["token", "id"])


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_index(spark: SparkSession, path: str) -> Index:
    def part(name: str, schema: str) -> DataFrame | None:
        return spark.read.schema(schema).parquet(f"{path}/{name}") if _there(spark, f"{path}/{name}") else None

    return Index(read(spark, f"{path}/decl"), part("uses", "id bigint, dst string, source string"), part("tokens", "id bigint, token string, source string"), part("provenance", PROVENANCE))


def record(provenance: DataFrame, path: str) -> None:
    """Provenance of sources, written last: a load without it doesn't count as done."""
    _replacing(provenance.select(*(c.split()[0] for c in PROVENANCE.split(", "))), f"{path}/provenance", [])


def load(decls: DataFrame, path: str, source: str, now: DataFrame | None = None, writer: str = "lemmata") -> tuple[int, int]:
    """Replaces a source in an index: its rows by key, the last one of each, then its provenance. Returns how many rows were handed in and how many were kept. ids go on after those of the other sources.

    now (source, revision, stamp) says what the rows were read from.
    """
    spark = decls.sparkSession
    rows = decls.where(F.col("source") == source)
    first = 0
    if _there(spark, f"{path}/decl"):
        first = (read(spark, f"{path}/decl").where(F.col("source") != source).agg(F.max("id")).first()[0] or 0) + 1
    kept = upsert(rows.limit(0), rows).withColumn("id", F.col("id") + F.lit(first))
    write_index(kept, path)
    handed, stored = rows.count(), read(spark, f"{path}/decl").where(F.col("source") == source).count()
    was = spark.createDataFrame([(source, stored, ROW_FORMAT, writer)], "source string, decls bigint, row_format int, writer string")
    was = was.withColumn("indexed_at", F.unix_timestamp())
    if now is not None:
        columns = [c for c in ("revision", "stamp") if c in now.columns]
        was = was.join(now.select("source", *columns), "source", "left")
    for c in ("revision", "stamp"):
        if c not in was.columns:
            was = was.withColumn(c, F.lit(None).cast("string"))
    record(was, path)
    return handed, stored


def with_statements(decls: DataFrame, spelled: DataFrame) -> DataFrame:
    """decls with `statement` from spelled (name, source, module, statement) where that has one; others keep theirs."""
    new = spelled.groupBy(*KEY).agg(F.max("statement").alias("_new"))
    kept = F.col("statement") if "statement" in decls.columns else F.lit(None).cast("string")
    out = decls.join(new, list(KEY), "left").withColumn("statement", F.coalesce("_new", kept)).drop("_new")
    return out.select(*decls.columns, *(["statement"] if "statement" not in decls.columns else []))


def status(counts: DataFrame, provenance: DataFrame, now: DataFrame) -> DataFrame:
    """source, rows, recorded, state of each source in any of the three: counts (source, n), provenance (source, revision, decls, row_format), now (source, revision).

    moved: both revisions known and different; else outdated: an older row format or none; else current if both are known; else unknown.
    """
    p = provenance.withColumnRenamed("revision", "was")
    met = counts.join(p, "source", "full").join(now, "source", "full")
    moved = F.col("was").isNotNull() & F.col("revision").isNotNull() & (F.col("was") != F.col("revision"))
    state = (
        F.when(moved, "moved")
        .when(F.coalesce("row_format", F.lit(0)) < ROW_FORMAT, "outdated")
        .when(F.col("was").isNotNull() & F.col("revision").isNotNull(), "current")
        .otherwise("unknown")
    )
    return met.select("source", F.coalesce("n", F.lit(0)).alias("rows"), F.col("decls").alias("recorded"), state.alias("state"))
