"""Levels, closures, frontiers and unfolding classes over dependency edges."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many edges a single walk is made on the driver, as long chains would cost a job for each link.
DRIVER_EDGES = 200_000
#: Unfolding steps either way.
UNFOLD_DEPTH = 16


#: Levels of a walk that are read as separate tables before they are written as one.
COMPACT = 16
#: Bits of the hashes by which rows are let through before a join: 16 MB for all tasks. With many more values than that more rows get through, and results stay the same.
FILTER_BITS = 27


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share. On one machine, as in tests, a temporary one will do; on a cluster rows would be lost in it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_match(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the values of wanted's key, and few others: what is to be joined with them, before it is shuffled.

    The values' hashes are set in bitmaps of 4,096 bytes, and these go to all tasks. They are dealt by bitmap first, so that one is made in one place.
    """
    def placed(c: str) -> tuple:
        h = F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        return F.shiftright(h, 15).alias("_bitmap"), h.bitwiseAND(F.lit(32767)).alias("_bit")

    maps = wanted.select(*placed(key)).repartition("_bitmap").groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bitmap, bit = placed(column)
    met = rows.where(F.col(column).isNotNull()).withColumns({"_bitmap": bitmap, "_bit": bit}).join(F.broadcast(maps), "_bitmap")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return met.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def reach(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """root, node, level (fewest steps) for everything reachable from each root over edges src, dst; the root itself at level 0.

    Nodes of `stop` (column node) are reached and not passed. All roots advance together: a level is one join of the newest nodes with the edges
    and an anti-join with what is known, written so that lineage ends there. Of the edges only those that may start at a newest node are shuffled. Levels are written together every COMPACT, so that a long walk's plan stays small. Cycles end as nothing new turns up.
    """
    now = _written(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("level", F.lit(0)))
    seen, level = now, 0
    while depth is None or level < depth:
        level += 1
        open_ = now.join(stop.select("node"), "node", "left_anti") if stop is not None else now
        near = may_match(edges.select("src", "dst"), "src", open_, "node")
        new = open_.join(near, open_["node"] == near["src"]).select("root", F.col("dst").alias("node")).distinct()
        new = _written(new.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        seen, now = seen.unionByName(new), new
        if level % COMPACT == 0:
            seen = _written(seen)
    return seen


def few_edges(edges: DataFrame) -> bool:
    """Whether there are at most DRIVER_EDGES. Counted where they lie, and no further than that."""
    return edges.select("src").limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES


def reach_one(edges: DataFrame, root: str, stop: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """reach() of one root. A graph of at most DRIVER_EDGES edges is walked on the driver, as a long chain would cost a job for each link; of a larger one nothing goes there."""
    spark = edges.sparkSession
    if not few_edges(edges):
        return reach(edges, spark.createDataFrame([(root,)], "node string"), stop, depth)
    out = defaultdict(list)
    for src, dst in edges.select("src", "dst").distinct().collect():
        out[src].append(dst)
    level, now, n = {root: 0}, [root], 0
    stops = set()
    if stop is not None:
        names = spark.createDataFrame([(x,) for x in {root, *out, *(d for ds in out.values() for d in ds)}], "node string")
        stops = {r[0] for r in names.join(stop, "node", "left_semi").collect()}
    while now and (depth is None or n < depth):
        n += 1
        now = sorted({d for s in now if s not in stops for d in out[s]} - set(level))
        level.update((x, n) for x in now)
    return spark.createDataFrame([(root, x, k) for x, k in level.items()], "root string, node string, level int")


def import_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """module, level: all that modules (column module) import, over imports (module, imported), themselves at level 0."""
    edges = imports.select(F.col("module").alias("src"), F.col("imported").alias("dst"))
    found = reach(edges, roots.select(F.col("module").alias("node")))
    return found.groupBy("node").agg(F.min("level").alias("level")).withColumnRenamed("node", "module")


def frontier(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """What copying the roots takes: root, node, level and role, one of import, materialize and missing. nodes: node, module, importable.

    An importable node is imported as its module and not passed; a node that isn't there is missing; the rest is copied.
    """
    found = reach(edges, roots, nodes.where("importable").select("node"))
    met = found.join(nodes, "node", "left")
    role = F.when(F.col("importable").isNull(), "missing").when(F.col("importable"), "import").otherwise("materialize")
    return met.select("root", "node", "level", "module", role.alias("role"))


def topological(edges: list[tuple[str, str]], names: list[str]) -> list[str]:
    """Dependencies first, roots in the order of their names; a cycle is cut where it closes. For the few names of one copy plan."""
    below = defaultdict(list)
    for src, dst in edges:
        below[src].append(dst)
    own, done, out = set(names), set(), []
    for start in sorted(names):
        stack = [(start, iter(sorted(below[start])))] if start not in done else []
        done.add(start)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x in own and x not in done), None)
            if nxt is None:
                stack.pop()
                out.append(node)
            else:
                done.add(nxt)
                stack.append((nxt, iter(sorted(below[nxt]))))
    return out


def unfolding_class(steps: DataFrame, name: str) -> list[str]:
    """All names that are the same once unfolded: up to the root in at most UNFOLD_DEPTH steps (name -> unfolds), then all below it. Few steps (DRIVER_EDGES) are walked on the driver."""
    steps = steps.select("name", "unfolds").where("name is not null and unfolds is not null")
    if not few_edges(steps.withColumnRenamed("name", "src")):
        return _unfolding_class(steps, name)
    few = steps.distinct().collect()
    up = {}
    down = defaultdict(set)
    for a, b in sorted(few):
        up.setdefault(a, b)
        down[b].add(a)
    root = name
    for _ in range(UNFOLD_DEPTH):
        if root not in up:
            break
        root = up[root]
    found, now = {root}, {root}
    for _ in range(UNFOLD_DEPTH):
        now = {x for n in now for x in down[n]} - found
        found |= now
    return sorted(found | {name})


def _unfolding_class(steps: DataFrame, name: str) -> list[str]:
    """unfolding_class() of many steps: a lookup for each step up, and reach() down. The names of the one class go to the driver."""
    root = name
    for _ in range(UNFOLD_DEPTH):
        to = steps.where(F.col("name") == F.lit(root)).agg(F.min("unfolds")).first()[0]
        if to is None:
            break
        root = to
    down = steps.select(F.col("unfolds").alias("src"), F.col("name").alias("dst"))
    below = reach(down, steps.sparkSession.createDataFrame([(root,)], "node string"), depth=UNFOLD_DEPTH)
    return sorted({r["node"] for r in below.select("node").collect()} | {name})
