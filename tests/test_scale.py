"""What steps shuffle, in place of how long they take."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lemmata.engine import Engine
from lemmata.operators import graph, joins, store
from lemmata.plans import catalogue
from lemmata.sources import scanner, views


@pytest.fixture
def shuffled(spark):
    """Runs something and says how many bytes it shuffled, beside what it returned."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    def of(f):
        before = total()
        out = f()
        return out, total() - before

    return of


def test_walks_shuffle_what_they_meet(spark, shuffled):
    n = 300_000
    text = lambda c: F.concat(F.lit("n"), F.sha2(c.cast("string"), 256))
    edges = spark.range(n).select(text(F.col("id")).alias("src"), text(F.col("id") + n).alias("dst")).unionByName(spark.createDataFrame([("a", "b"), ("b", "c"), (None, "x"), ("b", "c")], "src string, dst string"))
    roots = spark.createDataFrame([("a",), ("none",)], "node string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the roots were many
    try:
        found, moved = shuffled(lambda: {(r.root, r.node): r.level for r in graph.reach(edges, roots).collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {("a", "a"): 0, ("none", "none"): 0, ("a", "b"): 1, ("a", "c"): 2}
    assert moved < 1_000_000


def test_may_match_keeps_all(spark):
    rows, wanted = spark.range(200_000), spark.range(0, 200_000, 7).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    kept = {r.id for r in graph.may_match(rows, "id", wanted, "k").collect()}
    assert kept >= set(range(0, 200_000, 7)) and len(kept) < 29_000


def test_closures_group_what_they_reach(spark, shuffled):
    n = 200_000
    name = F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 256))
    made = views.as_decls(spark.range(n), id=F.col("id"), name=name).unionByName(views.as_decls(spark.range(n, n + 1), id=F.col("id"), name=F.lit("a"), deps=F.array(F.lit("b"), F.lit("gone"))))
    made = made.unionByName(views.as_decls(spark.range(n + 1, n + 2), id=F.col("id"), name=F.lit("b"), kind=F.lit("theorem"))).withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1))
    want = {(None, 1, 0), ("main", 1, 1)}
    found, moved = shuffled(lambda: {tuple(r) for r in Engine(made).closure("a").collect()})
    assert found == want and moved < 2_000_000
    edges = spark.createDataFrame([("a", "b"), ("a", "gone"), ("a", "b")], "src string, dst string")
    assert {tuple(r) for r in Engine(made.withColumn("deps", F.array().cast("array<string>")), edges=edges).closure("a").collect()} == want


def test_texts_of_one_partition_are_dealt_out(spark):
    files = spark.range(0, 400, 1, 1).select(F.lit("s").alias("source"), F.concat(F.lit("M"), "id").alias("module"), F.concat(F.lit("def d"), "id", F.lit(" := 1")).alias("text"))
    found = scanner.declarations(files).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 400 and max(r.n for r in found) < 100


def test_an_index_makes_its_rows_once(spark, shuffled, tmp_path):
    """Sources that are not written again keep their mentions, and a null source has its own."""
    n = 100_000
    grouped = spark.range(n).groupBy(F.sha2(F.col("id").cast("string"), 256).alias("name")).agg(F.max("id").alias("id"))
    rows = views.as_decls(grouped, id=F.col("id"), name=F.col("name"), source=F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"), consts=F.array(F.lit("x")))
    for c, t in (("line_start", "int"), ("line_end", "int"), ("term", "string"), ("unfolds", "string")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    path = str(tmp_path / "index")
    _, once = shuffled(lambda: rows.write.format("noop").mode("overwrite").save())
    _, moved = shuffled(lambda: store.write_index(rows, path))
    assert 0 < moved < 1.5 * once
    store.write_index(rows.where("source = 'a'").withColumn("consts", F.array(F.lit("y"))), path)
    store.write_index(rows.where("source = 'none'"), path)
    found = {tuple(r) for r in store.read_index(spark, path).uses.groupBy("source", "dst").agg(F.count("*")).collect()}
    assert found == {("a", "y", 33334), ("b", "x", 33333), (None, "x", 33333)}


def likest(sets, threshold, most):
    """id, other, rank: of each set the others that are like it, by all pairs that share an item."""
    has = defaultdict(list)
    for i, x in sets.items():
        for item in x:
            has[item].append(i)
    out = set()
    for i, x in sets.items():
        common = Counter(j for item in x for j in has[item] if j != i)
        like = {j: c / (len(x) + len(sets[j]) - c) for j, c in common.items()}
        best = sorted((-s, j) for j, s in like.items() if s >= threshold)[:most]
        out |= {(i, j, round(-s, 6), rank) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("copies", [0, 1_000])
def test_similarity_does_not_shuffle_pairs(spark, shuffled, copies):
    """Sets that meet often and are seldom similar, and copies of one."""
    rng = random.Random(5)
    sets = {i: rng.sample(range(150), rng.randint(3, 5)) for i in range(3_000)} | {i: [7, 8, 9] for i in range(3_000, 3_000 + copies)}
    rows = spark.createDataFrame(list(sets.items()), "id bigint, items array<bigint>")
    _, once = shuffled(lambda: rows.repartition(4, "id").write.format("noop").mode("overwrite").save())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sets were many
    try:
        found, moved = shuffled(lambda: {(r.id, r.other, round(r.similarity, 6), r["rank"]) for r in joins.similar(rows, 0.5, 5).collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == likest(sets, 0.5, 5)
    assert moved < 12 * once


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.75])
def test_similar_sets_of_all_sizes(spark, threshold):
    """Around the size up to which sets are sent along, with names for items, a word that all have, copies and empty sets."""
    rng = random.Random(6)
    sets = {}
    for i in range(160):
        base = [f"w{rng.randrange(9)}.{j}" for j in range(rng.choice([1, 2, 3, 8, 31, 32, 33, 40, 70]))]
        sets[i] = sorted({*base, "all"})
    sets |= {i: sets[i % 40] for i in range(160, 200)} | {200: [], 201: [], 202: ["all"], 203: ["all"]}
    for i in range(204, 260):
        whole = sets[rng.randrange(160)]
        sets[i] = rng.sample(whole, max(1, len(whole) * 3 // 4))
    rows = spark.createDataFrame(list(sets.items()), "id int, items array<string>")
    for most in (5, None):
        found = joins.similar(rows, threshold, most).collect()
        got = [(r.id, r.other, round(r.similarity, 6)) for r in found]
        want = {x[:3] for x in likest(sets, threshold, most)}
        assert len(got) == len(want) and set(got) == want


def test_similar_orders_are_those_of_lines(spark, tmp_path):
    """The SQL asks for lines alone: an order without a row of its own counts, and one with two counts once."""
    lines = [(1, 10), (1, 11), (2, 10), (2, 11), (2, 10), (3, 12), (None, 12), (None, 10)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").createOrReplaceTempView("made")
    spark.sql("SELECT *, 1L AS l_suppkey, 'R' AS l_returnflag FROM made").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = "SELECT k AS o_orderkey, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus, timestamp '2020-01-01' AS o_orderdate, 1.0D AS o_totalprice FROM VALUES (1L), (1L), (3L) AS t(k)"
    spark.sql(orders).write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, catalogue.dup_jaccard_top5(spark, str(tmp_path)).collect())) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
