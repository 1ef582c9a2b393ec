"""The match rule against plain Python, walks against cycles and chains, and loading."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lemmata.functions.text import has_text, words
from lemmata.operators import find, graph, joins, store
from lemmata.operators import predicates as P
from lemmata.query import Arg, NameQuery, Query
from lemmata.schema import DECL
from lemmata.sources import jsonl
from lemmata.streaming import ingest

NAMES = ["Real.exp_le", "Real.sin_sq", "Set.mem_mono_finite", "a%b", "a_b", "aXb", "Nat.add.comm", "List.length", "x?y", "p[q]", "Or.elim", "T.ctorIdx"]


def decl(i, name, **more):
    row = dict(
        id=i, name=name, source="s", module="M.a", kind="theorem", type="t", concl="Eq", concl_args=["f", "g", "h"], concl_explicit_args=None, term=None,
        consts=["c", "d.length"], deps=[], doc=None, sorry=False, line_start=None, line_end=None, elaborated=True, unfolds=None,
    )
    return row | more


def frame(spark, rows):
    return spark.createDataFrame(rows, DECL)


def in_order(text, pieces):
    at = 0
    for p in pieces:
        at = text.find(p, at)
        if at < 0:
            return False
        at += len(p)
    return True


@pytest.mark.parametrize("asked", ["exp", "REAL.*sq", "a%b", "a_b", "x?y", "p[q]", "*", "mem_*_finite", ".*comm", "Real.*", "a*b*c"])
def test_names(spark, asked):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.name for r in df.where(P.name_is(F.col("name"), asked)).collect()}
    assert got == {n for n in NAMES if in_order(n.lower(), NameQuery.read(asked).pieces)}


def test_name_scores(spark):
    df = spark.createDataFrame([("Real.exp",), ("exp",), ("exp.a",), ("a.b_exp_c",)], "name string")
    assert [r.s for r in df.select(find.name_score(F.col("name"), "exp").alias("s")).collect()] == [6, 8, 2, 0]


def brute_shape(q, row):
    known = q.implicit or row["concl_explicit_args"] is not None
    heads = row["concl_args"] if q.implicit or row["concl_explicit_args"] is None else row["concl_explicit_args"]
    if q.concl is not None and row["concl"] != q.concl:
        return False
    k = len(q.args)
    offsets = range(0, 1) if known and q.concl is not None else range(len(heads) - k + 1)
    for o in offsets if k <= len(heads) else []:
        got = heads[o : o + k]
        if all(not a.names or h in a.names for a, h in zip(q.args, got, strict=True)):
            if all(
                u in row["consts"]
                or (any(u in i for i in q.inside) and all(q.args[i].written and got[i] != q.args[i].written for i, x in enumerate(q.inside) if u in x))
                for u in q.uses
            ):
                return True
    return False


def test_shapes(spark):
    rows = []
    heads = [list(h) for n in range(4) for h in itertools.product("fg_", repeat=n)]
    for i, (h, e, c) in enumerate(itertools.product(heads, [None, ["g"], ["f", "g"], []], ["Eq", "Iff"])):
        rows.append(decl(i, f"n{i}", concl=c, concl_args=h, concl_explicit_args=e, consts=["c"] if i % 3 else []))
    df = frame(spark, rows).cache()
    f, either = Arg.read("f"), Arg(("f", "g"), "f")
    asked = [
        Query(concl="Eq", args=(f,)), Query(args=(f, Arg.read("g"))), Query(concl="Eq", args=(Arg(), f)), Query(concl="Iff"),
        Query(args=(either, Arg()), uses=("c",), inside=(("c",), ())), Query(concl="Eq", args=(either,), uses=("c",), inside=(("c",),)), Query(concl="Eq", args=(f,), implicit=True),
    ]
    for q in asked:
        got = {r.id for r in df.where(P.matches(q)).collect()}
        assert got == {r["id"] for r in rows if brute_shape(q, r)}, q


def test_generated_and_fields(spark):
    df = frame(spark, [decl(i, n, type="ctorIdx = 1" if n == "Or.elim" else "t") for i, n in enumerate(NAMES)])
    got = {r.name for r in df.where(P.matches(Query(uses=(".length",)))).collect()}
    assert got == set(NAMES) - {"Or.elim", "T.ctorIdx"}
    assert df.where(P.matches(Query(uses=(".length",), generated=True))).count() == len(NAMES)


def test_words(spark):
    df = spark.createDataFrame([("Für x²-y, foo_bar",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(words(F.col("t")).alias("w")).collect()] == [["für", "x²", "y", "foo", "bar"], [], []]
    assert df.where(has_text([F.col("t")], "Y foo")).count() == 1
    assert df.where(has_text([F.col("t")], "")).count() == 0


def test_empty_query_is_refused(spark):
    with pytest.raises(ValueError):
        find.find(frame(spark, []), Query(name="*"))


def test_decoys_do_not_hide_hits(spark):
    decoys = spark.range(20001).select(F.col("id"))
    row = frame(spark, [decl(0, "hit", concl_args=["B", "A"], concl_explicit_args=["B", "A"])])
    many = row.drop("id").crossJoin(decoys).withColumn("concl_explicit_args", F.when(F.col("id") == 20000, F.col("concl_args")).otherwise(F.array(F.lit("A"), F.lit("B"))))
    best, _ = find.find(many.select(*row.columns), Query(concl="Eq", args=(Arg.read("B"), Arg.read("A"))))
    assert [r.id for r in best.collect()] == [20000]


def test_walks(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(5000)] + [("n5000", "n0")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    found = graph.reach_one(edges, "n0").agg(F.count("*"), F.max("level")).first()
    assert tuple(found) == (5001, 5000)
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("x",)], "node string")
    got = {(r.root, r.node): r.level for r in graph.reach(ring, roots).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("x", "x"): 0, ("x", "b"): 1, ("x", "c"): 2, ("x", "a"): 3}
    assert graph.topological([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], ["a", "b", "c", "x"]) == ["c", "b", "a", "x"]


def test_unfolding(spark):
    steps = spark.createDataFrame([("Euclid", "Pi"), ("Pi", "With"), ("Other", "With"), ("l1", "l2"), ("l2", "l1")], "name string, unfolds string")
    assert graph.unfolding_class(steps, "Euclid") == ["Euclid", "Other", "Pi", "With"]
    assert graph.unfolding_class(steps, "l1") == ["l1", "l2"]
    assert graph.unfolding_class(steps, "alone") == ["alone"]


def test_unfolding_of_many_steps(spark, monkeypatch):
    """More steps than are walked on the driver give the same classes."""
    pairs = [("Euclid", "Pi"), ("Pi", "With"), ("Other", "With"), ("a", "Zeta"), ("z", "Zeta"), ("l1", "l2"), ("l2", "l1"), ("two", "m"), ("two", "k"), ("x", None)]
    steps = spark.createDataFrame(pairs, "name string, unfolds string")
    names = ("Euclid", "z", "l1", "two")
    small = [graph.unfolding_class(steps, n) for n in names]
    monkeypatch.setattr(graph, "DRIVER_EDGES", 3)
    assert [graph.unfolding_class(steps, n) for n in names] == small
    assert small == [["Euclid", "Other", "Pi", "With"], ["Zeta", "a", "z"], ["l1", "l2"], ["k", "two"]]


def test_similar_is_exact(spark):
    sets = [(i, sorted({(i * j) % 13 for j in range(1, 2 + i % 6)})) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, items array<int>")
    got = {(r.id, r.other) for r in joins.similar(df, 0.6).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a != b and len({*x} & {*y}) >= 0.6 * len({*x} | {*y})}
    assert got == want


def test_jsonl_and_store(spark, tmp_path):
    lines = [
        json.dumps(dict(name="A.b", source="s", module="M", kind="lemma", type="t", elaborated=True, term={"head": "f"}, consts=["c", "c"])),
        "", "not json at all",
        json.dumps(dict(name="A.c", source="r", module="M", kind="odd", type="t", elaborated=False, line_start=3)),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    rows = {r.name: r for r in jsonl.read(spark, str(tmp_path / "in")).collect()}
    assert rows["A.b"].kind == "theorem" and json.loads(rows["A.b"].term) == {"head": "f"} and rows["A.b"].consts == ["c"]
    assert rows["A.c"].kind == "odd" and rows["A.c"].line_start is None and rows["A.c"].concl_args == []
    assert jsonl.row_format(spark, str(tmp_path / "in")) == 1
    decls = jsonl.read(spark, str(tmp_path / "in")).select(*[f.name for f in spark.createDataFrame([], DECL).schema])
    store.write(decls, str(tmp_path / "index"))
    again = decls.where("source = 's'").withColumn("name", F.lit("new"))
    store.write(again, str(tmp_path / "index"))
    assert {r.name for r in store.read(spark, str(tmp_path / "index")).collect()} == {"new", "A.c"}
    seen = []
    ingest.on_arrival(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination(60)
    assert seen == [4]
